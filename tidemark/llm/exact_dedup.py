"""Exact de-duplication by progressive refinement, in DataFrame functions only.

Texts are equal when they are identical without white space. Level one groups by that length, level two by a hash of
the first characters, and only rows of groups that still have company get a hash of the full content. The rows that
survive two levels are marked in a bit set of fixed size, so no text is shuffled: every level moves narrow rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, bit_set, in_bit_set, stage, texts, without, without_spaces

HEAD = 64
BITS = 1 << 26


def exact_dedup(docs: DataFrame, head: int = HEAD, bits: int = BITS, digest_all: bool = False) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), a row per document, dropped ones too.

    Of equal texts stays the row with the most code points, then the smallest doc_id. ``text_sha256`` is the digest of
    the text without white space; rows that no group needs it for have null, unless ``digest_all`` asks for it.
    Null text is empty, and all empty texts are equal. Rows that repeat a doc_id and its text are one document and give
    one row; the same doc_id with another text is a document of its own. A null doc_id is a value like any other, the
    last choice to stay. An empty table gives no rows; other columns are ignored, whatever they are called.
    """
    rows, scratch = texts(docs), Scratch(docs.sparkSession)
    packed = rows.select("doc_id", without_spaces(F.col("text")).alias("packed"))
    marks = scratch(
        packed.select(
            "doc_id",
            F.length("packed").alias("length"),
            F.xxhash64(F.substring("packed", 1, head)).alias("head"),
        ),
        "dedup-marks",
    )
    lengths = scratch(marks.groupBy("length").count().where("count > 1").select("length"), "dedup-lengths")
    level_one = marks.join(lengths, "length", "left_semi")
    heads = scratch(level_one.groupBy("length", "head").count().where("count > 1").select("length", "head"), "dedup-heads")
    survivors = marks.join(heads, ["length", "head"], "left_semi")
    marked = scratch(bit_set(survivors, F.xxhash64("doc_id"), bits), "dedup-bits")

    wanted = in_bit_set(rows, marked, F.xxhash64("doc_id"), bits, "candidate")
    digest = F.unhex(F.sha2(without_spaces(F.col("text")), 256))
    full = stage(
        wanted.select(
            "doc_id",
            F.length("text").alias("points"),
            "candidate",
            F.when(F.lit(True) if digest_all else F.col("candidate"), digest).alias("digest"),
        ),
        "dedup-digests",
    )
    scratch.clear()
    # Keyed by document too, so copies of one text spread over all tasks here.
    members = stage(
        full.where("candidate").groupBy("digest", "doc_id").agg(F.max("points").alias("points")), "dedup-members"
    )
    best = F.struct("points", F.col("doc_id").isNotNull(), -F.col("doc_id"))
    groups = stage(
        members.groupBy("digest").agg(F.count("*").alias("group_size"), F.max_by("doc_id", best).alias("keep_id")),
        "dedup-groups",
    )
    grouped = members.join(groups, "digest").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest"
    )
    single = full.where("not candidate").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest"
    )
    return grouped.unionByName(single).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that exact_dedup drops; all columns stay. Rows that repeat the id and text of a document
    that stays are that document, and stay."""
    gone = stage(exact_dedup(docs).where("not kept").select("doc_id", F.unhex("text_sha256").alias("digest")), "dedup-dropped")
    packed = without_spaces(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return without(docs, gone, {"doc_id": F.col("doc_id").cast("long"), "digest": F.unhex(F.sha2(packed, 256))})
