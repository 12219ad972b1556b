"""Line de-duplication across documents, in DataFrame functions only.

A first pass counts every line key, merged map-side, and marks those that more than one document may hold in a bit set
of fixed size; only their lines go on. They are range-partitioned by key with a secondary sort by document and position; a window streams over them and keeps the
lines of the first document. A key held by very many documents is cut into slices, whose first documents are compared
with the key's. What comes back is a bitmap of the lines to drop for every document that loses any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import SPACES, Scratch, bit_set, in_bit_set, stage, texts

BITS = 1 << 26
#: Lines of one key that a window sees together.
SLICE = 1 << 11


def ascii_lower(text: Column) -> Column:
    upper = "".join(chr(c) for c in range(ord("A"), ord("Z") + 1))
    same = F.octet_length(text) == F.char_length(text)
    return F.when(same, F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def line_keys(docs: DataFrame, min_points: int) -> DataFrame:
    """(doc_id, tag, pos, k1, k2): the lines with a key long enough, the key as 128 bits."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("tag"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keys = lines.select("doc_id", "tag", "pos", F.btrim("line", F.lit(SPACES)).alias("key")).where(F.length("key") >= min_points)
    lowered = keys.select("doc_id", "tag", "pos", ascii_lower(F.col("key")).alias("key"))
    return lowered.select("doc_id", "tag", "pos", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(1), "key").alias("k2"))


def line_dedup(docs: DataFrame, min_points: int = 20, min_docs: int = 3, bits: int = BITS, slice_rows: int = SLICE) -> DataFrame:
    """(doc_id, tag, n_dropped, words): for documents that lose lines, the lines to drop as a bitmap.

    Bit ``pos % 64`` of ``words[pos / 64]`` is line ``pos``; lines past the last word stay. ``tag`` is the xxhash64 of the
    text. A line's key is the line stripped of white space at both ends, A-Z lower-cased. Keys of ``min_points`` code
    points and more that ``min_docs`` documents hold stay only in the largest doc_id. Null text is one empty line. Rows
    that repeat a doc_id are one document; a null doc_id counts as the smallest. Empty tables give no rows.
    """
    rows, scratch = texts(docs), Scratch(docs.sparkSession)
    keyed = line_keys(rows, min_points)
    several = (F.count("*") >= min_docs) & (
        F.lit(min_docs < 2) | (F.min("doc_id") < F.max("doc_id")) | (F.count("doc_id") < F.count("*"))
    )
    maybe = keyed.groupBy("k1", "k2").agg(several.alias("several")).where("several")
    filled = scratch(bit_set(maybe, F.col("k1"), bits), "lines-bits")
    likely = in_bit_set(keyed, filled, F.col("k1"), bits, "likely").where("likely").drop("likely")
    occurrences = scratch(likely, "lines-likely")
    inside = occurrences.groupBy("k1", "k2", "doc_id").agg(F.count("*").alias("n_lines"))
    shared = scratch(
        inside.groupBy("k1", "k2")
        .agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"), F.sum("n_lines").alias("n_lines"))
        .where(F.col("n_docs") >= min_docs)
        .select("k1", "k2", "last_doc", F.ceil(F.col("n_lines") / slice_rows).alias("slices")),
        "lines-shared",
    )

    cell = ["k1", "k2", "slice"]
    ordered = (
        occurrences.join(shared, ["k1", "k2"])
        .withColumn("slice", F.pmod(F.xxhash64("doc_id"), "slices"))
        .repartitionByRange(*cell)
    )
    stream = Window.partitionBy(*cell).orderBy(F.desc_nulls_last("doc_id"), "pos").rowsBetween(Window.unboundedPreceding, 0)
    first = F.first("doc_id").over(stream)
    lost = (
        ordered.withColumn("first", first)
        .where(~(F.col("doc_id").eqNullSafe(F.col("first")) & F.col("first").eqNullSafe(F.col("last_doc"))))
        .select("doc_id", "tag", "pos")
    )
    bit = F.expr("shiftleft(1L, pos % 64)")
    words = lost.groupBy("doc_id", "tag", F.expr("pos div 64").alias("word")).agg(F.bit_or(bit).alias("bits"))
    sparse = words.groupBy("doc_id", "tag").agg(
        F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("filled"),
        F.sum(F.bit_count("bits").cast("long")).alias("n_dropped"),
    )
    dense = F.expr("transform(sequence(0L, array_max(map_keys(filled))), w -> coalesce(filled[w], 0L))")
    bitmaps = stage(sparse.select("doc_id", "tag", "n_dropped", dense.alias("words")), "lines-bitmaps")
    scratch.clear()
    return bitmaps


def keep_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped): every document with the lines that stay, joined by line feeds."""
    rows = texts(docs).withColumn("tag", F.xxhash64("text"))
    same = F.col("d.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("d.tag") == F.col("b.tag"))
    joined = rows.alias("d").join(bitmaps.alias("b"), same, "left").select("d.doc_id", "d.text", "b.words", "b.n_dropped")
    kept = F.expr(
        """array_join(filter(split(text, '\n', -1), (line, i) ->
             coalesce(shiftright(get(words, i div 64), i % 64) & 1L, 0L) = 0L), '\n')"""
    )
    return joined.select(
        "doc_id",
        F.when(F.col("words").isNull(), F.col("text")).otherwise(kept).alias("text"),
        F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
    )
