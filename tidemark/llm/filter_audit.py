"""Filter interaction audit: what five filters remove in every order, and what each one adds to the others.

Four filters look at one text. The fifth finds texts that a smaller doc_id has too. A counting Bloom prepass clears those that
no other document can have: every text counts up in a few places of one sketch, counts of all tasks are merged, and a text with a
place that was counted once is unique for certain. Only the others are shuffled, with their whole texts, for the smallest id of
each. The flags of a document are a mask; counts by mask add up, and every order of the filters is read off at most 32 of them
for each part of the corpus.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BITMAP_BITS, SPACES, Scratch, stage

FILTERS = "ABCDE"
#: Places of the sketch that a text counts up, and places of the sketch for each document.
PLACES = 2
LOAD = 16
#: A sketch of more blocks (4 KB each) is not broadcast, its blocks are joined.
BROADCAST_BLOCKS = 1 << 14
#: Texts held by more than one in so many documents meet their group by broadcast.
HOT = 1000


def flags(text: Column, min_words: int = 200) -> Column:
    """Bit i is set if filter i of ABCD fails ``text``: few words, few distinct words, many capitals, a mark."""
    words = F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " ", -1), "")
    few = F.size(words) < min_words
    repeated = 100 * F.size(F.array_distinct(words)) < 50 * F.size(words)
    capitals = F.octet_length(text) - F.octet_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    loud = 100 * capitals > 2 * F.length(text)
    marked = F.length(F.translate(text, "#$%&*|", "")) < F.length(text)
    return sum((c.cast("int") * (1 << i) for i, c in enumerate((few, repeated, loud, marked))), F.lit(0))


def sketch(marks: DataFrame, blocks: int) -> DataFrame:
    """(block, counted): a counting Bloom filter by blocks. Counts of a place are added map-side, then over all tasks; as it only
    matters whether more than one text was counted, a block is kept as the bits of such places."""
    places = marks.select("block", F.explode(_places()).alias("place"))
    counted = places.groupBy("block", "place").agg(F.count("*").alias("n")).where("n > 1")
    return counted.groupBy("block").agg(F.bitmap_construct_agg(F.col("place").cast("long")).alias("counted"))


def _places() -> Column:
    """The places of a text in its block; distinct ones, so that no text counts a place twice."""
    return F.array_distinct(F.array(*[F.pmod(F.xxhash64("mark", F.lit(i)), F.lit(BITMAP_BITS)).cast("int") for i in range(PLACES)]))


def possible_repeats(marks: DataFrame, filled: DataFrame, small: bool) -> DataFrame:
    """The rows of ``marks`` whose places have all been counted more than once."""
    filled = F.broadcast(filled) if small else filled

    def more(place: Column) -> Column:
        octet = F.conv(F.hex(F.substring("counted", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return octet.bitwiseAND(F.call_function("shiftleft", F.lit(1), place % 8)) != 0

    return marks.join(filled, "block").where(F.forall(_places(), more)).drop("counted")


def repeats(docs: DataFrame, block_rows: int = BITMAP_BITS // LOAD, broadcast_blocks: int = BROADCAST_BLOCKS, hot: int = HOT) -> DataFrame:
    """(doc_id, mark): the documents whose whole text a smaller doc_id has too, a row for each row of ``docs``; ``mark`` is the
    xxhash64 of the text.

    ``docs`` has doc_id and text. A null doc_id is neither smaller than another nor has it a smaller one. Rows that repeat a
    doc_id and its text do not count against each other. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    marks = scratch(rows.select("doc_id", "mark"), "audit-marks")
    total = marks.count()
    blocks = max(1, -(-total // block_rows))
    blocked = marks.withColumn("block", F.pmod(F.xxhash64("mark", F.lit(-1)), F.lit(blocks)))
    filled = scratch(sketch(blocked, blocks), "audit-sketch")
    maybe = rows.withColumn("block", F.pmod(F.xxhash64("mark", F.lit(-1)), F.lit(blocks)))
    maybe = possible_repeats(maybe, filled, blocks <= broadcast_blocks).where("doc_id IS NOT NULL")
    # Whole texts are compared here, merged map-side; what a group hands on to its members is a digest.
    digest = F.unhex(F.sha2("text", 256)).alias("digest")
    grouped = maybe.groupBy("text").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count("*").alias("n"))
    groups = scratch(grouped.where("first_id < last_id").select(digest, "first_id", "n"), "audit-groups")
    members = scratch(maybe.select("doc_id", "mark", digest), "audit-members")
    limit = F.lit(total // hot)
    few = F.broadcast(groups.where(F.col("n") > limit).select("digest", "first_id"))
    direct = members.join(few, "digest", "left")
    rest = direct.where("first_id IS NULL").select("doc_id", "mark", "digest").join(groups.where(F.col("n") <= limit).select("digest", "first_id"), "digest")
    found = stage(direct.where("first_id < doc_id").select("doc_id", "mark").unionByName(rest.where("first_id < doc_id").select("doc_id", "mark")), "audit-repeats")
    scratch.clear()
    return found


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by source and by the filters that they fail (bit i: filter i of ABCDE)."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
    )
    scratch = Scratch(docs.sparkSession)
    copies = repeats(rows.select("doc_id", "text")).distinct().withColumn("copy", F.lit(16))
    own = scratch(rows.select("doc_id", "part", F.xxhash64("text").alias("mark"), flags(F.col("text")).alias("own")), "audit-flags")
    masked = scratch(
        own.join(copies, ["doc_id", "mark"], "left").select("doc_id", "part", (F.col("own") + F.coalesce("copy", F.lit(0))).alias("mask")), "audit-masks"
    )
    judged = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic")
    )
    plain = masked.groupBy("part", "mask").agg(F.count("*").alias("n")).withColumns({"good": F.lit(0), "toxic": F.lit(0)})
    seen = masked.join(judged.where("good > 0 OR toxic > 0"), "doc_id").groupBy("part", "mask")
    seen = seen.agg(F.lit(0).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    counts = stage(plain.unionByName(seen).groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")]), "audit-counts")
    scratch.clear()
    return counts


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per part, order of the five filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``docs`` has doc_id, text and source, ``labels`` doc_id, quality and toxic. Null text is empty, null source is the part ''.
    A label counts if any row of its doc_id has it. For null and repeated doc_ids see ``repeats``. An empty table gives no rows; other columns are ignored.
    """
    counts = mask_counts(docs, labels)
    cell = F.struct("mask", "n", "good", "toxic")
    parts = counts.groupBy("part").agg(F.collect_list(cell).alias("cells"))  # 32 cells at most
    # 600 rows for a part, however many documents it has; one literal instead of as many expressions.
    bits = {letter: 1 << i for i, letter in enumerate(FILTERS)}
    steps = [
        {"filter_order": "".join(order), "step": i + 1, "own": bits[letter], "before": sum(bits[x] for x in order[:i])}
        for order in permutations(FILTERS)
        for i, letter in enumerate(order)
    ]
    kind = "array<struct<filter_order: string, step: int, own: int, before: int>>"
    rows = parts.select("part", "cells", F.inline(F.from_json(F.lit(json.dumps(steps)), kind)))
    own, before = F.col("own"), F.col("before")

    def total(test, value: str = "n", weight=lambda c: F.lit(1)) -> Column:
        return F.aggregate(F.filter("cells", test), F.lit(0).cast("long"), lambda s, c: s + c[value] * weight(c))

    fails = lambda c: c["mask"].bitwiseAND(own) != 0
    here = lambda c: fails(c) & (c["mask"].bitwiseAND(before) == 0)
    # Of the orders of all filters, one in as many as a document fails begins with a given one of those.
    orders = len(list(permutations(FILTERS)))
    share = lambda c: F.floor(F.lit(orders) / F.bit_count(c["mask"]))
    return rows.select(
        "part",
        "filter_order",
        "step",
        total(lambda c: c["mask"].bitwiseAND(own.bitwiseOR(before)) == 0).alias("kept"),
        total(here).alias("removed"),
        total(lambda c: fails(c) & (c["mask"].bitwiseAND(before) != 0)).alias("redundant"),
        total(lambda c: c["mask"] == own).alias("unique_fails"),
        total(here, "good").alias("good_lost"),
        total(here, "toxic").alias("toxic_lost"),
        total(fails, "n", share).alias("shapley"),
    )
