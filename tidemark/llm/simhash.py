"""Near-duplicates by SimHash, found with multi-index hashing.

Fingerprints, not documents, are compared: copies share one. A fingerprint is cut into so few segments that two within
``max_bits`` must agree in one of them up to a small distance. Every fingerprint is listed under its exact segments and
looks up the small Hamming ball around each; matches are verified over all 64 bits. Links are joined to components by
alternating star steps, each a stage table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, stage, texts, without
from tidemark.llm.tokens import release

#: Shingles whose bits are counted at once.
CHUNK = 1 << 15
#: Rows that a task works on together.
ROWS = 256


def fingerprint(text: str, shingle: int, seed: int) -> int:
    """Signed 64-bit fingerprint. ``bytes.lower`` and ``bytes.split`` know ASCII only, as the definition does."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        shingles = iter([b" ".join(words)])
        total = 1
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
        total = len(words) - shingle + 1
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, total, CHUNK):
        size = min(CHUNK, total - at)
        hashes = np.fromiter((xxh64_intdigest(next(shingles), seed) for _ in range(size)), dtype=">u8", count=size)
        counts += np.unpackbits(hashes.view(np.uint8)).reshape(size, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > total).view(">i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint long) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                marks = [fingerprint(x.as_py(), shingle, seed) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(marks, pa.int64())], names=["doc_id", "fingerprint"])

    return texts(docs).mapInArrow(run, "doc_id long, fingerprint long")


def segments(max_bits: int) -> tuple[list[tuple[int, int]], int]:
    """((offset, width) of each segment, radius): with m segments, one is within max_bits // m."""
    count = max_bits // 2 + 1
    edges = [64 * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)], max_bits // count


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def links(distinct: DataFrame, max_bits: int = 3) -> DataFrame:
    """(a, b), a < b: all pairs of different fingerprints within ``max_bits``, some more than once."""
    cut, radius = segments(max_bits)
    exact, ball = [], []
    for index, (offset, width) in enumerate(cut):
        mask = _signed((1 << width) - 1)
        value = f"((shiftrightunsigned(fingerprint, {offset})) & {mask}L)"
        flips = [_signed(sum(1 << b for b in bits)) for r in range(radius + 1) for bits in combinations(range(width), r)]
        exact.append(f"struct({index} as part, {value} as segment)")
        ball.append(f"transform(array({', '.join(f'{x}L' for x in flips)}), x -> struct({index} as part, {value} ^ x as segment))")
    tables = distinct.select(F.col("fingerprint").alias("b"), F.expr(f"inline(array({', '.join(exact)}))"))
    probes = distinct.select(F.col("fingerprint").alias("a"), F.expr(f"inline(concat({', '.join(ball)}))"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    return probes.join(tables, ["part", "segment"]).where((F.col("a") < F.col("b")) & near).select("a", "b")


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, component): the smallest node each linked node can reach, of undirected edges (u, v).

    Large-star ties every node's larger neighbours to its smallest one, small-star its smaller ones; the number of
    rounds grows with the logarithm of the longest path. Edges stay distributed; the driver sees one row a round.
    """
    high, low = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    before, seen = Scratch(edges.sparkSession), None
    edges = before(edges.where("u <> v").select(high, low).distinct(), "star-edges")
    for _ in range(rounds):
        scratch, fresh = Scratch(edges.sparkSession), Scratch(edges.sparkSession)
        lowest = lambda rows, scratch=scratch: scratch(rows.groupBy("u").agg(F.min("v").alias("low")), "star-low")
        both = scratch(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), "star-both")
        lows = lowest(both).select("u", F.least("low", "u").alias("low"))
        large = both.join(lows, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v")
        large = scratch(large.distinct(), "star-large")
        lows = lowest(large)
        moved = large.join(lows, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        edges = fresh(moved.unionByName(lows.select("u", F.col("low").alias("v"))).distinct(), "star-small")
        scratch.clear()
        before.clear()
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before, seen = fresh, state
    raise RuntimeError(f"no fixpoint after {rounds} rounds")


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint long, component_id): a row per document; component_id is the smallest doc_id reachable.

    A-Z are lower-cased, words are runs without [\\x20\\x09-\\x0D]; shingles of ``shingle`` words count as often as they
    occur, a shorter text is one shingle, a text without words (null too) has fingerprint zero and is linked like any
    other. A bit is set if it is set in over half the hashes, so a tie clears it. Every row counts, repeated ones too;
    an id on two texts links both. Null ids never name a component. An empty table gives no rows.
    """
    marks = stage(fingerprints(docs, shingle, seed), "simhash-marks")
    classes = stage(marks.groupBy("fingerprint").agg(F.min("doc_id").alias("node")), "simhash-classes")
    pairs = stage(links(classes, max_bits), "simhash-links")
    name = lambda side: classes.select(F.col("fingerprint").alias(side), F.col("node").alias("u" if side == "a" else "v"))
    joined = components(pairs.join(name("a"), "a").join(name("b"), "b").select("u", "v"))
    reached = classes.join(joined, "node", "left")
    named = stage(
        reached.select("fingerprint", F.coalesce("component", "node").alias("component_id")), "simhash-components"
    )
    return marks.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """``docs`` without those that are not their component's smallest doc_id; all columns stay. Rows are told apart by
    doc_id: rows with a null one all stay, near copies too, and rows that repeat an id stay or go together."""
    found = near_duplicates(docs, shingle, max_bits)
    gone = stage(found.where("doc_id <> component_id").select("doc_id").distinct(), "simhash-dropped")
    return without(docs, gone, {"doc_id": F.col("doc_id").cast("long")})
