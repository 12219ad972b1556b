"""Token ids as files: canonical length-limited Huffman codes from global counts, decoded by table.

A file is a table of segments in ascending order of doc_id. A segment holds whole documents: their ids and lengths, the
coded bits, and the bit offset of every block of ids, so each block can be decoded alone. Decoding runs all blocks of a
segment in step, one table look-up for each. The code is one row of lengths for all segments.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import discard, stage, staged, texts
from tidemark.llm.tokens import pieces, portions
from tidemark.session import scratch_path

BLOCK = 128
SEGMENT = 1 << 19
#: Rows that a task works on together.
ROWS = 256
MAX_BITS = 16


def code_lengths(counts: np.ndarray, max_bits: int) -> np.ndarray:
    """Optimal lengths of at most ``max_bits`` by package-merge; 0 where the count is 0."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} ids need codes of more than {max_bits} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    items, from_leaf = leaves, [np.ones(len(leaves), dtype=bool)]
    for _ in range(max_bits - 1):
        packages = items[: len(items) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, packages])
        rank = np.argsort(both, kind="stable")
        items = both[rank]
        from_leaf.append(rank < len(leaves))
    take, times = 2 * len(leaves) - 2, np.zeros(len(leaves), dtype=np.uint8)
    for level in reversed(from_leaf):
        taken = int(level[:take].sum())
        times[:taken] += 1
        take = 2 * (take - taken)
    lengths[order] = times
    return lengths


@dataclass
class Code:
    """Canonical codes: shorter first, then by id."""

    lengths: np.ndarray

    def __post_init__(self):
        self.bits = max(1, int(self.lengths.max(initial=0)))
        order = np.lexsort((np.arange(len(self.lengths)), self.lengths))
        self.order = order[self.lengths[order] > 0]
        size = self.lengths[self.order].astype(np.int64)
        steps = np.left_shift(np.int64(1), self.bits - size)
        starts = np.cumsum(steps) - steps
        self.codes = np.zeros(len(self.lengths), dtype=np.uint64)
        self.codes[self.order] = starts >> (self.bits - size)
        self.table_ids = np.zeros(1 << self.bits, dtype=np.uint32)
        self.table_sizes = np.ones(1 << self.bits, dtype=np.int64)
        self.table_ids[: steps.sum()] = np.repeat(self.order, steps)
        self.table_sizes[: steps.sum()] = np.repeat(size, steps)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(bits, bit offset of every block)."""
        if not len(ids):
            return b"", np.zeros(0, dtype="<u4")
        size = self.lengths[ids].astype(np.uint64)
        ends = np.cumsum(size, dtype=np.uint64)
        starts = ends - size
        shifted = self.codes[ids] << (np.uint64(64) - (starts & np.uint64(31)) - size)
        word = (starts >> np.uint64(5)).astype(np.int64)
        firsts = np.flatnonzero(np.diff(word, prepend=-1))
        out = np.zeros(int(word[-1]) + 2, dtype=np.uint64)
        out[word[firsts]] = np.bitwise_or.reduceat(shifted >> np.uint64(32), firsts)
        out[word[firsts] + 1] |= np.bitwise_or.reduceat(shifted & np.uint64(0xFFFFFFFF), firsts)
        return out.astype(">u4").tobytes()[: (int(ends[-1]) + 7) // 8], starts[::BLOCK].astype("<u4")

    def decode(self, payload: bytes, offsets: np.ndarray, total: int) -> np.ndarray:
        """The ids of a segment; every block starts from its own bit offset."""
        data = np.frombuffer(payload + bytes(BLOCK * self.bits // 8 + 8), dtype=np.uint8).astype(np.uint32)
        words = data[:-3] << np.uint32(24) | data[1:-2] << np.uint32(16) | data[2:-1] << np.uint32(8) | data[3:]
        at, out = offsets.astype(np.int64), np.empty((BLOCK, len(offsets)), dtype=np.uint32)
        keep = np.uint32(32 - self.bits)
        for step in range(min(BLOCK, total)):
            entry = (words[np.minimum(at >> 3, len(words) - 1)] << (at & 7).astype(np.uint32)) >> keep
            out[step] = self.table_ids[entry]
            at += self.table_sizes[entry]
        return out.T.reshape(-1)[:total]


@dataclass
class TokenFiles:
    """Where the segments and the code's lengths are, and how many ids the code knows."""

    segments: str
    lengths: np.ndarray


def tokenize(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """(doc_id, n_tokens, ids): ids with the end id, compressed for the way to their segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, squeeze = pieces(path), zstandard.ZstdCompressor(level=1).compress
        end = np.array([end_id], dtype=own.type)
        for batch in batches:
            for part in portions(batch, 1):
                ids = [np.concatenate([x, end]) for x in own.batch(part.column(1))]
                columns = [part.column(0), pa.array(map(len, ids), pa.int64()), pa.array([squeeze(x.tobytes()) for x in ids], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def count_ids(tokenized: DataFrame, path: str) -> DataFrame:
    """(id, n): how often each id occurs, summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path)
        counts = np.zeros(max(own.library.get_vocab_size(), 1), dtype=np.int64)
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                several = b"".join([expand(x) for x in batch.column(0).slice(at, ROWS).to_pylist()])
                found = np.bincount(np.frombuffer(several, dtype=own.type), minlength=len(counts))
                counts = found + np.pad(counts, (0, len(found) - len(counts)))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["id", "n"])

    return tokenized.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


SEGMENT_SCHEMA = (
    "part int, before long, total long, doc_ids array<long>, lengths array<long>, offsets binary, payload binary"
)


def write_token_files(docs: DataFrame, path: str, end_id: int = 0, max_bits: int = MAX_BITS) -> TokenFiles:
    """Encode every whole text, append ``end_id``, and write the ids in ascending order of doc_id.

    Null text is empty and still has its end id; null doc_ids come first, rows that repeat a doc_id stand beside each
    other. An empty table writes no segments. Other columns are ignored.
    """
    spark = docs.sparkSession
    tokenized, used_up = staged(tokenize(docs, path, end_id), "token-ids")
    # One row for each id of the vocabulary at most.
    found = count_ids(tokenized, path).collect()
    counts = np.zeros(max([0, *(r["id"] for r in found)]) + 1, dtype=np.int64)
    for row in found:
        counts[row["id"]] = row["n"]
    lengths = code_lengths(counts, max(max_bits, int(np.ceil(np.log2(max(2, len(counts)))))))
    # The bounds come from ids alone; what is shuffled is each document's compressed ids.
    ordered = tokenized.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "n_tokens", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, code, expand = pieces(path).type, Code(lengths), zstandard.ZstdDecompressor().decompress
        part, before, held, size = TaskContext.get().partitionId(), 0, [], 0

        def segment() -> pa.RecordBatch:
            ids = np.concatenate([x for _, x in held])
            payload, offsets = code.encode(ids)
            row = (part, before, len(ids), [d for d, _ in held], [len(x) for _, x in held], offsets.tobytes(), payload)
            types = (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary())
            names = ("part", "before", "total", "doc_ids", "lengths", "offsets", "payload")
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=names)

        for batch in batches:
            for doc_id, ids in zip(batch.column(0), batch.column(1), strict=True):
                held.append((doc_id.as_py(), np.frombuffer(expand(ids.as_py()), dtype=own)))
                size += len(held[-1][1])
                if size >= SEGMENT:
                    yield segment()
                    before, held, size = before + size, [], 0
        if held:
            yield segment()

    target = scratch_path(spark, "token-files")
    ordered.select("doc_id", "ids").mapInArrow(run, SEGMENT_SCHEMA).write.parquet(target)
    discard(spark, used_up)
    return TokenFiles(target, lengths)


def read_token_files(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary): from the files, ids as little-endian unsigned 32-bit integers."""
    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(files.segments)
    lengths = files.lengths

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(lengths)
        for batch in batches:
            for row in range(batch.num_rows):
                part, before, total, doc_ids, sizes, offsets, payload = (batch.column(i)[row].as_py() for i in range(7))
                ids = code.decode(payload, np.frombuffer(offsets, dtype="<u4"), total).astype("<u4")
                ends = np.cumsum(sizes)
                for at in range(0, len(sizes), ROWS):
                    cut = [(int(e - n), int(e)) for e, n in zip(ends[at : at + ROWS], sizes[at : at + ROWS], strict=True)]
                    columns = [
                        pa.array([part] * len(cut), pa.int32()),
                        pa.array(doc_ids[at : at + ROWS], pa.int64()),
                        pa.array([before + a for a, _ in cut], pa.int64()),
                        pa.array(sizes[at : at + ROWS], pa.int64()),
                        pa.array([ids[a:b].tobytes() for a, b in cut], pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["part", "doc_id", "within", "n_tokens", "ids"])

    # One row for each partition that wrote: as many as shuffle partitions, not as the input; so they are broadcast, and
    # what was decoded stays where it is.
    parts = segments.groupBy("part").agg(F.sum("total").alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    documents = segments.mapInArrow(run, "part int, doc_id long, within long, n_tokens long, ids binary")
    return documents.join(F.broadcast(stage(bases, "token-bases")), "part").select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids")
