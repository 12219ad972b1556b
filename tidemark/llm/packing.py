"""Hierarchical multi-length packing of token sequences.

Documents are cut into full windows of the longest context; what is left over is routed to the shortest tier that holds
it. Each tier is packed from the longest down: the gap of a window is filled with the longest left-overs that fit, and what
no left-over fits is closed by cutting one. Windows end full, so nothing is padded but a last one, which is cut into powers of
two. Sequences are then dealt to step groups of even size. All of this happens where the documents are: a task packs
pools of bounded size and nothing is shuffled.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidemark.llm.common import texts
from tidemark.llm.tokens import pieces, portions

TIERS = (256, 512, 1024, 2048)
#: Tokens of a pool, and of a step group.
POOL = 1 << 20
STEP = 1 << 15

Piece = tuple[int, int, int]  # (document of the pool, start, length)


class Shelf:
    """Left-over pieces by length; a bit for every length there is."""

    def __init__(self):
        self.rows: dict[int, list[Piece]] = {}
        self.lengths = 0

    def put(self, piece: Piece) -> None:
        self.rows.setdefault(piece[2], []).append(piece)
        self.lengths |= 1 << piece[2]

    def take(self, length: int) -> Piece:
        found = self.rows[length].pop()
        if not self.rows[length]:
            self.lengths ^= 1 << length
        return found

    def longest(self, most: int) -> int:
        """The greatest length up to ``most``, 0 if there is none."""
        return (self.lengths & ((1 << (most + 1)) - 1)).bit_length() - 1 if self.lengths & ((1 << (most + 1)) - 1) else 0

    def shortest(self, above: int) -> int:
        higher = self.lengths >> (above + 1)
        return above + (higher & -higher).bit_length() if higher else 0


def pack_pool(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[Piece]]:
    """Sequences of pieces of these documents: every token once, each sequence a tier or another power of two long."""
    tiers = tuple(sorted(tiers))
    top, shelf, out = tiers[-1], Shelf(), []
    for document, length in enumerate(lengths):
        full = length // top
        out += [[(document, i * top, top)] for i in range(full)]
        if length % top:
            shelf.put((document, full * top, length % top))
    for below, tier in reversed(list(zip((0, *tiers), tiers, strict=False))):
        while (length := shelf.longest(tier)) > below:
            window, gap = [shelf.take(length)], tier - length
            while gap and (length := shelf.longest(gap) or shelf.shortest(gap)):
                document, start, size = shelf.take(length)
                if size > gap:
                    shelf.put((document, start + gap, size - gap))
                window.append((document, start, min(size, gap)))
                gap -= min(size, gap)
            out += [window] if not gap else powers(window)
    return out


def powers(window: list[Piece]) -> list[list[Piece]]:
    """A window that stayed short, cut into sequences as long as the powers of two that its length is made of."""
    total, out, rest = sum(p[2] for p in window), [], list(window)
    for bit in reversed(range(total.bit_length())):
        if not total >> bit & 1:
            continue
        room, sequence = 1 << bit, []
        while room:
            document, start, size = rest[0]
            part = min(size, room)
            sequence.append((document, start, part))
            rest[:1] = [(document, start + part, size - part)] if size > part else []
            room -= part
        out.append(sequence)
    return out


def step_groups(sizes: list[int], step: int = STEP) -> list[int]:
    """A group for each sequence: the longest first, each to the group with the fewest tokens so far."""
    count = max(1, round(sum(sizes) / step))
    heap, groups = [(0, g) for g in range(count)], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        load, group = heapq.heappop(heap)
        groups[i] = group
        heapq.heappush(heap, (load + sizes[i], group))
    return groups


SCHEMA = (
    "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, "
    "step_group long, ids binary"
)


def pack(docs: DataFrame, path: str, end_id: int = 1, tiers: tuple[int, ...] = TIERS, pool: int = POOL) -> DataFrame:
    """A row per piece: where it comes from (doc_id, start, length of doc_tokens), where it lies (sequence_id, offset
    of sequence_tokens), its step group, and its ids as little-endian unsigned 32-bit integers.

    A document is its ids by the tokenizers library with the file ``path``, then ``end_id``; null and empty texts are the
    end id alone. Rows that repeat a doc_id are documents of their own. Sequences are full windows of a tier; the last
    ones of a pool are powers of two. ``sequence_id`` and ``step_group`` count within a task's partition, so a task
    that runs again gives the same numbers. An empty table gives no rows; other columns are ignored.
    """

    def flush(part: int, first: tuple[int, int], held: list[tuple[int, np.ndarray]]) -> tuple[pa.RecordBatch, tuple[int, int]]:
        sequences = pack_pool([len(ids) for _, ids in held], tiers)
        sizes = [sum(p[2] for p in s) for s in sequences]
        groups, columns = step_groups(sizes), [[] for _ in range(9)]
        for number, (sequence, size, group) in enumerate(zip(sequences, sizes, groups, strict=True)):
            offset = 0
            for document, start, length in sequence:
                doc_id, ids = held[document]
                row = (doc_id, start, length, len(ids), part << 40 | first[0] + number, offset, size, part << 40 | first[1] + group)
                for column, value in zip(columns, (*row, ids[start : start + length].astype("<u4").tobytes()), strict=True):
                    column.append(value)
                offset += length
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        arrays = [pa.array(c, pa.binary() if n == "ids" else pa.int64()) for c, n in zip(columns, names, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=names), (first[0] + len(sequences), first[1] + max(groups) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = pieces(path), TaskContext.get().partitionId()
        end, first, held, size = np.array([end_id], dtype=own.type), (0, 0), [], 0
        for batch in batches:
            for rows in portions(batch, 1):
                for doc_id, ids in zip(rows.column(0).to_pylist(), own.batch(rows.column(1)), strict=True):
                    held.append((doc_id, np.concatenate([ids, end])))
                    size += len(held[-1][1])
                    if size >= pool:
                        packed, first = flush(part, first, held)
                        yield packed
                        held, size = [], 0
        if held:
            yield flush(part, first, held)[0]

    return texts(docs).mapInArrow(run, SCHEMA)
