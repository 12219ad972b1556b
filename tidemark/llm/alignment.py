"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

Tokens and bytes form an incidence matrix A (tokens of the first tokenizer by bytes) and B (tokens of the second by bytes),
both in CSR form. The product A·Bᵀ, taken row by row, has an entry for every pair of tokens that overlap: the bytes they
share. Byte offsets where tokens of both end cut a text into groups; the product of the group incidences has an entry for every
pair of tokens that share a group.

Texts are tokenized once, in pieces: a cut at a space that follows no other white space is a token end of both, so a worker keeps
the ids of pieces that it has seen. A portion of texts becomes the dictionary of its distinct pieces and a number for each
occurrence; only the dictionary is looked up, tokenized and compared byte for byte, occurrences are gathered. From the stored ids one pass counts linked id pairs, summed in each task first, and a
second one adds up each document's links; there are never more pairs than the product of the vocabularies, whatever the corpus.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, stage, texts
from tidemark.llm.tokens import MAX_WORDS, Kept, byte_letters, portions, ranges, strings, sums
from tidemark.llm.tokens import Pieces as Words

#: Pieces and their tokens that a worker keeps; beyond, its cache starts again.
MAX_PIECES = 500_000
MAX_TOKENS = 8_000_000
#: Bytes of the texts that are cut together (a longer text is alone), and pieces that go to a library in one text.
PORTION = 1 << 20
TOGETHER = 4096
#: Distinct id pairs that a task counts before it hands them on.
MAX_COUNTED = 1_000_000
#: Rows that a task works on together.
ROWS = 64
#: Counted pairs that are broadcast at once (17 bytes each).
MAX_PAIRS = 2_000_000
#: Bytes and products of matrices that are expanded together.
BLOCK = 1 << 20

#: White space as Python has it; a text with some of it in front of a space is not cut at every space.
_WHITE = r"\t-\r\x1c-\x20\x{85}\p{Z}"
_ODD = f"^ |[{_WHITE}] "
_CUT = re.compile(r"(?<=\S)(?= )")
#: Pieces that can be told apart again in one text.
_PLAIN = rf"^ [^{_WHITE}▁\x00]+$"


# ---------------------------------------------------------------------- sparse matrices


@dataclass
class Csr:
    """A sparse matrix by rows: row i has ``columns[starts[i]:starts[i + 1]]`` with ``values`` beside them."""

    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int

    @property
    def height(self) -> int:
        return len(self.starts) - 1

    def times(self, vector: np.ndarray) -> np.ndarray:
        """The product with a vector."""
        summed = np.concatenate([[0], np.cumsum(self.values * vector[self.columns])])
        return summed[self.starts[1:]] - summed[self.starts[:-1]]

    def product(self, other: Csr, block: int = BLOCK) -> Csr:
        """self · other, row by row: a row is the sum of the rows of ``other`` that its entries name. Rows are taken
        together up to ``block`` products, and one row at least."""
        sizes = np.diff(other.starts)[self.columns]
        done = np.concatenate([[0], np.cumsum(sizes)])[self.starts]
        parts, row = [], 0
        while row < self.height:
            end = max(row + 1, int(np.searchsorted(done, done[row] + block, "right")) - 1)
            parts.append(self._rows(other, row, end, sizes))
            row = end
        counts, columns, values = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*parts) if parts else ((), (), ())))
        return Csr(np.concatenate([[0], np.cumsum(counts)]).astype(np.int64), columns, values, other.width)

    def _rows(self, other: Csr, row: int, end: int, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        low, high = self.starts[row], self.starts[end]
        size, at, values = sizes[low:high], other.starts[self.columns[low:high]], self.values[low:high]
        own = np.repeat(np.arange(end - row), np.diff(self.starts[row : end + 1]))
        if np.any(size != 1):  # else every entry has one product, in its place
            at = np.arange(int(size.sum())) + np.repeat(at - (np.cumsum(size) - size), size)
            own, values = np.repeat(own, size), np.repeat(values, size)
        columns, values = other.columns[at], values * other.values[at]
        keys = own * other.width + columns
        if np.any(keys[1:] < keys[:-1]):
            order = np.argsort(keys, kind="stable")
            keys, own, columns, values = keys[order], own[order], columns[order], values[order]
        firsts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        firsts = np.concatenate([np.zeros(min(len(keys), 1), np.int64), firsts])
        values = np.add.reduceat(values, firsts) if len(firsts) else values
        return np.bincount(own[firsts], minlength=end - row), columns[firsts], values

    def rows(self) -> np.ndarray:
        """The row of every entry."""
        return np.repeat(np.arange(self.height), np.diff(self.starts))


def token_bytes(sizes: np.ndarray) -> Csr:
    """Tokens by the bytes that they cover one after another."""
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return Csr(ends, np.arange(ends[-1]), np.ones(ends[-1], np.int64), int(ends[-1]))


def bytes_of(sizes: np.ndarray) -> Csr:
    """The transpose: bytes by the one token that covers each."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return Csr(np.arange(len(owner) + 1), owner, np.ones(len(owner), np.int64), len(sizes))


def memberships(groups: np.ndarray, count: int) -> Csr:
    """Tokens by the group that each lies in."""
    return Csr(np.arange(len(groups) + 1), groups, np.ones(len(groups), np.int64), count)


def members(groups: np.ndarray, count: int) -> Csr:
    """The transpose: groups by their tokens, which stand in order."""
    starts = np.concatenate([[0], np.cumsum(np.bincount(groups, minlength=count))]).astype(np.int64)
    return Csr(starts, np.arange(len(groups)), np.ones(len(groups), np.int64), len(groups))


@dataclass
class Alignment:
    """Tokens of two tokenizers over the same bytes: overlap links, and the group of every token."""

    overlap: Csr
    groups_a: np.ndarray
    groups_b: np.ndarray
    count: int

    def shared(self, block: int = BLOCK) -> Csr:
        """Links of tokens that share a group. It grows with the square of a group's size."""
        return memberships(self.groups_a, self.count).product(members(self.groups_b, self.count), block)

    def shared_sizes(self) -> np.ndarray:
        """How many shared-group links each token of the first tokenizer has, without making them."""
        return memberships(self.groups_a, self.count).times(np.diff(members(self.groups_b, self.count).starts))


def align(sizes_a: np.ndarray, sizes_b: np.ndarray, block: int = BLOCK) -> Alignment:
    """From the bytes of each token; both sum to the same. Incidences are made for about ``block`` bytes at a time, which end
    with a group, as no link goes on behind it."""
    ends_a, ends_b = np.cumsum(sizes_a), np.cumsum(sizes_b)
    common = np.intersect1d(ends_a, ends_b, assume_unique=True)
    groups_a, groups_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
    counts, columns, values, done = [], [], [], 0
    while done < len(common):
        before = int(common[done - 1]) if done else 0
        end = max(done + 1, int(np.searchsorted(common, before + block, "right")))
        (low_a, high_a), (low_b, high_b) = (np.searchsorted(g, [done, end]) for g in (groups_a, groups_b))
        part = token_bytes(sizes_a[low_a:high_a]).product(bytes_of(sizes_b[low_b:high_b]), block)
        counts.append(np.diff(part.starts))
        columns.append(part.columns + low_b)
        values.append(part.values)
        done = end
    counts, columns, values = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (counts, columns, values))
    overlap = Csr(np.concatenate([[0], np.cumsum(counts)]).astype(np.int64), columns, values, len(sizes_b))
    return Alignment(overlap, groups_a, groups_b, len(common))


# ---------------------------------------------------------------------- tokens


class ByteTokens:
    """A byte-level vocabulary of the tokenizers library; strings of special tokens are plain text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        octets = {letter: byte for byte, letter in byte_letters().items()}
        names = {i: t for t, i in self.library.get_vocab().items()}
        self.bytes = [bytes(octets[c] for c in names.get(i, "") if c in octets) for i in range(max(names, default=-1) + 1)]
        #: Words are only known for the plain byte-level rule, and for vocabularies without words of their own beside the model.
        rule = json.loads(self.library.to_str())["pre_tokenizer"] or {}
        usual = rule.get("type") == "ByteLevel" and rule.get("use_regex", True) and not rule.get("add_prefix_space")
        added = self.library.get_added_tokens_decoder().values()
        usual = usual and self.library.normalizer is None and all(t.special for t in added)
        self.words = Words(path, self.library) if usual else None

    def clear(self) -> None:
        if self.words is not None:
            self.words.words = Kept(MAX_WORDS)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts that begin with the space that every text gets."""
        return [x.ids for x in self.library.encode_batch(texts, add_special_tokens=False)]

    def dictionary(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray] | None:
        """(ids of some pieces one after another, how many each has), by the words in them."""
        if self.words is None:
            return None
        ids, (starts, stops) = self.words.dictionary(pieces)
        sizes = stops - starts
        return ranges(starts, sizes, sums(sizes), ids), sizes


class PieceTokens:
    """A sentencepiece vocabulary with byte fallback, which puts a space in front of every text itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = own = SentencePieceProcessor(model_file=path)
        names = [own.id_to_piece(i) for i in range(own.get_piece_size())]
        self.bytes = [bytes([int(n[3:5], 16)]) if own.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.space = own.piece_to_id("▁")
        #: A vocabulary with spaces inside its pieces could join what a cut parts.
        self.cuts = not any("▁" in n.lstrip("▁") for n in names)

    def clear(self) -> None:
        pass

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [x or [self.space] for x in self.library.encode([t[1:] for t in texts], num_threads=1)]

    def dictionary(self, pieces: pa.Array) -> None:
        """There are no words to take together: pieces are encoded as texts."""
        return None


class Side:
    """One tokenizer's part of a worker's cache."""

    def __init__(self, tokens: ByteTokens | PieceTokens):
        self.tokens = tokens
        self.sizes = np.array([len(x) for x in tokens.bytes], np.int64)
        self.octets = np.frombuffer(b"".join(tokens.bytes), np.uint8)
        self.places = np.cumsum(self.sizes) - self.sizes
        self.opens = np.array([x[:1] == b" " for x in tokens.bytes])
        self.kind = np.dtype("<u2" if len(tokens.bytes) <= 1 << 16 else "<u4")
        self.clear()

    def clear(self) -> None:
        self.ids, self.starts = np.zeros(0, self.kind), np.zeros(1, np.int64)

    def add(self, pieces: pa.Array) -> np.ndarray:
        """Keep the ids of some new pieces; for each, does it come back byte for byte?"""
        ids, sizes = self.tokens.dictionary(pieces) or self.encoded(pieces)
        self.ids = np.concatenate([self.ids, ids.astype(self.kind)])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        wanted = pc.binary_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64)
        good = np.diff(sums(self.sizes[ids])[sums(sizes)]) == wanted
        text = np.frombuffer("".join(strings(pieces.filter(pa.array(good)))).encode(), np.uint8)
        wrong = np.flatnonzero(self.written(ids[np.repeat(good, sizes)]) != text)
        own = np.flatnonzero(good)
        good[own[np.searchsorted(np.cumsum(wanted[own]), wrong, "right")]] = False
        return good

    def encoded(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``dictionary``. Plain pieces go to the library many in one text: each begins with its only space."""
        plain = pc.match_substring_regex(pieces, _PLAIN).to_numpy(zero_copy_only=False)
        parts, sizes = [np.zeros(0, np.int64)], np.zeros(len(pieces), np.int64)
        names, places = strings(pieces.filter(pa.array(plain))), np.flatnonzero(plain)
        for at in range(0, len(names), TOGETHER):
            cut = names[at : at + TOGETHER]
            parts.append(np.array(self.tokens.encode(["".join(cut)])[0], np.int64))
            first = np.flatnonzero(self.opens[parts[-1]])
            if len(first) != len(cut) or first[:1].any():
                raise ValueError("a token crosses a cut")
            sizes[places[at : at + TOGETHER]] = np.diff(first, append=len(parts[-1]))
        rest = self.tokens.encode(strings(pieces.filter(pa.array(~plain))))
        sizes[~plain] = [len(x) for x in rest]
        found = np.concatenate([*parts, np.array([i for x in rest for i in x], np.int64)])
        order = np.concatenate([places, np.flatnonzero(~plain)])
        starts = np.zeros(len(pieces), np.int64)
        starts[order] = np.cumsum(sizes[order]) - sizes[order]
        return ranges(starts, sizes, sums(sizes), found), sizes

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of these pieces one after another, where each one's begin and the last one's end)."""
        sizes = self.starts[rows + 1] - self.starts[rows]
        ends = sums(sizes)
        return ranges(self.starts[rows], sizes, ends, self.ids), ends

    def written(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of some tokens."""
        return ranges(self.places[ids], self.sizes[ids], sums(self.sizes[ids]), self.octets)


class Pieces:
    """Pieces met so far, by number, with their ids."""

    def __init__(self, path_a: str, path_b: str):
        self.sides = Side(ByteTokens(path_a)), Side(PieceTokens(path_b))
        self.cuts = self.sides[1].tokens.cuts
        self.drop()

    def full(self) -> bool:
        return len(self.index) > MAX_PIECES or len(self.sides[0].ids) > MAX_TOKENS

    def drop(self) -> None:
        """Forget the pieces, but not the words in them."""
        self.index: dict[str, int] = {}
        self.good = np.zeros(0, bool)
        for side in self.sides:
            side.clear()

    def clear(self) -> None:
        self.drop()
        for side in self.sides:
            side.tokens.clear()

    def cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """Texts with a space in front, in pieces that begin with one each: (distinct pieces, the number of every occurrence,
        where each text's occurrences begin, where they end). Those of texts that are not cut at every space stand last."""
        filled = pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0
        odd = filled & (pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False) | (not self.cuts))
        even = filled & ~odd
        parts = pc.split_pattern(texts.filter(pa.array(even)), " ")
        rest = [_CUT.split(" " + t) if self.cuts else [" " + t] for t in strings(texts.filter(pa.array(odd)))]
        counts = np.zeros(len(texts), np.int64)
        counts[even] = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
        counts[odd] = [len(x) for x in rest]
        order = np.concatenate([np.flatnonzero(even), np.flatnonzero(odd)])
        ends = np.zeros(len(texts), np.int64)
        ends[order] = np.cumsum(counts[order])
        behind = pa.array([p[1:] for x in rest for p in x], pa.string())
        coded = pa.concat_arrays([parts.flatten(), behind]).dictionary_encode()
        return pc.binary_join_element_wise(" ", coded.dictionary, ""), coded.indices.to_numpy(), ends - counts, ends

    def rows(self, pieces: pa.Array) -> np.ndarray:
        """The numbers of distinct pieces; new ones are tokenized."""
        names = strings(pieces)
        rows = np.fromiter((self.index.get(n, -1) for n in names), np.int64, len(names))
        new = np.flatnonzero(rows < 0)
        if len(new):
            rows[new] = np.arange(len(self.index), len(self.index) + len(new))
            fresh = pieces.take(pa.array(new))
            self.good = np.concatenate([self.good, np.logical_and(*(side.add(fresh) for side in self.sides))])
            self.index.update(zip(map(names.__getitem__, new.tolist()), rows[new].tolist()))
        return rows

    def tokens(self, texts: pa.Array | list[str | None]) -> list[tuple[bytes, bytes]]:
        """Each text's ids by both tokenizers; none if one does not give the text back byte for byte."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        pieces, codes, low, high = self.cut(texts)
        rows = self.rows(pieces)[codes]
        # Pieces that come back are enough; where one does not, the whole text decides.
        wrong = sums(~self.good[rows])
        doubtful, kept = np.flatnonzero(wrong[high] > wrong[low]).tolist(), []
        gone = set()
        for side in self.sides:
            ids, ends = side.of(rows)
            starts, stops = ends[low].tolist(), ends[high].tolist()
            gone.update(i for i in doubtful if side.written(ids[starts[i] : stops[i]]).tobytes() != b" " + texts[i].as_py().encode())
            kept.append([ids[a:b].tobytes() for a, b in zip(starts, stops)])
        return [(b"", b"") if i in gone else both for i, both in enumerate(zip(*kept))]


@functools.lru_cache(maxsize=2)
def _pieces(path_a: str, path_b: str) -> Pieces:
    return Pieces(path_a, path_b)


# ---------------------------------------------------------------------- jobs


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def tokenize(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, a, b): the ids of both tokenizers, packed; empty for texts without tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _pieces(path_a, path_b)
        for batch in batches:
            for part in portions(batch, 1, PORTION):
                a, b = zip(*own.tokens(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["doc_id", "a", "b"])
                if own.full():
                    own.drop()
        own.clear()

    return texts(docs).mapInArrow(run, "doc_id long, a binary, b binary")


class Documents:
    """Some documents' tokens one after another, aligned."""

    def __init__(self, part: pa.RecordBatch, sides: tuple[Side, Side]):
        packed = [part.column(name).to_pylist() for name in ("a", "b")]
        self.ids = [np.frombuffer(b"".join(x), s.kind).astype(np.int64) for x, s in zip(packed, sides)]
        self.counts = [np.array([len(y) // s.kind.itemsize for y in x], np.int64) for x, s in zip(packed, sides)]
        self.found = align(*(s.sizes[i] for s, i in zip(sides, self.ids)))
        self.first = self.found.overlap.rows()
        self.codes = self.ids[0][self.first] << 32 | self.ids[1][self.found.overlap.columns]

    def sums(self, values: np.ndarray) -> np.ndarray:
        """By document, of values by token of A."""
        return _between(values, np.concatenate([[0], np.cumsum(self.counts[0])]))

    def links(self, values: np.ndarray) -> np.ndarray:
        """By token of A, of values by link."""
        return _between(values, self.found.overlap.starts)

    def written(self, names: pa.Array) -> pa.Array:
        """Every document's groups as ``a1,a2|b1;a3|b2,b3``; ``names`` has each id with ``,``, ``|``, ``;`` and nothing behind."""
        groups, count = (self.found.groups_a, self.found.groups_b), self.found.count
        ends = [sums(np.bincount(g, minlength=count))[1:] for g in groups]
        size = len(groups[0]) + len(groups[1])
        # A group's tokens of A stand behind all tokens of the groups before, its tokens of B behind those of A.
        places = [np.arange(len(groups[0])) + np.concatenate([[0], ends[1]])[groups[0]], np.arange(len(groups[1])) + ends[0][groups[1]]]
        at = np.empty(size, np.int64)
        for place, ids in zip(places, self.ids):
            at[place] = ids * 4
        last = ends[0] + ends[1] - 1
        at[places[0][ends[0] - 1]] += 1
        at[last] += 2
        until = sums(self.counts[0] + self.counts[1])
        at[until[1:][np.diff(until) > 0] - 1] += 1
        text = names.take(pa.array(at))
        starts = np.frombuffer(text.buffers()[1], np.int64, size + 1)[until] if size else until
        return pa.Array.from_buffers(pa.large_string(), len(until) - 1, [None, pa.py_buffer(starts.tobytes()), text.buffers()[2]]).cast(pa.string())


def _between(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    summed = np.concatenate([[0], np.cumsum(values)])
    return summed[starts[1:]] - summed[starts[:-1]]


def pair_counts(tokens: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(a, b, n): for every pair of ids that is linked anywhere, the links that hold it in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, held, size = _pieces(path_a, path_b).sides, [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            codes, where = np.unique(np.concatenate([np.zeros(0, np.int64), *(c for c, _ in held)]), return_inverse=True)
            return codes, np.bincount(where, weights=np.concatenate([np.zeros(0), *(n for _, n in held)]), minlength=len(codes))

        def record(codes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (codes >> 32, codes & 0xFFFFFFFF, n.astype(np.int64))], names=["a", "b", "n"])

        for part in _parts(batches):
            held.append(np.unique(Documents(part, sides).codes, return_counts=True))
            size += len(held[-1][0])
            if size > MAX_COUNTED:
                held = [merged()]
                size = len(held[0][0])
                if 2 * size > MAX_COUNTED:
                    yield record(*held[0])
                    held, size = [], 0
        yield record(*merged())

    return tokens.select("a", "b").mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_shared long, n_best long, count_sum long, groups string"


def align_tokens(docs: DataFrame, path_a: str, path_b: str, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """A row per document: tokens of both tokenizers, groups, overlap links, shared-group links (``n_shared``), links whose pair
    is the most frequent of its second id (``n_best``, ties included), the sum of the links' pair counts, and the groups
    written out: ids of a group's tokens of A, ``|``, of B, groups joined by ``;``.

    Both tokenizers see a space and the text. Texts that are null, empty, or that either tokenizer does not give back byte for byte
    have no tokens: zeros and ''. Rows that repeat a doc_id are documents of their own and counted each; a null doc_id is
    a value like any other. An empty table gives no rows; other columns are ignored. Pair counts are broadcast
    ``max_pairs`` at a time: vocabularies bound their number, so there are few rounds at any size of the corpus.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    rows = stage(tokenize(docs, path_a, path_b), "alignment-tokens")
    counts = scratch(pair_counts(rows, path_a, path_b), "alignment-pairs")
    highest = F.max("n").over(Window.partitionBy("b"))
    rated = scratch(counts.withColumn("best", (F.col("n") == highest).cast("long")), "alignment-rated")
    rounds = max(1, -(-rated.count() // max_pairs))
    for number in range(rounds):
        part = rated.where(F.pmod(F.xxhash64("a", "b"), F.lit(rounds)) == number).toArrow()
        codes = part["a"].to_numpy() << 32 | part["b"].to_numpy()
        order = np.argsort(codes)
        known = spark.sparkContext.broadcast((codes[order], part["n"].to_numpy()[order], part["best"].to_numpy()[order]))
        last = number == rounds - 1
        # Sums of a round that is not the last are written with their tokens, so that nothing is joined.
        found = rows.mapInArrow(_summed(path_a, path_b, known, number > 0, last), SCHEMA if last else f"{SCHEMA}, a binary, b binary")
        rows = found if last else stage(found, "alignment-round")
    scratch.clear()
    return rows


def _summed(path_a: str, path_b: str, known, more: bool, last: bool):
    columns = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _pieces(path_a, path_b).sides
        pairs, counts, best = known.value
        names = pa.array([f"{i}{mark}" for i in range(max(len(s.sizes) for s in sides)) for mark in (",", "|", ";", "")], pa.large_string())
        for part in _parts(batches):
            own = Documents(part, sides)
            codes, where = np.unique(own.codes, return_inverse=True)
            at = np.minimum(np.searchsorted(pairs, codes), max(len(pairs) - 1, 0))
            hit = pairs[at] == codes if len(pairs) else np.zeros(len(codes), bool)
            n_best, count_sum = (own.sums(own.links(np.where(hit, x[at] if len(x) else 0, 0)[where])) for x in (best, counts))
            if more:  # what earlier rounds have found
                n_best, count_sum = n_best + part.column("n_best").to_numpy(), count_sum + part.column("count_sum").to_numpy()
            opens = np.diff(own.found.groups_a, prepend=-1) > 0
            found = (*own.counts, own.sums(opens), own.sums(np.diff(own.found.overlap.starts)), own.sums(own.found.shared_sizes()), n_best, count_sum)
            groups = own.written(names) if last else pa.array([""] * part.num_rows, pa.string())
            arrays = [part.column("doc_id"), *(pa.array(x.astype(np.int64)) for x in found), groups]
            arrays += [] if last else [part.column("a"), part.column("b")]
            yield pa.RecordBatch.from_arrays(arrays, names=columns + ["a", "b"] * (not last))

    return run


def token_links(docs: DataFrame, path_a: str, path_b: str, shared: bool = False) -> DataFrame:
    """(doc_id, a, b, weight): every link of every document, tokens by their places in it. ``weight`` is the bytes that the two
    tokens share. With ``shared``, the links are those of tokens in one group, and ``weight`` is 1; they come row block by row block.
    Texts without tokens have no rows; else as ``align_tokens``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _pieces(path_a, path_b).sides
        for batch in batches:
            for row in range(batch.num_rows):
                part = batch.slice(row, 1)
                found = Documents(part, sides).found
                links = found.shared() if shared else found.overlap
                first = links.rows()
                for low in range(0, len(first), ROWS * 1024):
                    cut = slice(low, low + ROWS * 1024)
                    columns = [first[cut], links.columns[cut], links.values[cut]]
                    owner = part.column("doc_id").take(pa.array([0] * len(columns[0])))
                    yield pa.RecordBatch.from_arrays([owner, *map(pa.array, columns)], names=["doc_id", "a", "b", "weight"])

    return tokenize(docs, path_a, path_b).mapInArrow(run, "doc_id long, a long, b long, weight long")
