"""Substring de-duplication: passages of words that occur anywhere else are removed, wherever they stand.

A window is a fixed number of consecutive words. Every window has an anchor, the smallest hashed run of a few words inside it, and
consecutive windows with one anchor make a passage. Equal windows have equal anchors, so only passages whose anchor
occurs again can hold repeats: one pass counts anchors, merged map-side, and a second one gathers the distinct passages that are
left, with their counts. They are the reference. It is cut into shards by anchor; each shard becomes a suffix automaton in one
task of bounded size, whose states know how often their words occur. The matching statistic of a word is the longest run of words
that ends there and occurs twice; where it reaches the window, the window's words go.

While the automata of all shards are small together (``max_bytes``, checked), they are broadcast and whole documents stream through
them. They grow with the repeated part of the corpus, so beyond that bound passages stream through the automaton of their shard in
the task that built it, and documents fetch what was found by passage.

Words are compared by 64-bit hashes, passages that are fetched by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BITMAP_BITS, SPACES, Scratch, bit_set, in_bit_set, stage, texts

#: Words of an anchor.
GRAM = 8
#: Rows that a task works on together.
ROWS = 64
#: Bits of the set of repeated anchors: so many for each, at most 64 MB in all; a full set only lets more passages through.
LOAD = 16
MAX_BITS = 1 << 29
#: Words of a shard's passages.
SHARD_WORDS = 1 << 18
#: Bytes of automata that are broadcast.
MAX_BYTES = 64 << 20
#: An anchor of more passages is split by window; a passage that stands in more places is fetched by broadcast. Of both there
#: are at most MAX_HOT: beyond so many times HOT passages, the limit is a share of all.
HOT = 2000
MAX_HOT = 1 << 20

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)  # 2^64 / golden ratio, odd
_PLACE = np.uint64((1 << 30) - 1)
_SPACE = np.isin(np.arange(256), [ord(c) for c in SPACES])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MULTIPLIER
    x = (x ^ (x >> np.uint64(29))) * _MULTIPLIER
    return x ^ (x >> np.uint64(32))


def hashed_words(octets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of every word in some bytes, which end with eight spaces or more."""
    inside = ~_SPACE[octets]
    edges = np.flatnonzero(np.diff(inside, prepend=False))
    starts, ends = edges[::2], edges[1::2]
    lengths = (ends - starts).astype(np.uint64)
    eights = np.lib.stride_tricks.as_strided(octets[: len(octets) - 7].view(np.uint8), (len(octets) - 7, 8), (1, 1))
    hashes, at, todo = _mixed(lengths), starts, np.arange(len(starts))
    while len(todo):
        part = np.ascontiguousarray(eights[at]).view("<u8").ravel()
        left = np.minimum(ends[todo] - at, 8).astype(np.uint64)
        part &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * left)
        hashes[todo] = _mixed((hashes[todo] ^ part) * _MULTIPLIER + part)
        more = ends[todo] - at > 8
        todo, at = todo[more], at[more] + 8
    return hashes, starts, ends


def grams(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` words."""
    count = max(len(words) - size + 1, 0)
    out = np.zeros(count, np.uint64)
    for i in range(size):
        out = out * _MULTIPLIER + words[i : i + count]
    return _mixed(out)


@dataclass
class Passages:
    """Runs of consecutive windows: the first window of each, how many, and their route."""

    starts: np.ndarray
    sizes: np.ndarray
    routes: np.ndarray

    def where(self, test: np.ndarray) -> Passages:
        return Passages(self.starts[test], self.sizes[test], self.routes[test])


def passages(words: np.ndarray, ends: np.ndarray, window: int, gram: int = GRAM) -> Passages:
    """All windows of some documents, whose words stand one after another and stop at ``ends``, in runs with one anchor at one
    place. Of equal grams in a window the first is the anchor, so equal windows that overlap have anchors at different
    places and stand in different runs."""
    found = grams(words, gram)
    if len(words) < window:
        return Passages(*(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64)))
    keys = found & ~_PLACE | np.arange(len(found), dtype=np.uint64)
    width, reach = window - gram + 1, 1
    while 2 * reach <= width:
        keys, reach = np.minimum(keys[:-reach], keys[reach:]), 2 * reach
    if width > reach:
        keys = np.minimum(keys[: len(keys) - (width - reach)], keys[width - reach :])
    places = (keys & _PLACE).astype(np.int64)
    # Windows that go on into the next document are none.
    last = np.repeat(ends - window, np.diff(ends, prepend=0))[: len(places)]
    places[np.arange(len(places)) > last] = -1
    starts = np.flatnonzero(np.diff(places, prepend=-1))
    sizes = np.diff(starts, append=len(places))
    real = places[starts] >= 0
    starts, sizes = starts[real], sizes[real]
    return Passages(starts, sizes, found[places[starts]])


def by_window(runs: Passages, words: np.ndarray, window: int, hot: np.ndarray) -> Passages:
    """``runs`` with those on a hot route cut into single windows, each on the route of its own hash."""
    if not len(hot):
        return runs
    split = np.isin(runs.routes, hot)
    if not split.any():
        return runs
    cut = runs.where(split)
    before = np.cumsum(cut.sizes) - cut.sizes
    starts = np.arange(int(cut.sizes.sum())) - np.repeat(before, cut.sizes) + np.repeat(cut.starts, cut.sizes)
    single = Passages(starts, np.ones(len(starts), np.int64), grams(words, window)[starts])
    rest = runs.where(~split)
    return Passages(*(np.concatenate([getattr(rest, n), getattr(single, n)]) for n in ("starts", "sizes", "routes")))


# ---------------------------------------------------------------------- automata


class Automaton:
    """A suffix automaton of several sequences, each with a number of occurrences."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def add(self, sequence: list[int], times: int) -> None:
        follow, link, length, count = self.next, self.link, self.length, self.count
        last = 0
        for word in sequence:
            at = follow[last].get(word)
            if at is not None and length[at] == length[last] + 1:
                last = at
            else:
                if at is None:
                    last, state = len(follow), last
                    follow.append({})
                    length.append(length[state] + 1)
                    count.append(0)
                    while state >= 0 and word not in follow[state]:
                        follow[state][word] = last
                        state = link[state]
                    if state < 0:
                        link.append(0)
                        count[last] += times
                        continue
                    at = follow[state][word]
                    if length[at] == length[state] + 1:
                        link.append(at)
                        count[last] += times
                        continue
                    link.append(len(follow))
                else:
                    state, last = last, len(follow)
                # ``at`` is cut in two: what is as short as the sequence so far gets a state of its own.
                own = len(follow)
                follow.append(dict(follow[at]))
                length.append(length[state] + 1)
                count.append(0)
                link.append(link[at])
                link[at] = own
                while state >= 0 and follow[state].get(word) == at:
                    follow[state][word] = own
                    state = link[state]
            count[last] += times

    def close(self) -> None:
        """Count what the states of longer runs say about the shorter ones."""
        for state in np.argsort(-np.array(self.length), kind="stable").tolist():
            if self.link[state] >= 0:
                self.count[self.link[state]] += self.count[state]

    def matches(self, sequence: list[int], window: int) -> list[int]:
        """The places where a run of ``window`` words or more ends that occurs twice."""
        follow, link, length, count = self.next, self.link, self.length, self.count
        state = size = 0
        out = []
        for place, word in enumerate(sequence):
            at = follow[state].get(word)
            while (at is None or count[at] < 2) and state:
                state = link[state]
                size = length[state]
                at = follow[state].get(word)
            if at is None or count[at] < 2:
                size = 0
                continue
            state, size = at, size + 1
            if size >= window:
                out.append(place)
        return out

    def repeated(self) -> dict[str, np.ndarray]:
        """The states of what occurs twice or more, as arrays: ``link`` and ``length`` by state (the root is 0), and the
        transitions ``state``, ``word``, ``target``."""
        kept = np.array(self.count) >= 2
        kept[0] = True
        number = np.cumsum(kept) - 1
        moves = [(s, w, t) for s in np.flatnonzero(kept).tolist() for w, t in self.next[s].items() if kept[t]]
        state, word, target = (np.array([m[i] for m in moves], np.uint64 if i == 1 else np.int64) for i in range(3))
        link = np.maximum(np.array(self.link, np.int64)[kept], 0)
        arrays = {"link": number[link], "length": np.array(self.length)[kept], "state": number[state], "target": number[target]}
        return {k: v.astype(np.int32) for k, v in arrays.items()} | {"word": word}


class Automata:
    """Automata of several shards in one set of arrays; many runs of words go through them side by side."""

    def __init__(self, parts: dict[int, dict[str, np.ndarray]]):
        sizes = [len(p["link"]) for p in parts.values()]
        before = np.cumsum([0, *sizes])[:-1]
        join = lambda name, move, kind: np.concatenate([np.zeros(0, kind), *(p[name] + (b if move else 0) for p, b in zip(parts.values(), before))])
        self.roots = dict(zip(parts, before.tolist()))
        self.link, self.length = join("link", True, np.int64), join("length", False, np.int64)
        state, word, target = join("state", True, np.int64), join("word", False, np.uint64).astype(np.uint64), join("target", True, np.int64)
        self.words = np.unique(word)
        keys = state * len(self.words) + np.searchsorted(self.words, word)
        order = np.argsort(keys)
        self.keys, self.targets = keys[order], target[order]

    def _moves(self, states: np.ndarray, words: np.ndarray) -> np.ndarray:
        keys = states * len(self.words) + words
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (words >= 0), self.targets[at], -1)

    def ends(self, words: np.ndarray, runs: Passages, window: int, shards: int) -> np.ndarray:
        """The places in ``words`` where a window ends that occurs twice."""
        if not len(self.keys) or not len(runs.starts):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        ranks = np.where(self.words[at] == words, at, -1)
        order = np.argsort(-runs.sizes, kind="stable")
        starts, sizes = runs.starts[order], runs.sizes[order] + window - 1
        roots = np.array([self.roots.get(i, -1) for i in range(shards)])[(runs.routes[order] % np.uint64(shards)).astype(np.int64)]
        starts, sizes, roots = starts[roots >= 0], sizes[roots >= 0], roots[roots >= 0]
        states, reach, out = roots.copy(), np.zeros(len(roots), np.int64), []
        for step in range(int(sizes.max(initial=0))):
            n = int(np.searchsorted(-sizes, -step, "left"))  # runs that have a word here
            word = ranks[starts[:n] + step]
            found = self._moves(states[:n], word)
            todo = np.flatnonzero((found < 0) & (states[:n] != roots[:n]))
            while len(todo):
                states[todo] = self.link[states[todo]]
                reach[todo] = self.length[states[todo]]
                found[todo] = self._moves(states[todo], word[todo])
                todo = todo[(found[todo] < 0) & (states[todo] != roots[todo])]
            hit = found >= 0
            states[:n] = np.where(hit, found, roots[:n])
            reach[:n] = np.where(hit, reach[:n] + 1, 0)
            out.append(starts[:n][reach[:n] >= window] + step)
        return np.concatenate([np.zeros(0, np.int64), *out])


# ---------------------------------------------------------------------- jobs


class Batch:
    """Some documents' words, one after another, and the passages they make."""

    def __init__(self, rows: pa.Array, window: int):
        pieces = [x.as_py() for x in rows]
        self.octets = np.frombuffer(b"\n".join([*pieces, b" " * 8]), np.uint8)
        self.words, self.starts, self.stops = hashed_words(self.octets)
        self.borders = np.cumsum([len(p) + 1 for p in pieces])  # bytes
        self.ends = np.searchsorted(self.starts, self.borders)  # words
        self.window = window
        self.runs = passages(self.words, self.ends, window)

    def candidates(self, repeated: np.ndarray, hot: np.ndarray) -> Passages:
        """The passages whose anchor may occur again."""
        slots = self.runs.routes & np.uint64(len(repeated) * 8 - 1)
        octets = repeated[(slots >> np.uint64(3)).astype(np.int64)]
        return by_window(self.runs.where((octets >> (slots & np.uint64(7)).astype(np.uint8)) & 1 > 0), self.words, self.window, hot)

    def keys(self, runs: Passages) -> np.ndarray:
        """A hash of each passage besides its route."""
        sizes = runs.sizes + self.window - 1
        keys = _mixed(sizes.astype(np.uint64))
        for step in range(int(sizes.max(initial=0))):
            on = sizes > step
            keys[on] = (keys[on] ^ self.words[runs.starts[on] + step]) * _MULTIPLIER
            keys[on] ^= keys[on] >> np.uint64(31)
        return keys

    def documents(self, runs: Passages) -> np.ndarray:
        return np.searchsorted(self.ends, runs.starts, "right")

    def covered(self, ends: np.ndarray) -> np.ndarray:
        """The words in windows that end at ``ends``."""
        change = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(change, ends - self.window + 1, 1)
        np.add.at(change, ends + 1, -1)
        return np.cumsum(change[:-1]) > 0

    def kept(self, gone: np.ndarray) -> list[bytes]:
        """Each document's other words, joined by spaces."""
        change = np.zeros(len(self.octets) + 1, np.int8)
        change[self.starts[~gone]] = 1
        change[self.stops[~gone] + 1] -= 1  # a word and the byte behind it
        mask = np.cumsum(change[:-1], dtype=np.int8) > 0
        octets = self.octets.copy()
        octets[self.stops] = 32
        out, size = octets[mask].tobytes(), np.concatenate([[0], np.cumsum(mask)])[np.concatenate([[0], self.borders])]
        return [out[low : max(high - 1, low)] for low, high in zip(size.tolist(), size[1:].tolist())]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def anchor_counts(rows: DataFrame, window: int) -> DataFrame:
    """(route, n): passages by anchor, counted in each task first, for the anchors of several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            routes, n = np.unique(Batch(part.column("octets"), window).runs.routes, return_counts=True)
            yield pa.RecordBatch.from_arrays([_signed(routes), pa.array(n)], names=["route", "n"])

    counted = rows.select("octets").mapInArrow(run, "route long, n long")
    return counted.groupBy("route").agg(F.sum("n").alias("n")).where("n > 1")


def _anchors(repeated: DataFrame, scratch: Scratch) -> np.ndarray:
    """The repeated anchors as a bit set of bounded size."""
    bits = min(MAX_BITS, max(BITMAP_BITS, 1 << (LOAD * max(repeated.count(), 1) - 1).bit_length()))
    found = scratch(bit_set(repeated, F.col("route"), bits), "passage-bits").toArrow()
    out = np.zeros(bits // 8, np.uint8)
    for bucket, bitmap in zip(found["bucket"].to_pylist(), found["bitmap"]):
        out[(bucket - 1) * BITMAP_BITS // 8 : bucket * BITMAP_BITS // 8] = np.frombuffer(bitmap.as_py(), np.uint8)
    return out


def distinct_passages(rows: DataFrame, window: int, repeated, hot) -> DataFrame:
    """(route, key, words, n): the distinct passages that may hold repeats, merged map-side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            own = Batch(part.column("octets"), window)
            runs = own.candidates(repeated.value, hot.value)
            words = [own.words[s : s + n + window - 1].tobytes() for s, n in zip(runs.starts.tolist(), runs.sizes.tolist())]
            yield pa.RecordBatch.from_arrays([_signed(runs.routes), _signed(own.keys(runs)), pa.array(words, pa.binary())], names=["route", "key", "words"])

    found = rows.select("octets").mapInArrow(run, "route long, key long, words binary")
    return found.groupBy("route", "key", "words").agg(F.count("*").alias("n"))


def _automaton(group: pa.Table) -> tuple[Automaton, list[list[int]]]:
    own = Automaton()
    sequences = [np.frombuffer(x.as_py(), np.uint64).tolist() for x in group["words"]]
    for sequence, n in zip(sequences, group["n"].to_pylist()):
        own.add(sequence, n)
    own.close()
    return own, sequences


_ARRAYS = ("link", "length", "state", "target", "word")


def shard_automata(reference: DataFrame) -> DataFrame:
    """(shard, arrays): the automaton of every shard, cut back to what occurs twice."""

    def run(group: pa.Table) -> pa.Table:
        arrays = _automaton(group)[0].repeated()
        columns = {"shard": pa.array([group["shard"][0].as_py()], pa.int32())}
        return pa.table(columns | {k: pa.array([arrays[k].tobytes()], pa.binary()) for k in _ARRAYS})

    return reference.groupBy("shard").applyInArrow(run, "shard int, " + ", ".join(f"{k} binary" for k in _ARRAYS))


def shard_matches(reference: DataFrame, window: int) -> DataFrame:
    """(route, key, n, windows): for the passages with windows that occur twice, those windows as bits, the first one lowest. A
    passage has at most as many windows as grams fit a window."""

    def run(group: pa.Table) -> pa.Table:
        own, sequences = _automaton(group)
        found = [sum(1 << (end - window + 1) for end in own.matches(x, window)) for x in sequences]
        table = group.select(["route", "key", "n"]).append_column("windows", pa.array(found, pa.int64()))
        return table.filter(pa.array([x != 0 for x in found]))

    return reference.groupBy("shard").applyInArrow(run, "route long, key long, n long, windows long")


def _occurrences(rows: DataFrame, window: int, repeated, hot) -> DataFrame:
    """(doc_id, tag, start, route, key): where the passages stand that may hold repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            own = Batch(part.column("octets"), window)
            runs = own.candidates(repeated.value, hot.value)
            document = own.documents(runs)
            start = runs.starts - np.concatenate([[0], own.ends])[document]
            ids = [part.column(c).take(pa.array(document)) for c in ("doc_id", "tag")]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(start), _signed(runs.routes), _signed(own.keys(runs))], names=["doc_id", "tag", "start", "route", "key"])

    return rows.mapInArrow(run, "doc_id long, tag long, start long, route long, key long")


RESULT = "doc_id long, n_words long, n_removed long, text string"


def _results(part: pa.RecordBatch, own: Batch, gone: np.ndarray) -> pa.RecordBatch:
    count = lambda x: pa.array(np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], own.ends])]).astype(np.int64))
    kept = pa.array(own.kept(gone), pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([part.column("doc_id"), count(np.ones(len(gone))), count(gone), kept], names=["doc_id", "n_words", "n_removed", "text"])


def _stripped(rows: DataFrame, window: int) -> DataFrame:
    """Documents without the windows of their column ``spans`` (start and windows of passages); null: none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            own, ends = Batch(part.column("octets"), window), []
            firsts = np.concatenate([[0], own.ends])
            for i, spans in enumerate(part.column("spans")):
                if spans.is_valid:
                    start, bits = (spans.values.field(n).to_numpy() for n in ("start", "windows"))
                    at, bit = np.nonzero(bits[:, None] >> np.arange(window) & 1)
                    ends.append(firsts[i] + start[at] + bit + window - 1)
            yield _results(part, own, own.covered(np.concatenate([np.zeros(0, np.int64), *ends])))

    return rows.mapInArrow(run, RESULT)


def remove_repeats(docs: DataFrame, window: int = 35, max_bytes: int = MAX_BYTES, shard_words: int = SHARD_WORDS, hot: int = HOT) -> DataFrame:
    """(doc_id, n_words, n_removed, text), a row per document: its words outside windows of ``window`` words (GRAM to 70) that
    also start anywhere else, in this document or another, joined by one space.

    Words are what stands between white space. All occurrences of a repeated window go, the first one too, and
    windows are judged on the input. Null text has no words, documents shorter than the window lose none. Rows that repeat a
    doc_id are documents of their own: rows that repeat a text, too, lose all its windows. A null doc_id is a value like any
    other. An empty table gives no rows; other columns are ignored.
    """
    if not GRAM <= window < 63 + GRAM:
        raise ValueError(f"a window has {GRAM} to {62 + GRAM} words")
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    share = spark.sparkContext.broadcast
    rows = texts(docs).select("doc_id", F.xxhash64("text").alias("tag"), F.col("text").cast("binary").alias("octets"))
    repeated = scratch(anchor_counts(rows, window), "passage-anchors")
    total = repeated.agg(F.sum("n")).first()[0] or 0
    limit = max(hot, total // MAX_HOT)
    routes = repeated.where(F.col("n") > limit).select("route").toArrow()["route"].to_numpy().view(np.uint64)
    anchors, routes = share(_anchors(repeated, scratch)), share(np.sort(routes))
    merged = scratch(distinct_passages(rows, window, anchors, routes), "passages")
    words = merged.agg(F.sum(F.octet_length("words")) / 8).first()[0] or 0
    shards = max(1, int(-(-words // shard_words)))
    # As unsigned numbers, as the workers deal them.
    shard = F.pmod(F.pmod(F.shiftrightunsigned("route", 1), F.lit(shards)) * 2 + F.col("route").bitwiseAND(F.lit(1)), F.lit(shards))
    reference = merged.withColumn("shard", shard.cast("int"))
    if 64 * words <= max_bytes:  # a word makes at most two states and three transitions
        found = shard_automata(reference).toArrow().to_pylist()
        kinds = {k: np.uint64 if k == "word" else np.int32 for k in _ARRAYS}
        automata = share(Automata({r["shard"]: {k: np.frombuffer(r[k], kinds[k]) for k in _ARRAYS} for r in found}))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in _parts(batches):
                own = Batch(part.column("octets"), window)
                runs = own.candidates(anchors.value, routes.value)
                yield _results(part, own, own.covered(automata.value.ends(own.words, runs, window, shards)))

        scratch.clear()
        return rows.mapInArrow(run, RESULT)

    matches = scratch(shard_matches(reference, window), "passage-matches")
    places = scratch(_occurrences(rows, window, anchors, routes), "passage-places")
    key = ["route", "key"]
    often = F.broadcast(matches.where(F.col("n") > limit).select(*key, "windows"))
    direct = places.join(often, key, "left")
    rest = direct.where("windows IS NULL").drop("windows").join(matches.where(F.col("n") <= limit).select(*key, "windows"), key)
    hits = direct.where("windows IS NOT NULL").select("doc_id", "tag", "start", "windows").unionByName(rest.select("doc_id", "tag", "start", "windows"))
    # Spans of a document are as many as its passages; rows that repeat a document bring theirs once more.
    spans = stage(hits.distinct().groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "windows")).alias("spans")), "passage-spans")
    bits = max(BITMAP_BITS, min(MAX_BITS, 1 << (LOAD * max(spans.count(), 1) - 1).bit_length()))
    filled = stage(bit_set(spans, F.col("tag"), bits), "passage-documents")
    scratch.clear()
    # Documents that lose nothing stay where they are.
    tested = in_bit_set(rows, filled, F.col("tag"), bits, "maybe")
    losing = tested.where("maybe").alias("d").join(
        spans.alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.tag") == F.col("s.tag")), "left"
    )
    empty = F.lit(None).cast(spans.schema["spans"].dataType).alias("spans")
    rest = tested.where("not maybe").select("doc_id", "octets", empty)
    return _stripped(losing.select("d.doc_id", "d.octets", "s.spans").unionByName(rest), window)
