"""Byte-pair encoding and decoding of whole texts by prefix sharing.

The distinct new words of a batch form a trie. Walking it depth first, every node gets the last token of its prefix's
encoding: the one token that ends there and that follows the last token of the prefix before it as a pair that merging
would leave alone. Encodings are local in that sense, so a prefix that many words share is encoded once, and a word's ids
are read off the states on its path. No word is ever merged from scratch.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import texts
from tidemark.llm.tokens import Kept, Pieces, portions

MAX_PAIRS = 500_000
#: Letters of a path after which a state is found in any case.
DEEP = 64


class Trie:
    """Words in byte letters -> ids, for vocabularies with merges in order of rank."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        #: A token's age: letters first, then merges by rank. ``parts`` has the two ages that an age was merged from.
        made = {a + b for a, b in merges}
        ages = {i: age for age, i in enumerate(i for t, i in self.ids.items() if t not in made)}
        letters = len(ages)
        self.parts: list[tuple[int, int]] = [(age, age) for age in range(letters)]
        self.made: dict[tuple[int, int], int] = {}
        for age, (a, b) in enumerate(merges, start=letters):
            self.parts.append((ages[self.ids[a]], ages[self.ids[b]]))
            self.made[self.parts[-1]] = age
            ages[self.ids[a + b]] = age
        self.ages = ages
        self.longest = max(map(len, self.ids))
        #: How long the tokens are that end with two letters, longest first; with the end of a word, and without.
        self.sizes: dict = {}
        for text in self.ids:
            end = self.end if self.end and text.endswith(self.end) and len(text) > len(self.end) else ""
            letters = text[: len(text) - len(end)]
            self.sizes.setdefault((letters[-2:], end), set()).add(len(letters))
        self.sizes = {key: sorted(found, reverse=True) for key, found in self.sizes.items()}
        self.pairs = Kept(MAX_PAIRS, lambda pair: self.stays(ages[pair[0]], ages[pair[1]]))
        self.whole = Kept(len(self.ids) + 1, lambda token: self.reachable(ages[token]))

    def reachable(self, age: int) -> bool:
        """Does merging a token's own letters give the token?"""
        left, right = self.parts[age]
        return left == right == age or (self.reachable(left) and self.reachable(right) and self.stays(left, right, age))

    def stays(self, left: int, right: int, until: int | None = None) -> bool:
        """Would merging leave these two side by side (until a merge of that age is done)?

        Merges are undone from the youngest on. At each step the two tokens at the seam must not have been merged
        before the merge that was undone last.
        """
        limit = len(self.parts) if until is None else until
        while True:
            if self.made.get((left, right), limit) < limit:
                return False
            whole_left, whole_right = self.parts[left][1] == left, self.parts[right][0] == right
            if whole_left and whole_right:
                return True
            # Of equal merges the left one comes first, so a right one of the same age is undone first.
            if whole_right or (not whole_left and left > right):
                limit, left = left, self.parts[left][1]
            else:
                limit, right = right + 1, self.parts[right][0]

    def last_token(self, path: list[str], depth: int, states: list[tuple[int, int] | None], end: str) -> tuple[int, int]:
        """(token, depth where it starts): the last token of the prefix of ``depth`` letters. States further up the path
        are found when they are first asked for, and then stay for every word below."""
        tail = "".join(path[max(0, depth - self.longest) : depth])
        for size in (*self.sizes.get((tail[-2:], end), ()), 1):
            token = self.ids.get(tail[-size:] + end) if size <= len(tail) else None
            if token is not None and self.whole[token]:
                start = depth - size
                if start == 0:
                    return token, 0
                if states[start] is None:
                    states[start] = self.last_token(path, start, states, "")
                if self.pairs[states[start][0], token]:
                    return token, start
        raise ValueError(f"no token ends at {tail!r}: the vocabulary does not cover it")

    def encode(self, words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        root: dict = {}
        for word in words:
            node = root
            for letter in word:
                node = node.setdefault(letter, {})
            node[""] = word
        path: list[str] = []
        states: list[tuple[int, int] | None] = [(-1, 0)]
        todo: list[tuple[str, dict, int]] = [("", root, 0)]
        while todo:
            letter, node, depth = todo.pop()
            if depth:
                del path[depth - 1 :], states[depth:]
                path.append(letter)
                # In deep tries states are found on the way down, so that no look-up has far to go back.
                states.append(self.last_token(path, depth, states, "") if depth % DEEP == 0 else None)
                if "" in node:
                    state = self.last_token(path, depth, states, self.end)
                    ids = [state[0]]
                    while state[1]:
                        state = states[state[1]]
                        ids.append(state[0])
                    yield node[""], ids[::-1]
            elif "" in node:
                yield "", []
            todo += [(c, child, depth + 1) for c, child in node.items() if c]


class Codec:
    """A vocabulary with its trie and its cache of words, one for a worker process."""

    def __init__(self, path: str):
        self.trie = Trie(path)
        self.pieces = Pieces(path)
        self.pieces.encode_words, self.pieces.encode_text = self.learn, self._whole
        library = self.pieces.library
        self.tokens = [library.id_to_token(i) or "" for i in range(library.get_vocab_size())]

    def learn(self, fresh: list[str]) -> list[bytes]:
        """One trie for all new words of a batch."""
        found = dict(self.trie.encode(set(fresh)))
        return [self.pieces.packed(found[letters]) for letters in fresh]

    def encode(self, batch: pa.Array) -> list[np.ndarray]:
        return self.pieces.batch(batch)

    def _whole(self, text: str) -> bytes:
        return b"".join([x.tobytes() for x in self._special(text)])

    def _special(self, text: str) -> Iterator[np.ndarray]:
        """A text with special tokens: they keep their ids, what stands between them is encoded on its own."""
        library, at = self.pieces.library, 0
        either = re.compile("|".join(map(re.escape, self.pieces.special)))
        for found in either.finditer(text):
            yield self._between(text[at : found.start()])
            yield np.array([library.token_to_id(found[0])], dtype=self.pieces.type)
            at = found.end()
        yield self._between(text[at:])

    def _between(self, text: str) -> np.ndarray:
        words = self.pieces.letters(text)
        encoded = dict(self.trie.encode(set(words)))
        return np.asarray([i for w in words for i in encoded[w]], dtype=self.pieces.type)

    def decode(self, ids: np.ndarray) -> str:
        """As the library without a decoder does: the tokens' own texts with spaces between them."""
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(arrays) + 1, dtype=np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat = np.concatenate([np.zeros(0, np.int32), *arrays]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def encode_and_decode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>, decoded): every whole text encoded, and its ids decoded again.

    Ids are those of the tokenizers library with the file ``path``, which every executor can read, without special
    tokens of its own; special tokens written in a text keep their ids. Null and empty texts have no ids and decode to
    the empty string. Every row gives one row, repeated ones too; an empty table gives none. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for part in portions(batch, 1):
                ids = own.encode(part.column(1))
                decoded = pa.array([own.decode(x) for x in ids], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), lists(ids), decoded], names=["doc_id", "ids", "decoded"])

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>); rules as in encode_and_decode."""
    return encode_and_decode(docs, path).select("doc_id", "ids")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids array<int>); null ids are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            out = [own.decode(np.asarray(x if x is not None else [], dtype=np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
