"""Token ids of whole texts for the operators that need them: the tokenizers library behind a bounded cache of words.

Texts are cut at single spaces, where neither vocabulary's own splitting ever joins two pieces. A batch of texts becomes
the dictionary of its distinct pieces and a number for each occurrence. All pieces of the dictionary are split into words in one
go, which are a dictionary again; only words that the cache does not have go to the library's model. The ids of occurrences
are gathered by offsets, words into pieces and pieces into texts. Texts with special tokens, or with white space of another
shape, go to the library as a whole.
"""

from __future__ import annotations

import codecs
import functools
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words kept by a worker; at twice as many the older half goes.
MAX_WORDS = 300_000
#: Bytes of the texts that are encoded together (a longer text is alone), and occurrences that are gathered at once.
BATCH = 1 << 23
GATHER = 1 << 17

#: A piece that cannot stand behind a cut: it is empty, or starts with white space.
_ODD = r"^$|^[\t-\r\x1c-\x20\x{85}\p{Z}]"

#: Pieces with letters beyond ASCII whose words can still be told without Unicode tables.
_LATIN = "[\n -~À-ÖØ-öø-ÿ]*"
#: The splitting rules of the two vocabularies, for such pieces and for ASCII; in ``_JOINED`` for pieces joined by NUL, which
#: ends a piece and is a match of its own. Fixed values.
_BYTE_WORDS = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[\0-\x08\x0e-\x1f!-/:-@\[-`{-\x7f]+"
    r"|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+"
)
_LOWER_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[\0-\x08\x0e-\x1f!-/:-@\[-`{-\x7f]+")
_JOINED_BYTE_WORDS = re.compile(
    r"\0|'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[\1-\x08\x0e-\x1f!-/:-@\[-`{-\x7f]+"
    r"|[ \t-\r]+(?![^\0 \t-\r])|[ \t-\r]+"
)
_JOINED_LOWER_WORDS = re.compile(r"\0|'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[\1-\x08\x0e-\x1f!-/:-@\[-`{-\x7f]+")


@functools.cache
def byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write every byte as a letter: visible ones as themselves, the rest from U+0100 on."""
    visible = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = (b for b in range(256) if b not in visible)
    return {b: chr(b) for b in visible} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


@functools.cache
def _letter_table() -> str:
    return "".join(byte_letters()[b] for b in range(256))


def as_letters(word: str) -> str:
    return codecs.charmap_decode(word.encode(), "strict", _letter_table())[0]


class Kept(dict):
    """A bounded cache: at the limit it starts again, but entries of the last round come back when they are used."""

    def __init__(self, limit: int, make=None):
        self.limit, self.make, self.last = limit, make, {}

    def __missing__(self, key):
        value = self.last[key] if key in self.last else self.make(key)
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.limit:
            self.last = dict(self)
            self.clear()
        self[key] = value

    def all(self, keys: list, make) -> list:
        """The values of distinct keys; ``make`` gives those of the new ones, in their order."""
        values, last = list(map(self.get, keys)), self.last
        absent = [i for i, v in enumerate(values) if v is None]
        places = []
        for i in absent:
            values[i] = last.get(keys[i])
            if values[i] is None:
                places.append(i)
        for i, value in zip(places, make([keys[i] for i in places]), strict=True):
            values[i] = value
        for i in absent:
            self.put(keys[i], values[i])
        return values


def strings(values: pa.Array) -> list[str]:
    return values.to_numpy(zero_copy_only=False).tolist()


def ranges(starts: np.ndarray, sizes: np.ndarray, ends: np.ndarray, pool: np.ndarray) -> np.ndarray:
    """The ranges of ``pool`` that start at ``starts``, side by side; ``ends`` are the sums of ``sizes``, from 0 on."""
    out = np.empty(ends[-1], dtype=pool.dtype)
    for a in range(0, len(sizes), GATHER):
        b = min(a + GATHER, len(sizes))
        out[ends[a] : ends[b]] = pool[np.repeat(starts[a:b] - ends[a:b], sizes[a:b]) + np.arange(ends[a], ends[b])]
    return out


def sums(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes, dtype=np.int64)])


class Pieces:
    """Texts to ids as little-endian 16-bit numbers (32-bit for vocabularies beyond).

    ``words`` has the ids of words. ``encode_words`` gives the packed ids of new words in byte letters, ``encode_text`` those of
    a text that cannot be cut. ``library`` is the tokenizer of ``path``, if it is loaded already.
    """

    def __init__(self, path: str, library=None):
        from tokenizers import Tokenizer

        self.library = library or Tokenizer.from_file(path)
        self.code = "H" if self.library.get_vocab_size() <= 1 << 16 else "I"
        self.type = np.dtype("<u2" if self.code == "H" else "<u4")
        self.spaces_count = self.library.normalizer is None
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.words = Kept(MAX_WORDS)
        self.encode_words, self.encode_text = self._words, self._text

    def _words(self, fresh: list[str]) -> list[bytes]:
        tokenize = self.library.model.tokenize
        return [self.packed([t.id for t in tokenize(letters)]) for letters in fresh]

    def _spelled(self, fresh: list[str]) -> list[bytes]:
        """New words, as they are or in byte letters behind a NUL."""
        return self.encode_words([word[1:] if word[0] == "\0" else as_letters(word) for word in fresh])

    def _text(self, text: str) -> bytes:
        return self.packed(self.library.encode(text, add_special_tokens=False).ids)

    def packed(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def letters(self, piece: str) -> list[str]:
        """A piece's words, in byte letters."""
        if not (piece.isascii() or re.fullmatch(_LATIN, piece)):
            text = self.library.normalizer.normalize_str(piece) if self.library.normalizer else piece
            return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]
        words = _BYTE_WORDS.findall(piece) if self.spaces_count else _LOWER_WORDS.findall(piece.lower())
        return [as_letters(w) for w in words]

    def dictionary(self, entries: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, their bounds); strings of special tokens in them are plain text."""
        latin = pc.or_(pc.string_is_ascii(entries), pc.match_substring_regex(entries, f"^{_LATIN}$"))
        plain = pc.and_not(latin, pc.match_substring(entries, "\0"))
        joined = "\0".join([*strings(pc.if_else(plain, entries, "")), ""])
        cut = _JOINED_BYTE_WORDS.findall(joined) if self.spaces_count else _JOINED_LOWER_WORDS.findall(joined.lower())
        # A NUL alone ends a piece. The words of other pieces follow behind, each with a NUL in front.
        others, extra = np.flatnonzero(~plain.to_numpy(zero_copy_only=False)), []
        for i in others.tolist():
            extra.append(["\0" + w for w in self.letters(entries[i].as_py())])
        coded = pa.array(cut + [w for words in extra for w in words], pa.large_string()).dictionary_encode()
        names, codes = strings(coded.dictionary), coded.indices.to_numpy()
        end = names.index("\0") if cut else len(names)
        values = self.words.all(names[:end] + names[end + 1 :], self._spelled)
        values[end:end] = [b""]
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // self.type.itemsize
        starts, pool = sums(sizes)[:-1], np.frombuffer(b"".join(values), dtype=self.type)
        ends = sums(sizes[codes])
        ids = ranges(starts[codes], sizes[codes], ends, pool)
        marks = np.flatnonzero(codes[: len(cut)] == end)
        spans = np.stack([ends[np.concatenate([[0], marks + 1])[:-1]], ends[marks]])
        more = ends[len(cut) + sums(np.array([len(words) for words in extra], np.int64))]
        spans[:, others] = more[:-1], more[1:]
        return ids, spans

    def batch(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; all texts are in memory together."""
        whole = np.zeros(len(texts), dtype=bool)
        for special in self.special:
            whole |= pc.match_substring(texts, special).to_numpy(zero_copy_only=False)
        cut = pc.split_pattern(texts, " ")
        bounds = sums(pc.list_value_length(cut).to_numpy(zero_copy_only=False))
        coded = cut.flatten().dictionary_encode()
        entries, codes = coded.dictionary, coded.indices.to_numpy()
        if self.spaces_count:
            # A text's first piece has no space in front. Any other that is odd would have to be split together with the one
            # before.
            odd, firsts = pc.match_substring_regex(entries, _ODD).to_numpy(zero_copy_only=False), bounds[:-1]
            first = entries.take(pa.array(codes[firsts]))
            codes, odd = codes.astype(np.int64), np.append(odd, np.zeros(len(firsts), dtype=bool))
            codes[firsts] = len(entries) + np.arange(len(firsts))
            entries = pa.concat_arrays([pc.binary_join_element_wise(" ", entries, ""), first])
            so_far = sums(odd[codes])
            whole |= so_far[bounds[1:]] > so_far[bounds[:-1]]
        pool, (starts, stops) = self.dictionary(entries)
        sizes = (stops - starts)[codes]
        ends = sums(sizes)
        ids = ranges(starts[codes], sizes, ends, pool)
        cuts = ends[bounds].tolist()
        out = [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        for row in np.flatnonzero(whole).tolist():
            out[row] = np.frombuffer(self.encode_text(texts[row].as_py()), dtype=self.type)
        return out

    def ids(self, text: str) -> np.ndarray:
        return self.batch(pa.array([text], pa.string()))[0]


def portions(batch: pa.RecordBatch, column: int, size: int = BATCH) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``size`` bytes of a text column; a longer text is alone or ends a part."""
    groups = sums(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))[:-1] // size
    cuts = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if a < b:
            yield batch.slice(a, b - a)


@functools.lru_cache(maxsize=4)
def pieces(path: str) -> Pieces:
    """One cache for a worker process, whatever tasks of these operators it runs."""
    return Pieces(path)


def release() -> None:
    """Give the memory back when the worker process goes on to other work."""
    pieces.cache_clear()
