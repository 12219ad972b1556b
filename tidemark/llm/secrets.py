"""Secret scans with a worklist of decoded layers.

The text is the first layer. A layer is scanned, then unwrapped: URL and Unicode escapes give the whole layer with those
characters decoded, a base64 run gives its content, compressed content its expansion. What comes out is a layer again, until
nothing new appears; a layer seen before is not entered twice. Every character of a layer knows its place in the text; what was
compressed has one place for all its characters. Layers are made one at a time, when the worklist asks for the next, so only a layer
and those it comes from are in memory.
Decoded bytes are always scanned: those that are no UTF-8 stand as one lone surrogate each, which no pattern has; bytes with
letters of UTF-16 are read as that too.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import texts
from tidemark.llm.tokens import release

#: The kinds of secrets in their order, and what ends up in a hidden place. Fixed values.
KINDS = ("assign", "access", "hex", "opaque")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
_NAMES = ("passw", "secret", "token", "api")

_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
# Beyond U+10FFFF there are no characters, so such an escape stays as it is.
_ONE_UNICODE = re.compile(r"\\u[0-9A-Fa-f]{4}|\\u\{0*(?:10[0-9A-Fa-f]{4}|[0-9A-Fa-f]{1,5})\}|\\U00(?:0[0-9A-Fa-f]|10)[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}")
_UNICODE = re.compile(f"(?:{_ONE_UNICODE.pattern})+")
# A run may be wrapped and indented; one of its lines has 16 characters at least.
_LETTER = "[A-Za-z0-9+/_-]"
_BREAK = r"[ \t]*(?:\r\n|\r|\n)[ \t]*"
_BASE64 = re.compile(rf"{_LETTER}{{16,}}(?:{_BREAK}{_LETTER}+)*={{0,2}}")
_BEFORE = re.compile(rf"(?<!{_LETTER}){_LETTER}+{_BREAK}\Z")
_IN_BASE64 = np.array([re.fullmatch(_LETTER, chr(c)) is not None for c in range(128)])
_MAGIC = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
# Letters of UTF-16, in either byte order; every pattern has as many in a row.
_WIDE = re.compile(rb"(?:[\x20-\x7e]\x00){8}|(?:\x00[\x20-\x7e]){8}")
_SKIPPED = re.compile(rb"[\x50-\x5f]\x2a\x4d\x18")

#: Bytes that one compressed layer may expand to, all its members together; a larger one is reported as a span of kind "opaque",
#: like one that needs more memory (xz) or a larger window (zstd) than its decompressor may have.
MAX_EXPANDED = 1 << 24
#: Bytes that compressed layers may expand to in one document, in all (or so many times its length, if that is more), and at one
#: time, each inside the one before. What is over these bounds is reported as "opaque", too.
MAX_TOTAL = 1 << 28
MAX_RATIO = 64
MAX_HELD = 1 << 26
#: Compressed bytes taken at a time, so that what comes before an error is kept.
PIECE = 256
ROWS = 256

Span = tuple[str, int, int, int]  # kind, start, end, depth


@dataclass
class Layer:
    """A text, where each of its characters comes from, and which of them were decoded; or ``whole``, the one place that all
    characters come from, all of them decoded."""

    text: str
    depth: int
    starts: np.ndarray | None = None
    ends: np.ndarray | None = None
    decoded: np.ndarray | None = None
    whole: tuple[int, int] | None = None

    def place(self, start: int, end: int) -> tuple[int, int]:
        return self.whole or (int(self.starts[start:end].min()), int(self.ends[start:end].max()))

    def is_decoded(self, start: int, end: int) -> bool:
        return self.whole is not None or bool(self.decoded[start:end].any())


@dataclass
class Budget:
    """What a document may still expand to, and what of it is in memory."""

    left: int
    held: int = 0

    def limit(self) -> int:
        return max(0, min(MAX_EXPANDED, self.left, MAX_HELD - self.held))


def scan(text: str) -> Iterator[tuple[str, int, int]]:
    """The base patterns: leftmost, non-overlapping for each kind."""
    lowered = text.lower()
    if any(name in lowered for name in _NAMES):
        for found in ASSIGN.finditer(text):
            if len(found[2]) >= 8:
                yield "assign", *found.span()
    if "AKIA" in text:
        yield from (("access", *found.span()) for found in ACCESS.finditer(text))
    yield from (("hex", *found.span()) for found in HEX.finditer(text))


def _text(data: bytes) -> str:
    return data.decode(errors="surrogateescape")


def _sizes(text: str) -> np.ndarray:
    """Bytes of each character of a ``_text``."""
    if text.isascii():
        return np.ones(len(text), dtype=np.int64)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
    return np.where((codes >= 0xD800) & (codes < 0xE000), 1, sizes).astype(np.int64)


def _url_bytes(run: str) -> tuple[str, np.ndarray]:
    """The characters of a run of %XX, and where in the run each begins."""
    decoded = _text(bytes.fromhex(run.replace("%", "")))
    sizes = _sizes(decoded)
    return decoded, 3 * (np.cumsum(sizes) - sizes)


def _unicode_letters(run: str) -> tuple[str, np.ndarray]:
    codes, starts = array("I"), array("q")
    for found in _ONE_UNICODE.finditer(run):
        code = int(found[0][2:].strip("{}"), 16)
        if codes and 0xDC00 <= code < 0xE000 and 0xD800 <= codes[-1] < 0xDC00:
            codes[-1] = 0x10000 + ((codes[-1] - 0xD800) << 10) + code - 0xDC00
        else:
            codes.append(code)
            starts.append(found.start())
    return codes.tobytes().decode("utf-32-le", "surrogatepass"), np.frombuffer(starts, dtype=np.int64)


def unescaped(layer: Layer, pattern: re.Pattern, letters: Callable) -> Layer | None:
    """The layer with all runs of ``pattern`` decoded, None if there are none."""
    texts_, starts, ends, decoded, at = [], [], [], [], 0
    for found in pattern.finditer(layer.text):
        run, first = letters(found[0])
        a, b = found.span()
        texts_ += [layer.text[at:a], run]
        if layer.whole is None:
            # The characters lie side by side in the run.
            starts += [layer.starts[at:a], np.minimum.reduceat(layer.starts[a:b], first)]
            ends += [layer.ends[at:a], np.maximum.reduceat(layer.ends[a:b], first)]
            decoded += [layer.decoded[at:a], np.ones(len(run), dtype=bool)]
        at = b
    if not texts_:
        return None
    text = "".join([*texts_, layer.text[at:]])
    if layer.whole is not None:
        return Layer(text, layer.depth + 1, whole=layer.whole)
    parts = (np.concatenate([*x, y[at:]]) for x, y in ((starts, layer.starts), (ends, layer.ends), (decoded, layer.decoded)))
    return Layer(text, layer.depth + 1, *parts)


def _machine(data: memoryview):
    """The decompressor for the magic that ``data`` begins with."""
    first = data[0]
    if first == 0x1F:
        return zlib.decompressobj(31)
    if first == 0x78:
        return zlib.decompressobj()
    if first == 0x42:
        return bz2.BZ2Decompressor()
    if first == 0xFD:
        return lzma.LZMADecompressor(memlimit=1 << 28)
    import zstandard

    return zstandard.ZstdDecompressor(max_window_size=1 << 27).decompressobj()


def _too_large(error: Exception) -> bool:
    """Whether a decompressor asked for more memory or a larger window than it may have."""
    return isinstance(error, MemoryError) or any(words in str(error) for words in ("Memory usage limit", "too much memory"))


def _member(data: memoryview, out: bytearray, limit: int) -> int | None:
    """Appends to ``out`` what the compressed bytes that ``data`` begins with expand to, up to an error if there is one. How
    many bytes that took, None if the end was not reached. Raises OverflowError beyond ``limit`` in all and beyond the
    decompressor's memory."""
    machine, at = _machine(data), 0
    # The engine of zstd takes no bound on its output, but PIECE bytes have one.
    bound = () if data[0] == 0x28 else (limit + 1,)
    try:
        while at < len(data) and not machine.eof:
            out += machine.decompress(data[at : at + PIECE], *(size - len(out) for size in bound))
            at = min(at + PIECE, len(data))
            if len(out) > limit:
                raise OverflowError
    except OverflowError:
        raise
    except Exception as error:
        if _too_large(error):
            raise OverflowError from error
        # zstandard is imported only where it is needed.
        if not isinstance(error, (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError)) and type(error).__name__ != "ZstdError":
            raise
        return None
    return at - len(machine.unused_data) if machine.eof else None


def _filled(data: memoryview, at: int) -> int:
    """Where the next member may begin: after zeros that fill up the last one and frames that zstd skips."""
    while at < len(data):
        if data[at] == 0:
            at += 1
        elif _SKIPPED.match(data, at) is not None:
            at += 8 + int.from_bytes(data[at + 4 : at + 8], "little")
        else:
            break
    return at


def expanded(data: memoryview, budget: Budget) -> tuple[bytes, int | None]:
    """What the compressed bytes that ``data`` begins with expand to, all members or frames in a row together, and how many
    bytes that took, None if the end was not reached. Raises OverflowError where ``_member`` does. All that is expanded
    counts for the budget, kept or not."""
    out, at, limit = bytearray(), 0, budget.limit()
    try:
        while True:
            size = _member(data[at:], out, limit)
            if size is None:
                return bytes(out), None
            at += size
            following = _filled(data, at)
            if _MAGIC.match(data, following) is None:
                return bytes(out), at
            at = following
    finally:
        budget.left -= len(out)


def expansions(data: bytes, budget: Budget) -> Iterator[tuple[int, int, bytes | None]]:
    """(start, end, content) of everything compressed in ``data``, wherever it begins; the content is None if it is
    too large. What has no end ends with the data."""
    at = 0
    while (found := _MAGIC.search(data, at)) is not None:
        start = found.start()
        at = start + 1
        try:
            content, size = expanded(memoryview(data)[start:], budget)
        except OverflowError:
            yield start, len(data), None
            continue
        if size is not None:
            at = start + size
        if content:
            yield start, len(data) if size is None else at, content


def contents(data: bytes, budget: Budget) -> Iterator[tuple[int, int, bytes | None]]:
    """As ``expansions``, and what is compressed in their contents, at the place of the outermost. Bytes that expand to
    themselves come once."""
    todo, seen = [(None, 0, expansions(data, budget))], set()
    while todo:
        place, size, found = todo[-1]
        first, end, content = next(found, (0, 0, b""))
        if content == b"":
            budget.held -= size
            todo.pop()
            continue
        where = place or (first, end)
        if content is not None:
            mark = (where, hashlib.sha256(content).digest())
            if mark in seen:
                continue
            seen.add(mark)
            budget.held += len(content)
            todo.append((where, len(content), expansions(content, budget)))
        yield *where, content


def _from_base64(body: str) -> bytes:
    body = body[: len(body) - (len(body) % 4 == 1)].replace("-", "+").replace("_", "/")
    return base64.b64decode(body + "=" * (-len(body) % 4))


def _empty(text: str) -> bool:
    """Nothing to find and nothing to unwrap."""
    return not ("%" in text or "\\" in text or _BASE64.search(text) or next(scan(text), None))


def _runs(text: str) -> Iterator[tuple[int, int]]:
    """Base64 runs, each with the short lines before it that may belong to it."""
    at = 0
    for found in _BASE64.finditer(text):
        a, b = found.span()
        while a > at and text[a - 1] in " \t\r\n":
            low = a
            while low > at and text[low - 1] in " \t\r\n":
                low -= 1
            while low > at and text[low - 1].isascii() and _IN_BASE64[ord(text[low - 1])]:
                low -= 1
            before = _BEFORE.match(text, low, a)
            if before is None:
                break
            a = low
        yield a, b
        at = b


def readings(data: bytes) -> Iterator[tuple[str, int | None]]:
    """The texts that bytes may be and that have something to find, with the bytes that each character takes, if all take the same."""
    text = _text(data)
    if not _empty(text):
        yield text, None
    if _WIDE.search(data) is not None:
        # Text that begins at an odd byte reads like the other order at the first. Every unit is one character.
        units = np.frombuffer(data, dtype="<u2", count=len(data) // 2)
        for order in (units, units.byteswap()):
            text = order.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
            if not _empty(text):
                yield text, 2


def unpacked(layer: Layer, budget: Budget) -> Iterator[Layer | Span]:
    """The content of every base64 run: its bytes with a place for every character, and what is compressed in them, with
    characters that all have the place of the compressed part. A run may begin with a path or a name, so each of the four
    ways to cut it into groups is tried."""
    depth = layer.depth + 1
    for a, b in _runs(layer.text):
        run = layer.text[a:b]
        places = None
        if layer.whole is None:
            places = a + np.flatnonzero(_IN_BASE64[np.frombuffer(run.encode(), dtype=np.uint8)])
        body = "".join(run.split()).rstrip("=")
        for phase in range(4):
            data = _from_base64(body[phase:])
            for text, width in readings(data):
                if places is None:
                    yield Layer(text, depth, whole=layer.whole)
                    continue
                sizes = np.full(len(text), width, dtype=np.int64) if width else _sizes(text)
                last = np.cumsum(sizes)
                starts = layer.starts[places[phase + (last - sizes) * 8 // 6]]
                ends = layer.ends[places[phase + (last * 8 - 1) // 6]]
                yield Layer(text, depth, starts, ends, np.ones(len(text), dtype=bool))
            for first, end, content in contents(data, budget):
                place = layer.whole
                if places is not None:
                    after = places[phase + (end * 8 - 1) // 6] + 1
                    place = layer.place(places[phase + first * 8 // 6], after if layer.text[after:b].strip("=") else b)
                if content is None:
                    yield "opaque", *place, depth
                    continue
                for text, _ in readings(content):
                    yield Layer(text, depth, whole=place)


def opened(layer: Layer, budget: Budget) -> Iterator[Layer | Span]:
    """What comes out of a layer, one after the other."""
    for sign, pattern, letters in (("%", _URL, _url_bytes), ("\\", _UNICODE, _unicode_letters)):
        if sign in layer.text and (found := unescaped(layer, pattern, letters)) is not None:
            yield found
    yield from unpacked(layer, budget)


def find_secrets(text: str) -> list[Span]:
    """All spans in the text, base ones (depth 0) and those of decoded layers, by start, then kind."""
    spans = {(kind, a, b): 0 for kind, a, b in scan(text)}
    if "%" in text or "\\" in text or _BASE64.search(text):
        size, kind_of_place = len(text), np.int32 if len(text) < 1 << 31 else np.int64
        starts = np.arange(size, dtype=kind_of_place)
        budget = Budget(max(MAX_TOTAL, MAX_RATIO * size))
        todo = [(0, opened(Layer(text, 0, starts, starts + 1, np.zeros(size, dtype=bool)), budget))]
        seen = {(hashlib.sha256(text.encode(errors="surrogatepass")).digest(), 0, size)}
        while todo:
            held, found = todo[-1]
            layer = next(found, None)
            if layer is None:
                budget.held -= held
                todo.pop()
            elif not isinstance(layer, Layer):
                spans[layer[:3]] = min(layer[3], spans.get(layer[:3], layer[3]))
            elif layer.text:
                ends = layer.whole or (int(layer.starts[0]), int(layer.ends[-1]))
                mark = (hashlib.sha256(layer.text.encode(errors="surrogatepass")).digest(), *ends)
                if mark in seen:
                    continue
                seen.add(mark)
                for kind, a, b in scan(layer.text):
                    if layer.is_decoded(a, b):
                        span = (kind, *layer.place(a, b))
                        spans[span] = min(layer.depth, spans.get(span, layer.depth))
                budget.held += len(layer.text)
                todo.append((len(layer.text), opened(layer, budget)))
    return sorted(((*span, depth) for span, depth in spans.items()), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SPANS = "array<struct<kind: string, start: int, end: int, depth: int>>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("depth", pa.int32())])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): the secrets of every whole text, in code points, end exclusive.

    Null and empty texts have no spans. Every row gives one row, repeated ones too; an empty table gives none. Other
    columns are ignored. A span of a decoded layer is where its characters stand in the text; one found only inside
    compressed content is the encoded run as far as it is compressed. Equal spans are listed once, with the least depth. What expands beyond
    MAX_EXPANDED (or a document's MAX_TOTAL, MAX_HELD) or needs a decompressor of more than 256 MB (xz) or a window of more than 128 MB (zstd) is not read but
    reported as a span of kind "opaque".
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                found = [
                    [dict(zip(("kind", "start", "end", "depth"), s, strict=True)) for s in find_secrets(x.as_py())] for x in part.column(1)
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(_SPAN))], names=["doc_id", "spans"])

    return texts(docs).mapInArrow(run, f"doc_id long, spans {SPANS}")


def redacted(text: str, mask: str) -> str:
    out, at = [], 0
    for _, start, end, _ in find_secrets(text):
        if end > at:
            out += [text[at : max(at, start)], mask] if start >= at else []
            at = end
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, mask: str = "[SECRET]", text_column: str = "text", size_column: str = "n_chars") -> DataFrame:
    """``docs`` with every secret's span (overlapping ones together) replaced by ``mask``; all rows and columns stay.
    Null texts stay null. ``size_column`` follows the text if there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            place = batch.schema.get_field_index("_text")
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                clean = [None if x is None else redacted(x, mask) for x in part.column(place).to_pylist()]
                yield part.set_column(place, "_text", pa.array(clean, part.schema.field(place).type))

    # Only the text goes through Python by a name that no other column has; the rest travels with it.
    named = docs.select(F.struct("*").alias("_row"), F.col(text_column).cast("string").alias("_text"))
    done = named.mapInArrow(run, named.schema)
    fresh = {text_column: F.col("_text")} | ({size_column: F.length("_text").cast(docs.schema[size_column].dataType)} if size_column in docs.columns else {})
    return done.select(*(fresh.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns))
