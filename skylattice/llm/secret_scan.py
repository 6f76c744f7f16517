"""Secret scans with a recursive decoding worklist.

A text is the first layer. Each layer is scanned; what it holds encoded (URL and Unicode
escapes, base64, compressed bytes in base64) becomes further layers, until none is new. A layer
knows how its positions lie in the layer it came from, so spans are mapped back to the text.
What compressed bytes hold has one span, that of the bytes: such layers are kept as bytes, large
ones in an unnamed file of the task, and matched from there, so that a layer of any size takes
little memory and has no seams.
"""

from __future__ import annotations

import base64
import bisect
import bz2
import codecs
import functools
import hashlib
import lzma
import mmap
import re
import tempfile
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skylattice.llm.common import arrow_map, byte_table, pieces, text_buffer, whole, word_bounds

KINDS = ("assign", "access", "hex")


def _both(pattern: str, flags: int = 0) -> tuple[re.Pattern, re.Pattern]:
    """A pattern for texts and for bytes."""
    return re.compile(pattern, flags), re.compile(pattern.encode(), flags & ~re.ASCII)


# kind, pattern, the group whose length counts, and its least length
_SECRETS = (
    ("assign", _both(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 8),
    ("access", _both(r"AKIA[A-Z0-9]{12,}"), 0, 16),
    ("hex", _both(r"[0-9a-f]{32,}"), 0, 32),
)
_PERCENT = _both(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = _both(r"\\u[dD][89abAB][0-9A-Fa-f]{2}\\u[dD][c-fC-F][0-9A-Fa-f]{2}|\\u([0-9A-Fa-f]{4})|\\u\{([0-9A-Fa-f]{1,6})\}|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
_BASE64 = _both(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Base64 broken into lines: all but the last have 16 characters or more.
_LINE = _both(r"[A-Za-z0-9+/_-]+={0,2}")
_WRAPPED = _both(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{16,}+[ \t]*+(?:\r\n|\n|\r)[ \t]*+)+[A-Za-z0-9+/_-]++={0,2}")


def _compressed(hexed: str, rest: str, before: str = "") -> tuple[re.Pattern, re.Pattern]:
    """Compressed bytes, by how they begin, written as ``hexed`` and two digits or as plain letters
    and digits, and then what ``rest`` allows."""
    digits = lambda c: hexed + "".join(f"[{d}{d.upper()}]" if d.isalpha() else d for d in f"{c:02x}")
    byte = lambda *codes: "(?:" + "|".join([re.escape(chr(c)) for c in codes if chr(c).isalnum() and c < 0x7B] + [digits(c) for c in codes]) + ")"
    begins = [byte(0x1F) + byte(0x8B), byte(0x78) + byte(0x01, 0x5E, 0x9C, 0xDA), byte(0x42) + byte(0x5A) + byte(0x68) + byte(*range(0x31, 0x3A)), byte(0xFD) + byte(0x37) + byte(0x7A) + byte(0x58) + byte(0x5A) + byte(0x00)]
    if before:  # a plain character that escapes leave as it is
        begins[1] = byte(0x78) + "(?:" + byte(0x01, 0x5E, 0x9C, 0xDA) + r"|\^)"
    return _both(f"{before}(?:{'|'.join(begins)})(?:{rest})+")


_HEX = r"\\x[0-9A-Fa-f]{2}|\\[abfnrtv0'\"\\]"
#: Compressed bytes in percent escapes, and in strings of \x escapes: within either quotes, or none.
_PACKED = (
    _compressed("%", r"%[0-9A-Fa-f]{2}|[A-Za-z0-9_.~+/-]"),
    _compressed(r"\\x", _HEX + r"|[ -&(-\[\]-~]", "(?<=')"),
    _compressed(r"\\x", _HEX + r"|[ !#-\[\]-~]", '(?<=")'),
    _compressed(r"\\x", _HEX + r"|[ !#-&(-\[\]-~]", "(?<!['\"])"),
)
_UNIT = re.compile(r"%[0-9A-Fa-f]{2}|" + _HEX + r"|[\x20-\x7e]")
_SHORT = dict(zip("abfnrtv0'\"\\", b"\a\b\f\n\r\t\v\0'\"\\"))
#: Bytes that are decoded or decompressed in one step, and a layer's bytes that stay in memory.
STEP, HELD = 1 << 20, 4 << 20
#: For a quick look at the bytes: any of these may be a secret or an encoded layer.
_WORDS = re.compile(rb"password|passwd|secret|token|api_?key|akia|%[0-9a-f]{2}|\\[ux]|&#")
_RUNS = byte_table((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x2B, 0x2B), (0x2D, 0x2D), (0x2F, 0x2F), (0x5F, 0x5F))


def scan(text) -> Iterator[tuple[int, int, str]]:
    """Secrets of one layer (text or bytes): leftmost matches without overlap, for each kind."""
    for kind, both, group, least in _SECRETS:
        for m in both[not isinstance(text, str)].finditer(text):
            if m.end(group) - m.start(group) >= least:
                yield m.start(), m.end(), kind


class Layer:
    """A text, and the span of the whole text that each of its spans came from."""

    def __init__(self, text: str, up: Callable[[int, int], tuple[int, int]]):
        self.text, self.up = text, up

    def key(self) -> tuple:
        return hashlib.sha256(self.text.encode("utf-8", "surrogatepass")).digest(), *self.up(0, len(self.text))

    def found(self) -> Iterator[tuple[int, int, str]]:
        return ((*self.up(a, b), kind) for a, b, kind in scan(self.text))

    def children(self) -> Iterator:
        yield from _replaced(self, _percents(self.text))
        yield from _replaced(self, _escapes(self.text))
        for data, a, b in _written_bytes(self.text):
            yield Packed(data, self.up(a, b))
        for lines in _runs(self.text):
            yield from _decoded(self, lines)


class Packed:
    """Bytes that were compressed, all from one span of the whole text."""

    def __init__(self, data, span: tuple[int, int]):
        self.data, self.span = data, span

    def key(self) -> tuple:
        return hashlib.sha256(self.data).digest(), *self.span

    def found(self) -> Iterator[tuple[int, int, str]]:
        return ((*self.span, kind) for kind in {kind for _, _, kind in scan(self.data)})

    def children(self) -> Iterator:
        if _opener(self.data[:8]):
            data = _spooled(_unpacked(self.data))
            if data is not None:
                yield Packed(data, self.span)
        for data, _, _ in _written_bytes(self.data):
            yield Packed(data, self.span)
        for make in (_percent_bytes, _escape_bytes):
            data = _spooled(make(self.data))
            if data is not None and len(data) != len(self.data):
                yield Packed(data, self.span)
        for lines in _runs(self.data):
            raw = _spooled(_base64_bytes(self.data, lines))
            yield from _opened(raw, self.span)
        if self.data.find(b"\0") >= 0:
            for order in ("utf-16-le", "utf-16-be"):
                yield Packed(_spooled(_from_utf16(self.data, order)), self.span)


def _spooled(parts: Iterator[bytes]):
    """The parts joined: bytes, or a map of an unnamed file where there are more than HELD; None
    if there are none."""
    held, size, file = [], 0, None
    for part in parts:
        held.append(part)
        size += len(part)
        if size > HELD:
            file = file or tempfile.TemporaryFile()
            file.writelines(held)
            held = []
            size = 1 + HELD
    if file is None:
        return b"".join(held) or None
    file.flush()
    return mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)


def _percents(text: str) -> Iterator[tuple[int, int, str]]:
    """Runs of %XX as (start, end, character); a byte that isn't UTF-8 stays as it is written."""
    for m in _PERCENT[0].finditer(text):
        at = m.start()
        for c in bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "surrogateescape"):
            if 0xDC80 <= ord(c) <= 0xDCFF:
                at += 3
                continue
            n = 3 * len(c.encode())
            yield at, at + n, c
            at += n


def _code(m: re.Match) -> int:
    """The code point of an escape."""
    digits = next((g for g in m.groups()[:5] if g), None)
    if digits:
        return int(digits, 16)
    if m[6]:
        return int(m[6])
    return 0x10000 + ((int(m[0][2:6], 16) - 0xD800) << 10) + int(m[0][8:12], 16) - 0xDC00


def _escapes(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _ESCAPE[0].finditer(text):
        code = _code(m)
        if code < 0x110000 and not 0xD800 <= code < 0xE000:
            yield m.start(), m.end(), chr(code)


def _replaced(layer: Layer, parts: Iterator[tuple[int, int, str]]) -> Iterator[Layer]:
    """The layer with the spans (start, end) each replaced by one character, if there are any."""
    text, at, place = [], 0, 0
    news, starts, ends = [], [], []  # of the replaced characters: place in the new text, old span
    for a, b, c in parts:
        text += [layer.text[at:a], c]
        place += a - at
        news.append(place)
        starts.append(a)
        ends.append(b)
        place, at = place + 1, b
    if not news:
        return
    news, starts, ends = (np.array(x, np.int64) for x in (news, starts, ends))

    def old(p: int, end: bool) -> int:
        """Where the character at p begins (or ends) in the old text."""
        i = int(np.searchsorted(news, p, "right")) - 1
        if i >= 0 and news[i] == p:
            return int(ends[i] if end else starts[i])
        return p + end + (int(ends[i] - news[i]) - 1 if i >= 0 else 0)

    yield Layer("".join([*text, layer.text[at:]]), lambda a, b: layer.up(old(a, False), old(b - 1, True)))


def _percent_bytes(data) -> Iterator[bytes]:
    at = 0
    for m in _PERCENT[1].finditer(data):
        yield from _slices(data, at, m.start())
        yield bytes.fromhex(m[0].replace(b"%", b"").decode())
        at = m.end()
    if at:
        yield from _slices(data, at, len(data))


def _escape_bytes(data) -> Iterator[bytes]:
    at = 0
    for m in _ESCAPE[1].finditer(data):
        code = _code(m)
        if code < 0x110000 and not 0xD800 <= code < 0xE000:
            yield from _slices(data, at, m.start())
            yield chr(code).encode()
            at = m.end()
    if at:
        yield from _slices(data, at, len(data))


def _slices(data, a: int, b: int) -> Iterator[bytes]:
    for i in range(a, b, STEP):
        yield data[i : min(b, i + STEP)]


def _from_utf16(data, order: str) -> Iterator[bytes]:
    decoder = codecs.getincrementaldecoder(order)("replace")
    for part in _slices(data, 0, len(data)):
        yield decoder.decode(part).encode("utf-8", "replace")


def _runs(text) -> Iterator[np.ndarray]:
    """Base64 to decode, as spans (rows of start and end) of lines to join: each run alone, all
    lines of a block, and the lines of one length in it with the shorter one after them."""
    kind = not isinstance(text, str)
    for m in _BASE64[kind].finditer(text):
        yield np.array([m.span()])
    for m in _WRAPPED[kind].finditer(text):
        lines = np.fromiter((x.span() for x in _LINE[kind].finditer(text, *m.span())), np.dtype((np.int64, 2)))
        yield lines
        sizes = lines[:, 1] - lines[:, 0]
        cuts = np.flatnonzero(np.concatenate(([True], sizes[1:] != sizes[:-1]))).tolist()
        for i, j in zip(cuts, [*cuts[1:], len(lines)]):
            if j < len(lines) and sizes[j] < sizes[i]:
                yield lines[i : j + 1]
            if j - i > 1:
                yield lines[i:j]


def _base64_bytes(data, lines: np.ndarray) -> Iterator[bytes]:
    """The bytes of base64 in lines, a step at a time; what a broken last group says is dropped."""
    left = b""
    for a, b in lines:
        for part in _slices(data, int(a), int(b)):
            part = part if isinstance(part, bytes) else part.encode()
            left += part.rstrip(b"=").replace(b"-", b"+").replace(b"_", b"/")
            if len(left) >= STEP:
                whole_groups = len(left) // 4 * 4
                yield base64.b64decode(left[:whole_groups])
                left = left[whole_groups:]
    left = left[: len(left) - (len(left) % 4 == 1)]
    yield base64.b64decode(left + b"=" * (-len(left) % 4))


def _opener(raw):
    if raw[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if len(raw) > 2 and raw[:2] in (b"\x78\x01", b"\x78\x5e", b"\x78\x9c", b"\x78\xda"):
        return zlib.decompressobj()
    if raw[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if raw[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    return None


def _written_bytes(text) -> Iterator[tuple]:
    """What compressed bytes hold that are written with escapes, and the span they are written in,
    up to their end. Escapes of one byte each; a plain character is that byte."""
    kind = not isinstance(text, str)
    for patterns in _PACKED:
        for m in patterns[kind].finditer(text):
            units = list(_UNIT.finditer(m[0].decode() if kind else m[0]))
            raw = bytes(int(u[0][-2:], 16) if u[0][0] == "%" and len(u[0]) == 3 or len(u[0]) == 4 else _SHORT[u[0][1]] if len(u[0]) == 2 else ord(u[0]) for u in units)
            ends: list[int] = []
            data = _spooled(_unpacked(raw, ends))
            # a stream that breaks off is one that other escapes go on with, or the text's end
            if data is not None and (ends or m.end() == len(text)):
                yield data, m.start(), m.start() + units[(ends or [len(units)])[-1] - 1].end()


def _unpacked(raw, ends: list[int] | None = None) -> Iterator[bytes]:
    """Pieces of what compressed bytes hold, one member after another, up to the first fault;
    ``ends`` gets the places where members end."""
    at = 0
    try:
        while opened := _opener(raw[at : at + 8]):
            while not opened.eof and at < len(raw):
                part = raw[at : at + STEP]
                at += len(part)
                made = opened.decompress(part, STEP)
                while made or not opened.eof:
                    if made:
                        yield made
                    rest = getattr(opened, "unconsumed_tail", b"")
                    if opened.eof or not (rest or len(made) == STEP):
                        break
                    made = opened.decompress(rest, STEP)
            if not opened.eof:
                return
            at -= len(opened.unused_data)
            if ends is not None:
                ends.append(at)
            while raw[at : at + 1] == b"\0":
                at += 1
    except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):
        return


def _opened(raw, span: tuple[int, int]) -> Iterator[Packed]:
    """What bytes from one span hold: unpacked if they are compressed, else as they are."""
    if raw is not None:
        data = _spooled(_unpacked(raw))
        yield Packed(raw if data is None else data, span)


def _texts(raw: bytes) -> list[tuple[str, str]]:
    """What bytes may say, and the encoding: UTF-8, where a byte that isn't is a character of its
    own, and both orders of UTF-16 where there are null bytes."""
    found = [(raw.decode("utf-8", "surrogateescape"), "utf-8")]
    if b"\0" in raw:
        found += [(raw[: len(raw) // 2 * 2].decode(order, "surrogatepass"), order) for order in ("utf-16-le", "utf-16-be")]
    return found


def _decoded(layer: Layer, lines: np.ndarray) -> Iterator[Layer | Packed]:
    """Layers of base64 in lines of a layer."""
    raw = _spooled(_base64_bytes(layer.text, lines))
    if raw is None:
        return
    if _opener(raw[:8]) and (data := _spooled(_unpacked(raw))) is not None:
        yield Packed(data, layer.up(int(lines[0, 0]), int(lines[-1, 1])))
        return
    sizes = lines[:, 1] - lines[:, 0]
    begins = np.concatenate(([0], np.cumsum(sizes)))
    size = int(begins[-1]) - (len(layer.text[lines[-1, 0] : lines[-1, 1]]) - len(layer.text[lines[-1, 0] : lines[-1, 1]].rstrip("=")))

    def place(i: int) -> int:
        """Where the i-th character of the joined lines stands."""
        k = bisect.bisect_right(begins, i) - 1
        return int(lines[k, 0] + i - begins[k])

    for text, encoding in _texts(bytes(raw)):
        at = _byte_places(text, encoding)

        def up(a: int, b: int, at=at) -> tuple[int, int]:
            return layer.up(place(at(a) * 4 // 3), place(min(-(-at(b) * 4 // 3), size) - 1) + 1)

        yield Layer(text, up)


def _byte_places(text: str, encoding: str) -> Callable[[int], int]:
    """Where the characters of a decoded text begin in its bytes; worked out once, when asked."""
    if encoding == "utf-8" and text.isascii():
        return lambda i: i

    @functools.cache
    def places() -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if encoding == "utf-8":
            # a byte that isn't UTF-8 is a character of its own
            sizes = 1 + ((points >= 0x80) & ~((points >= 0xDC80) & (points <= 0xDCFF))) * (1 + (points >= 0x800).astype(np.int64) + (points >= 0x10000))
        else:
            sizes = 2 + 2 * (points >= 0x10000).astype(np.int64)
        return np.concatenate(([0], np.cumsum(sizes)))

    return lambda i: int(places()[i])


def secrets(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and the spans of all layers, by start and then kind."""
    order = lambda spans: sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    base = list(scan(text))
    everything, root = set(base), Layer(text, lambda a, b: (a, b))
    work, seen = [root.children()], {root.key()}
    while work:  # layers open at once: one of each depth
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
        elif (key := layer.key()) not in seen:
            seen.add(key)
            everything.update(layer.found())
            work.append(layer.children())
    return order(base), order(everything)


def suspects(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts that may hold a secret or an encoded layer: a quick look that misses none."""
    places = [m.start() for m in _WORDS.finditer(data.tobytes().lower())]
    starts, ends, _ = word_bounds(data, offsets, _RUNS)
    places = np.concatenate((np.array(places, np.int64), starts[ends - starts >= 16]))
    return np.unique(np.searchsorted(offsets, places, "right") - 1)


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def secret_scan(docs: DataFrame) -> DataFrame:
    r"""doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every whole text.

    The counts and base_sha256 are of the text as it stands; spans also has what decoded layers
    hold, mapped to the text, each span once. Positions are code points, ends exclusive; spans
    go by start, kind (assign, access, hex) and end. Null counts as empty; texts without
    secrets get zeros, the hash of an empty string and empty spans. A layer that was seen at
    its place before isn't opened again. Only doc_id and text are read; repeated rows are
    scanned each; an empty table gives an empty result. Base64 in lines is joined where all lines
    but the last have 16 characters or more. Compressed layers (gzip, zlib, bzip2, xz) are opened
    from base64, from percent or \x escapes of their bytes, and from one another, to any depth.
    Not opened: deflate without a header, archives, base64 of under 16 characters, compressed bytes
    in other escapes, other encodings. What a text unpacks to has no bound: it takes disk
    of the task, for the layers that lie within each other, and memory of some MB.
    """

    def run(batches):
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            for part in pieces(batch):
                n = part.num_rows
                counts, digests, spans = np.zeros((3, n), np.int64), [nothing] * n, [""] * n
                texts = part.column("text")
                for i in suspects(*text_buffer(texts)).tolist():
                    base, everything = secrets(texts[i].as_py())
                    for _, _, kind in base:
                        counts[KINDS.index(kind), i] += 1
                    digests[i], spans[i] = hashlib.sha256(written(base).encode()).hexdigest(), written(everything)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("doc_id", whole()), run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
