"""Secrets in texts, also below nested encodings.

Base layer: three patterns, leftmost and without overlap for each kind:
``assign`` (a keyword, ``:`` or ``=``, a value of 6 or more characters), ``access``
(``AKIA`` keys of 20 or more characters) and ``hex`` (24 or more digits).

Worklist: each layer of a text is searched for layers inside it: percent escapes,
Unicode escapes (\\uXXXX, \\u{X}, \\UXXXXXXXX, \\xXX, &#N;), base64 runs of 16 or
more characters (both alphabets) and, in escaped or base64 bytes, zlib, gzip,
bzip2, xz or zstd data. Base64 may be wrapped and is read at each of its four shifts;
what it holds is scanned whatever its bytes are, UTF-16 and UTF-32 too. A decoded layer joins the worklist unless the same content
was decoded from the same place before, so each place of a repeated run counts and
cycles end, and the list runs until nothing new is found. Every
layer is scanned like the text; a finding is mapped to the characters of the text
that it was decoded from, for compressed data to the whole run.

Documents without any trace of a secret or an encoding are passed over by byte
searches before a pattern is tried. Compressed data is read as a stream over all of
its members, also if it is cut off, and scanned in parts that end where no pattern
can match across, so a layer of any size is scanned in bounded memory. Two limits
remain, which keep a decompression bomb from taking down a worker: where ``LAYER_MAX``
bytes have no such place, the part is cut there with ``OVERLAP`` bytes read twice (a
compressed run inside them that is cut is read to the cut only); and escaped
compressed data of over ``LAYER_MAX`` bytes is a layer of its own instead of standing
in the text around it.

Defined cases: a null text is empty; an empty text has no spans; repeated rows and
rows without an id are scanned one by one; other columns are unread.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator
from itertools import accumulate, chain, islice, tee

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import text as tx
from tidemark.llm.scratch import partitions

KINDS = ("assign", "access", "hex")
LAYER_MAX, CHUNK, OVERLAP = 64 << 20, 1 << 20, 1 << 20
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"(?:\\x[0-9A-Fa-f]{2})+|(?:\\u[0-9A-Fa-f]{4})+|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:\r?\n[\t\x20]*[A-Za-z0-9+/_-]+)*={0,2}")
_BREAK = re.compile(r"\r?\n[\t\x20]*")
_PIECE = re.compile(r"(?<=[+/_-])(?=[A-Za-z0-9])|(?=H4sI|Qlpo|[/_]Td6|KLUv)")
_WIDE = re.compile(rb"(?:[^\0]\0{1,3}){8}")


def _only(chars: bytes) -> bytes:
    return bytes(120 if b in chars else 46 for b in range(256))


#: Bytes that are in no pattern, nor between two lines of base64, nor NULs of UTF-16.
_APART = bytes(46 if b in b"\0\t\n\r \"#%&'+-./:;=\\_{}" or chr(b).isascii() and chr(b).isalnum() else 120 for b in range(256))
_HEX_RUN = _only(b"0123456789abcdef")
_BASE64_RUN = _only(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")


def base_spans(s: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the secrets that stand in ``s`` itself."""
    found = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(s) if m.end(2) - m.start(2) >= 6]
    found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(s)]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(s)]
    return found


def _packed(head: bytes) -> bool:
    """Whether data that begins like this may be compressed."""
    zipped = head[:1] == b"\x78" and len(head) > 2 and (head[0] << 8 | head[1]) % 31 == 0
    return zipped or head.startswith((b"\x1f\x8b", b"BZh", b"\xfd7zXZ\x00", b"\x28\xb5\x2f\xfd"))


def _opened(head: bytes):
    """A decompressor, which gives at most so many bytes a call, for data that begins
    with ``head``."""
    if head[:2] == b"\x1f\x8b" or head[:1] == b"\x78":
        return zlib.decompressobj(47)
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    return lzma.LZMADecompressor() if head[:1] == b"\xfd" else _Zstd()


class _Zstd:
    """One frame, taken in small pieces."""

    def __init__(self):
        self._d, self.unconsumed_tail = zstandard.ZstdDecompressor(max_window_size=1 << 31).decompressobj(), b""

    eof = property(lambda self: self._d.eof)
    unused_data = property(lambda self: self._d.unused_data + (bytes(self.unconsumed_tail) if self._d.eof else b""))

    def decompress(self, data: bytes, _: int) -> bytes:
        # a block of 128 kB takes 4 bytes at least
        view = memoryview(data)
        self.unconsumed_tail = view[64:]
        return self._d.decompress(view[:64])


def _members(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """What the compressed members in ``chunks`` hold, also of a last one that is cut
    off or damaged, in pieces of about CHUNK bytes."""
    out, data, d = bytearray(), b"", None
    try:
        while True:
            if d is None:
                while len(data) < 16 and (more := next(chunks, b"")):
                    data += more
                if not _packed(data):
                    break
                d = _opened(data)
            got = d.decompress(data, CHUNK)
            out += got
            if len(out) >= CHUNK:
                yield bytes(out)
                out.clear()
            if d.eof:
                data, d = d.unused_data, None
            elif (left := getattr(d, "unconsumed_tail", b"")) or len(got) == CHUNK or not getattr(d, "needs_input", True):
                data = left
            elif not (data := next(chunks, b"")):
                break
    except (zlib.error, OSError, EOFError, lzma.LZMAError, zstandard.ZstdError, ValueError):
        pass
    if out:
        yield bytes(out)


def _flat(data: bytes) -> Iterator[bytes]:
    """``data`` without all of its compressions, in pieces; nothing if it has none. A
    piece that was the beginning of a layer before ends the chain."""
    rest = (data[i : i + CHUNK] for i in range(0, len(data), CHUNK))
    head = next(rest, b"")
    seen = {head}
    while _packed(head):
        kept, source = tee(chain([head], rest))
        inner = _members(source)
        if not (first := next(inner, b"")) or first in seen:
            rest = islice(kept, 1, None)
            break
        del kept
        seen.add(first)
        head, rest = first, inner
    return chain([head], rest) if len(seen) > 1 else iter(())


def _parts(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The chunks, cut anew where no pattern can match across. A run without such a
    place is cut at LAYER_MAX bytes and its last OVERLAP bytes are read twice."""
    held = bytearray()
    for c in chunks:
        held += c
        if len(held) < 2 * CHUNK:
            continue
        if cut := held.translate(_APART).rfind(b"x") + 1:
            yield bytes(held[:cut])
            del held[:cut]
        elif len(held) >= LAYER_MAX:
            yield bytes(held)
            del held[: len(held) - OVERLAP]
    if held:
        yield bytes(held)


def _ends(data: bytes) -> bool:
    d = zlib.decompressobj()
    try:
        d.decompress(data, LAYER_MAX)
    except zlib.error:
        return False
    return d.eof


def _inflated(data: bytes) -> bytes | None:
    """``data`` without all of its compressions; None if it has none, if the outcome is
    over LAYER_MAX bytes, or if it may be a text that happens to begin like zlib."""
    out = bytearray()
    if data[:1] == b"\x78" and not _ends(data):
        return None
    for c in _flat(data):
        out += c
        if len(out) > LAYER_MAX:
            return None
    return bytes(out) or None


Layer = tuple[str, list[int] | range, list[int] | range]


def _substituted(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with each match of ``pattern`` decoded, and where its characters come from."""
    s, starts, ends = layer
    out: list[str] = []
    a: list[int] = []
    b: list[int] = []
    last = 0
    for m in pattern.finditer(s):
        i, j = m.span()
        got = decode(m.group())
        if got is None:
            continue
        out.append(s[last:i])
        a += starts[last:i]
        b += ends[last:i]
        text, exact = got
        out.append(text)
        if exact is None:
            a += [starts[i]] * len(text)
            b += [ends[j - 1]] * len(text)
        else:
            for lo, hi in exact:
                a.append(starts[i + lo])
                b.append(ends[i + hi - 1])
        last = j
    if not last:
        return None
    out.append(s[last:])
    return "".join(out), a + list(starts[last:]), b + list(ends[last:])


def _bytes_text(data: bytes, width: int):
    """Text of escaped bytes and the escapes of each character."""
    if (flat := _inflated(data)) is not None:
        return flat.decode("utf-8", "replace"), None
    text, exact, at = data.decode("utf-8", "surrogateescape"), [], 0
    for c in text:
        n = len(c.encode("utf-8", "surrogateescape"))
        exact.append((at * width, (at + n) * width))
        at += n
    return text.encode("utf-8", "surrogateescape").decode("utf-8", "replace") if len(text) == len(data.decode("utf-8", "replace")) else text, exact


def _percent(s: str):
    return _bytes_text(bytes.fromhex(s.replace("%", "")), 3)


def _unicode(s: str):
    if s[:2] == "\\x":
        return _bytes_text(bytes.fromhex(s.replace("\\x", "")), 4)
    if s[:2] == "\\u" and s[2] != "{":
        units = [int(s[i + 2 : i + 6], 16) for i in range(0, len(s), 6)]
        text, exact, i = [], [], 0
        while i < len(units):
            pair = 0xD800 <= units[i] < 0xDC00 and i + 1 < len(units) and 0xDC00 <= units[i + 1] < 0xE000
            text.append(chr(0x10000 + ((units[i] - 0xD800) << 10) + units[i + 1] - 0xDC00) if pair else chr(units[i]))
            exact.append((6 * i, 6 * (i + 1 + pair)))
            i += 1 + pair
        return "".join(text), exact
    digits = s.strip("\\uU{}&#;xX")
    code = int(digits, 10 if s[:2] == "&#" and s[2] not in "xX" else 16)
    return (chr(code), [(0, len(s))]) if code < 0x110000 else None


def _texts(data: bytes) -> Iterator[tuple[str, range | list[int]]]:
    """``data`` as text and the offset of each character, one more for the end; where
    NULs alternate (UTF-16, UTF-32) also without them. Any byte may occur."""
    if not any(suspicious(data.replace(b"\0", b""))):
        return
    if data.isascii():
        yield data.decode("ascii"), range(len(data) + 1)
    else:
        text = data.decode("utf-8", "surrogateescape")
        width = [1 if c < "\x80" or "\udc80" <= c <= "\udcff" else len(c.encode()) for c in text]
        yield re.sub("[\udc80-\udcff]", "\ufffd", text), [0, *accumulate(width)]
    if _WIDE.search(data):
        kept = [i for i, c in enumerate(data) if c]
        yield data.replace(b"\0", b"").decode("latin-1"), [*kept, len(data)]


def _whole(data: bytes, start: int, end: int) -> Iterator[Layer]:
    """Layers of compressed data, part by part, mapped to the whole run."""
    for part in _parts(_flat(data)):
        for text, _ in _texts(part):
            yield text, [start] * len(text), [end] * len(text)


def _escaped_layers(layer: Layer) -> Iterator[Layer]:
    """Compressed data in escaped bytes, which may be too large to stand in the text."""
    s, starts, ends = layer
    for pattern, escape in ((_PERCENT, "%"), (_UNICODE, "\\x")):
        for m in pattern.finditer(s) if escape in s else ():
            if m.group().startswith(escape) and _packed(data := bytes.fromhex(m.group().replace(escape, ""))):
                yield from _whole(data, starts[m.start()], ends[m.end() - 1])


def _base64_layers(layer: Layer) -> Iterator[Layer]:
    s, starts, ends = layer
    for m in _BASE64.finditer(s):
        run, at, begins = m.group(), range(m.start(), m.end()), {0}
        if "\n" in run:
            lines, last = [], 0
            for x in [*_BREAK.finditer(run), None]:
                lines.append(at[last : x.start() if x else len(run)])
                last = x.end() if x else last
            run, at = _BREAK.sub("", run), list(chain.from_iterable(lines))
            begins |= set(accumulate(map(len, lines[:-1])))
        yield from _run_layers(run, at, begins, starts, ends)


def _run_layers(run: str, at: range | list[int], begins: set[int], starts, ends) -> Iterator[Layer]:
    """Layers of a base64 run, whose characters stand at ``at``. Compressed data may
    begin at ``begins``, with the letters of its format or behind a path or a name, which may also have shifted the
    groups of four: so texts are read at each shift."""
    bare = run.rstrip("=")
    for i in sorted(begins | {p.start() for p in _PIECE.finditer(bare)}):
        if _packed(_decoded(bare[i : i + 12])):
            yield from _whole(_decoded(bare[i:]), starts[at[i]], ends[at[-1]])
    for i in range(4):
        for text, offsets in _texts(_decoded(bare[i:])):
            a = [starts[at[i + k * 8 // 6]] for k in offsets[: len(text)]]
            b = [ends[at[min(len(run), i - (-k * 8 // 6)) - 1]] for k in offsets[1:]]
            yield text, a, b


def _decoded(bare: str) -> bytes:
    bare = bare[: len(bare) - (len(bare) % 4 == 1)].replace("-", "+").replace("_", "/")
    return base64.b64decode(bare + "=" * (-len(bare) % 4))


def _inner(layer: Layer) -> Iterator[Layer]:
    if "%" in layer[0] and (new := _substituted(layer, _PERCENT, _percent)):
        yield new
    if ("\\" in layer[0] or "&#" in layer[0]) and (new := _substituted(layer, _UNICODE, _unicode)):
        yield new
    yield from _escaped_layers(layer)
    yield from _base64_layers(layer)


def _content(s: str) -> str | bytes:
    return s if len(s) < 64 else hashlib.sha256(s.encode("utf-8", "surrogatepass")).digest()


def all_spans(s: str) -> list[tuple[str, int, int]]:
    """Secrets of ``s`` and of every layer inside it, sorted by start, kind, end."""
    found = set(base_spans(s))
    work = [_inner((s, range(len(s)), range(1, len(s) + 1)))]  # depth first: of a large layer one part is held
    seen = {(_content(s), 0, len(s))}
    while work:
        if (new := next(work[-1], None)) is None:
            work.pop()
        elif new[0] and (key := (_content(new[0]), new[1][0], new[2][-1])) not in seen:
            seen.add(key)
            found.update((k, min(new[1][i:j]), max(new[2][i:j])) for k, i, j in base_spans(new[0]))
            work.append(_inner(new))
    return order(found)


def order(spans) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def suspicious(raw: bytes) -> tuple[bool, bool]:
    """Whether a text can hold a secret itself, and whether it can hold another layer."""
    low = raw.lower()
    own = any(k in low for k in _KEYWORDS) or b"AKIA" in raw or b"x" * 24 in raw.translate(_HEX_RUN)
    deep = b"%" in raw or b"\\" in raw or b"&#" in raw or b"x" * 16 in raw.translate(_BASE64_RUN)
    return own, deep


def render(spans) -> str:
    return ",".join(f"{k}:{i}:{j}" for k, i, j in spans)


_OUT = pa.schema([("doc_id", pa.int64())] + [(f"n_{k}", pa.int64()) for k in KINDS] + [("base_sha256", pa.string()), ("spans", pa.string())])
_NOTHING = (0, 0, 0, hashlib.sha256(b"").hexdigest(), "")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = tx.buffers(batch.column(1))
        rows = []
        for i in range(len(offsets) - 1):
            data = raw[offsets[i] : offsets[i + 1]].tobytes()
            own, deep = suspicious(data)
            if not (own or deep):
                rows.append(_NOTHING)
                continue
            s = data.decode("utf-8", "replace")
            base = order(base_spans(s)) if own else []
            spans = all_spans(s) if deep else base
            counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
            rows.append((*counts, hashlib.sha256(render(base).encode()).hexdigest(), render(spans)))
        columns = [batch.column(0), *(pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, list(_OUT)[1:]))]
        yield pa.RecordBatch.from_arrays(columns, schema=_OUT)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    partitions(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(_scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """The documents with every span of ``text``, encoded ones too, replaced by
    ``mask``; other columns as they are, a null text stays null."""
    partitions(docs.sparkSession)

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        out = []
        for s in texts.to_pylist():
            last, parts = 0, []
            if s:
                for _, i, j in sorted(all_spans(s), key=lambda x: x[1:]):
                    if i >= last:
                        parts += [s[last:i], mask]
                    last = max(last, j)
                s = "".join(parts) + s[last:]
            out.append(s)
        return pa.array(out, pa.string())

    return docs.withColumn("text", clean(F.col("text")))
