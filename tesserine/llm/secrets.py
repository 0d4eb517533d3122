"""Secret scans: a worklist of decoded layers, rescanned until nothing new decodes.

The text is the first layer. Each layer is scanned for secrets; then every
encoded stretch in it (URL escapes, Unicode and hexadecimal escapes, character
references, base64, and zlib, gzip, bzip2 or xz data in base64) is decoded into
a layer of its own and put on the worklist. Equal encoded bytes are decoded once in
a text, which ends cycles, and count wherever they stand; a decoded layer is
never longer than its parent but for compressed data. All members of that are read to
their end, CHUNK bytes at a time, and scanned in pieces that end where no secret or
encoded stretch can go on; a longer stretch without such a place is held whole. What was
compressed more than once is unfolded layer by layer until nothing is compressed or a
layer comes again; a folded layer of more than CHUNK bytes waits in a temporary file. A layer of
replaced escapes keeps, for each of its characters, the stretch of the original text
that it came from, and base64 is one stretch whatever it holds, so a secret found at
any depth is reported where it stands in the text.

Base spans are those of the text itself and always stay.

Edge cases: a null text is empty and has no spans. Rows are scanned one by one;
repeated rows repeat their result. Bytes that aren't UTF-8 end whatever stands before them.
Only doc_id and text are looked at.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import codecs
import hashlib
import html
import io
import itertools
import lzma
import re
import string
import tempfile
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")
#: Bytes that are unfolded of a compressed stretch at a time.
CHUNK = 1 << 20

_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_KEYWORD = re.compile(r"(?ai:pass|secret|token|api)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")

_ESCAPE = re.compile(r"(?:(?:%[0-9A-Fa-f]{2})+|\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")

#: All characters that a secret or an encoded stretch may hold.
_WITHIN = string.ascii_letters + string.digits + "+/_.=-\"' :%\\{}&#;"

#: Where a layer's characters come from: None for the text itself, or the (start, end) of each.
Origin = None | list[tuple[int, int]]


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the secrets in one layer, in order."""
    found = []
    if _KEYWORD.search(text):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def _where(origin: Origin, start: int, end: int) -> tuple[int, int]:
    """The stretch of the original text behind characters start to end of a layer."""
    if origin is None:
        return start, end
    return min(a for a, _ in origin[start:end]), max(b for _, b in origin[start:end])


def _member(data: bytes):
    """What decompresses data that begins so, or None."""
    if data[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if data[:1] == b"\x78" and len(data) > 2 and (data[0] * 256 + data[1]) % 31 == 0:
        return zlib.decompressobj()
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    return lzma.LZMADecompressor() if data[:6] == b"\xfd7zXZ\x00" else None


def _chunks(source: BinaryIO) -> Iterator[bytes]:
    """What compressed data holds, all its members, CHUNK bytes at a time; nothing if it isn't compressed. Of damaged data what was unfolded before the chunk with the damage."""
    data = source.read(CHUNK)
    while (d := _member(data)) is not None:
        try:
            while not d.eof:
                if out := d.decompress(data, CHUNK):
                    yield out
                data = getattr(d, "unconsumed_tail", b"")
                if not out and not d.eof and not (data := data + source.read(CHUNK)):
                    return
        except (OSError, EOFError, ValueError, zlib.error, lzma.LZMAError):
            return
        data = d.unused_data.lstrip(b"\0")
        while len(data) < 6 and (more := source.read(CHUNK)):
            data = (data + more).lstrip(b"\0")


def _parts(data: bytes) -> Iterator[bytes | str]:
    """Data as it is, then the layer that it unfolds to, what that unfolds to, and so on until nothing does or a layer comes again.

    Unfolded layers come as text in pieces; a character that no secret or encoded stretch holds is where a piece may end."""
    yield data
    source, seen = io.BytesIO(data), {hashlib.sha512(data).digest()}
    while (first := next(chunks := _chunks(source), None)) is not None:
        folded = len(first) < 6 or _member(first) is not None
        decoder, held, kept, digest = codecs.getincrementaldecoder("utf-8")("replace"), [], tempfile.SpooledTemporaryFile(CHUNK), hashlib.sha512()
        for chunk in itertools.chain([first], chunks):
            if folded:
                kept.write(chunk)
                digest.update(chunk)
            text = decoder.decode(chunk)
            head = text.rstrip(_WITHIN)
            if head:
                yield "".join([*held, head])
                held = []
            held.append(text[len(head) :])
        yield "".join(held)
        source.close()
        if not folded or digest.digest() in seen:
            kept.close()
            return
        seen.add(digest.digest())
        kept.seek(0)
        source = kept


def _bytes(run: str) -> tuple[str, list[tuple[int, int]]]:
    """A run of percent escapes as text, and the place of each character in it."""
    data = bytes.fromhex(run.replace("%", ""))
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1"), [(k, k + 3) for k in range(0, len(run), 3)]
    places, at = [], 0
    for c in text:
        n = 3 * len(c.encode())
        places.append((at, at + n))
        at += n
    return text, places


def _escapes(layer: str) -> tuple[str, list[tuple[int, int]]] | None:
    """The layer with its URL, Unicode, hexadecimal and character escapes replaced, and the stretch of each character."""
    out, spans, at = [], [], 0
    for m in _ESCAPE.finditer(layer):
        try:
            if m[0][0] == "%":
                code, places = _bytes(m[0])
            else:
                code = html.unescape(m[0]) if m[0][0] == "&" else chr(int(m[0][2:].strip("{}"), 16))
                places = [(0, len(m[0]))] * len(code)
        except (ValueError, OverflowError):
            continue
        if "\ud800" <= code[:1] <= "\udfff" or not code:
            continue
        out += [layer[at : m.start()], code]
        spans += [(k, k + 1) for k in range(at, m.start())] + [(m.start() + a, m.start() + b) for a, b in places]
        at = m.end()
    if not at:
        return None
    return "".join([*out, layer[at:]]), spans + [(k, k + 1) for k in range(at, len(layer))]


def _unescaped(layer: str) -> tuple[str, list[tuple[int, int]]] | None:
    return _escapes(layer) if "%" in layer or "\\" in layer or "&#" in layer else None


def _encoded(layer: str) -> Iterator[tuple[int, int, bytes]]:
    """The stretches of base64 in a layer, and their bytes."""
    for m in _BASE64.finditer(layer):
        body = m[0].rstrip("=").replace("-", "+").replace("_", "/")
        if len(body) % 4 == 1 or body.isalpha() and (body.islower() or body[1:].islower()):
            continue
        try:
            yield m.start(), m.end(), base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
        except (binascii.Error, ValueError):
            continue


def _held(part: bytes | str) -> tuple[set[int], set[bytes]]:
    """The kinds of secrets in a piece of text, its escapes replaced until none is left, and the bytes encoded in it."""
    layer = part.decode("utf-8", "replace") if isinstance(part, bytes) else part
    kinds, inner = set(), set()
    while layer:
        kinds.update(kind for _, kind, _ in scan(layer))
        inner.update(x for _, _, x in _encoded(layer))
        found = _unescaped(layer)
        layer = found[0] if found else None
    return kinds, inner


def _inner(data: bytes, kinds: set[int]) -> Iterator[bytes]:
    """The bytes encoded in those of a layer, piece by piece; the kinds of secrets are added to ``kinds``."""
    for part in _parts(data):
        found, inner = _held(part)
        kinds |= found
        yield from inner


def _key(data: bytes) -> bytes:
    return data if len(data) <= 64 else b"#" + hashlib.sha512(data).digest()


def _kinds(work: set[bytes]) -> dict[bytes, set[int]]:
    """The kinds of secrets in encoded bytes, at any depth, by their key; equal bytes are decoded once, which ends cycles."""
    known: dict[bytes, set[int]] = {}
    around: dict[bytes, set[bytes]] = {}
    todo: list[tuple[bytes | None, Iterator[bytes]]] = [(None, iter(work))]
    while todo:
        outer, held = todo[-1]
        if (data := next(held, None)) is None:
            todo.pop()
            continue
        key = _key(data)
        if outer is not None:
            around.setdefault(key, set()).add(outer)
        if key not in known:
            known[key] = set()
            todo.append((key, _inner(data, known[key])))
    changed = [key for key in around if known[key]]
    while changed:
        key = changed.pop()
        for outer in around.get(key, ()):
            if not known[key] <= known[outer]:
                known[outer] |= known[key]
                changed.append(outer)
    return known


def secrets(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans of a text, and all spans: (start, kind, end) in order."""
    base = scan(text)
    spans, layer, origin, places = set(base), text, None, []
    while True:
        places += [(_where(origin, start, end), data) for start, end, data in _encoded(layer)]
        if not (found := _unescaped(layer)):
            break
        layer, stretches = found
        origin = stretches if origin is None else [_where(origin, a, b) for a, b in stretches]
        for start, kind, end in scan(layer):
            a, b = _where(origin, start, end)
            spans.add((a, kind, b))
    known = _kinds({data for _, data in places})
    spans.update((a, kind, b) for (a, b), data in places for kind in known[_key(data)])
    return base, sorted(spans)


def named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[] for _ in range(5)]
        for value in batch.column(1):
            base, spans = secrets(value.as_py() or "")
            for k in range(3):
                out[k].append(sum(1 for x in base if x[1] == k))
            out[3].append(hashlib.sha256(named(base).encode()).hexdigest())
            out[4].append(named(spans))
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in out[:3]], *[pa.array(x, pa.string()) for x in out[3:]]], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def secret_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for each row; offsets are in code points of the text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scanned, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
