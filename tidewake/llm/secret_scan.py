"""Secret scans by a recursive decoding worklist.

A text is the first layer. Each layer is scanned with RULES and searched for encoded
parts: percent-encoding, \\uXXXX and \\xXX escapes, base64 (standard and URL-safe), and
gzip, zlib, bzip2 or xz streams, all members of them, that base64, percent-encoding, \\xXX
escapes or another stream uncovered. Percent-encoding and escapes are undone over the whole layer, with a map of
places; other parts are decoded by themselves. Each is a new layer on the worklist,
unless the same content was a layer for the same span before (so cycles and repeats
end). The list is worked until it is empty, whatever the depth. A finding's span is that
of the outermost base64 part in the document's text, or else of the characters that the
match itself was decoded from; what the layer above reported already isn't reported
again. Bytes that aren't UTF-8 are replaced, and a layer of mostly such bytes isn't text.

What inflates beyond MAX_LAYER bytes is worked as a stream, in windows that end at a
separator and overlap, one at a time in memory, each a layer of its own; windows of equal
content (as those of a bomb) are scanned once. A run without a separator that is longer
than BREAK and stands across a window's end is taken in two parts, each decoded from a
multiple of four characters.

Defined results: null or empty text has no finding; overlapping rules each report; a
secret that stands twice is reported for each span; repeated rows each get findings;
other columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import math
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import DataFrame

from tidewake.runtime import arrow

from . import kernels as K

MAX_LAYER = 1 << 26
#: Bytes before a window's end in which its last separator is sought, and that windows share.
BREAK, OVERLAP = 1 << 20, 1 << 12
#: Bits a character that a generic secret's value has at least.
ENTROPY = 3.0
RULES = {
    "aws_access_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "github_token": r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,})",
    "slack_token": r"\bxox[abprs]-[A-Za-z0-9-]{10,}",
    "google_api_key": r"\bAIza[0-9A-Za-z_-]{35}",
    "stripe_key": r"\b[sr]k_(?:live|test)_[0-9A-Za-z]{16,}",
    "json_web_token": r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "private_key": r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----",
    "url_password": r"\b[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,64}:[^\s/@]{3,128}@[^\s/]+",
    "assignment": r"(?i:\b(?:[a-z0-9_-]{0,32}(?:token|secret|passwd|password|pwd|api[_-]?key|access[_-]?key|auth[_-]?key|credential)s?))[\"']?\s{0,3}(?::=|=>|[=:])\s{0,3}[\"']?(?P<value>[A-Za-z0-9_\-+/.=~!@#$%^&*]{8,256})",
}
#: Each rule runs only where one of its literals stands, so that most text is passed by substring search.
_NEEDS = {
    "aws_access_key": ("AKIA", "ASIA"), "github_token": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_"), "slack_token": ("xox",), "google_api_key": ("AIza",), "stripe_key": ("k_live_", "k_test_"),
    "json_web_token": ("eyJ",), "private_key": ("PRIVATE KEY",), "url_password": ("://",), "assignment": ("=", ":"),
}
_COMPILED = {k: re.compile(v) for k, v in RULES.items()}
_WORDS = re.compile(r"(?i)token|secret|passw|pwd|key|credential")
_PERCENT = re.compile(r"%[0-7][0-9A-Fa-f]|(?:%[89A-Fa-f][0-9A-Fa-f])+")  # a character, or the bytes of some
_ESCAPE = re.compile(r"(?:\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2})|\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}")  # a surrogate pair is one
_CONTROLS = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\ufffd]")
_CONTROL_BYTES = bytes(x for x in range(128) if x < 9 or x in (11, 12) or 13 < x < 32 or x == 127)
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_MAGIC = ((b"\x1f\x8b", "gzip"), (b"x\x01", "zlib"), (b"x\x5e", "zlib"), (b"x\x9c", "zlib"), (b"x\xda", "zlib"), (b"BZh", "bzip2"), (b"\xfd7zXZ\x00", "xz"))
SCHEMA = "rule string, layers string, depth int, span_start long, span_end long, secret_sha256 string, preview string"


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def _kind(data: bytes) -> str | None:
    return next((k for magic, k in _MAGIC if data.startswith(magic)), None)


def _inflated(pieces: Iterable[bytes], kind: str) -> Iterator[bytes]:
    """The content of all members end to end, and bytes after them as they are; of a broken stream what comes before."""
    d, data, source, some = None, b"", iter(pieces), False
    while True:
        if not data and not (data := next(source, b"")):
            return
        if d is None:
            while len(data) < 6 and (more := next(source, b"")):
                data += more
            if some and _kind(data) != kind:
                data = data.lstrip(b"\0")
                if not data or _kind(data) != kind:
                    yield from chain([data], source) if data else source
                    return
            d = zlib.decompressobj(47) if kind in ("gzip", "zlib") else bz2.BZ2Decompressor() if kind == "bzip2" else lzma.LZMADecompressor()
        piece, data = data[: 1 << 14], data[1 << 14 :]
        try:
            out = d.decompress(piece, 1 << 20)
            while out:
                some = True
                yield out
                if d.eof:
                    break
                if kind in ("gzip", "zlib"):
                    out = d.decompress(d.unconsumed_tail, 1 << 20) if d.unconsumed_tail else b""
                else:
                    out = b"" if d.needs_input else d.decompress(b"", 1 << 20)
        except (zlib.error, OSError, ValueError, lzma.LZMAError, EOFError):
            return
        if d.eof:
            data, d, some = d.unused_data + data, None, True


def _first(pieces: Iterator[bytes]) -> bytes:
    """Up to a little more than MAX_LAYER bytes."""
    out, size = [], 0
    while size <= MAX_LAYER and (p := next(pieces, b"")):
        out.append(p)
        size += len(p)
    return b"".join(out)


def _window(pieces: Iterator[bytes]) -> tuple[bytes, bytes]:
    """(a window, the bytes that the next one begins with)."""
    data = _first(pieces)
    if len(data) <= MAX_LAYER:
        return data, b""
    end = len(data)
    at = next((x.end() for x in re.finditer(rb"[\s\"',;<>]", data[end - BREAK :][::-1])), 0)
    if at:  # from the end: so many bytes stand after the last separator
        return data, data[end - at + 1 - min(OVERLAP, end - at + 1) :]
    start = max((data.rfind(x) + 1 for x in (b" ", b"\n", b'"', b"'", b",", b";")), default=0)
    return data, data[start + (end - start) // 4 * 4 - OVERLAP :] if end - start > OVERLAP else data[start:]


def _as_text(data: bytes) -> str | None:
    """Decoded bytes that read as text: one in five at most is a control character or no UTF-8."""
    if (len(data) - len(data.translate(None, _CONTROL_BYTES))) * 5 > len(data):
        return None
    text = data.decode(errors="replace")
    return text if text and (len(text) - len(_CONTROLS.sub("", text))) * 5 <= len(text) else None


def _undone(text: str, pattern: re.Pattern, decode) -> tuple[str, list[tuple[int, int, int, bool]]] | None:
    """The layer with all that matches pattern decoded; its pieces: (start there, start and end in text, whether it is the same)."""
    parts, pieces, at, to = [], [], 0, 0
    for m in pattern.finditer(text):
        if m.start() > at:
            parts.append(text[at : m.start()])
            pieces.append((to, at, m.start(), True))
            to += m.start() - at
        out = decode(m.group())
        parts.append(out)
        pieces.append((to, m.start(), m.end(), False))
        to += len(out)
        at = m.end()
    if not pieces:
        return None
    if at < len(text):
        parts.append(text[at:])
        pieces.append((to, at, len(text), True))
    return "".join(parts), pieces


def _back(pieces, a: int, b: int) -> tuple[int, int]:
    """The span in the layer above of [a, b) of a layer from _undone."""
    i, j = (bisect_right(pieces, x, key=lambda p: p[0]) - 1 for x in (a, max(a, b - 1)))
    to, lo, _, plain = pieces[i]
    start = lo + (a - to if plain else 0)
    to, lo, hi, plain = pieces[j]
    return start, lo + (b - to) if plain else hi


def _escape(e: str) -> str:
    units = b"".join(int(x, 16).to_bytes(2, "little") for x in re.findall(r"[ux]([0-9a-fA-F]+)", e))
    return units.decode("utf-16-le", "replace")


_WHOLE = (
    ("url", ("%",), _PERCENT, lambda x: unquote_to_bytes(x).decode(errors="replace")),
    ("unicode", ("\\u", "\\x"), _ESCAPE, _escape),
)


def _base64s(text: str):
    """(start, end, bytes) of the base64 parts of a layer."""
    for m in _BASE64.finditer(text):
        raw = m.group().rstrip("=")
        if raw.isalpha() and (raw.islower() or raw.isupper() or raw[1:].islower()):
            continue  # a word
        body = raw.replace("-", "+").replace("_", "/")
        body = body[: len(body) - (len(body) % 4 == 1)]
        try:
            yield m.start(), m.end(), base64.b64decode(body + "=" * (-len(body) % 4))
        except (binascii.Error, ValueError):
            continue


_CODED = {  # where the magic of a stream may stand encoded: (sign, token, decoder)
    "url": (re.compile(r"%1[fF]%8[bB]|(?:x|%78)%(?:01|5[eE]|9[cC]|[dD][aA])|BZh\d|%42%5[aA]%68|%[fF][dD]7zXZ|%[fF][dD]%37"), re.compile(r"(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9_.~!*'()/-])+"), unquote_to_bytes),
    "unicode": (
        re.compile(r"\\x1[fF]\\x8[bB]|(?:x|\\x78)\\x(?:01|5[eE]|9[cC]|[dD][aA])|BZh\d|\\x42\\x5[aA]\\x68|\\x[fF][dD]7zXZ|\\x[fF][dD]\\x37"),
        re.compile(r"(?:\\x[0-9a-fA-F]{2}|\\[\\'\"nrt0]|[ !#-&(-\[\]-~])+"),
        lambda x: re.sub(rb"\\(x..|.)", lambda m: bytes([int(m[1][1:], 16)]) if m[1][:1] == b"x" else {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"0": b"\0"}.get(m[1], m[1]), x.encode()),
    ),
}
_MAGICS = re.compile(rb"\x1f\x8b|x[\x01\x5e\x9c\xda]|BZh\d|\xfd7zXZ\x00")


def _coded_streams(text: str):
    """(step, start, end, bytes) of compressed streams that stand percent-encoded or escaped in a layer."""
    for step, (sign, token, decode) in _CODED.items():
        if ("%" if step == "url" else "\\x") not in text or not sign.search(text):
            continue
        for m in token.finditer(text):
            if not sign.search(m.group()):
                continue
            raw = decode(m.group())
            end = m.start() + len(m.group().rstrip())
            for at in _MAGICS.finditer(raw):
                data = raw[at.start() :]
                if next(_inflated([data], _kind(data)), b""):
                    yield step, m.start(), end, data
                    break


def _matches(text: str):
    for rule, pattern in _COMPILED.items():
        if rule == "assignment":
            if not _WORDS.search(text):
                continue
        elif not any(x in text for x in _NEEDS[rule]):
            continue
        for m in pattern.finditer(text):
            if rule == "assignment":
                value = m.group("value")
                if entropy(value) < ENTROPY or value.isalpha():
                    continue
                yield rule, m.start("value"), m.end("value"), value
            else:
                yield rule, m.start(), m.end(), m.group()


def scan(text: str) -> list[tuple]:
    """(rule, layers, depth, span_start, span_end, sha256, preview) of one text."""
    out, seen, told, work = [], set(), set(), []

    def new(content, place, stream=False):
        raw = content if isinstance(content, bytes) else content.encode("utf-8", "surrogatepass")
        mark = stream, isinstance(content, bytes), hashlib.sha256(raw).digest(), place if isinstance(place, tuple) else None
        if mark in seen:
            return False
        seen.add(mark)
        return True

    def put(content, path, depth, place, whole):
        """place: the outermost part's span, or a chain of maps to the document's text. whole: it is the layer above, decoded."""
        if new(content, place):
            work.append((content, path, depth, place, whole))

    def span(place, a, b):
        if isinstance(place, tuple):
            return place
        for pieces in reversed(place):
            a, b = _back(pieces, a, b)
        return a, b

    def opened(pieces, kind, path, depth, place) -> bool:
        """Put what a stream inflates to on the worklist; False if it isn't a stream."""
        inner = _inflated(pieces, kind)
        first = _first(inner)
        if len(first) <= MAX_LAYER:
            if first:
                put(first, f"{path}>{kind}", depth + 1, place, False)
        elif new(first, place, True):
            work.append((chain([first], inner), f"{path}>{kind}", depth + 1, place, False))
        return bool(first)

    put(text, "", 0, [], False)
    while work:
        layer, path, depth, place, whole = work.pop()
        if isinstance(layer, chain):  # more bytes than are held at once
            head = next(layer, b"")
            kind = _kind(head)
            if kind and whole is False:
                opened(chain([head], layer), kind, path, depth, place)
                continue
            window, rest = _window(chain([head], layer))
            if rest:
                work.append((chain([rest], layer), path, depth, place, None))  # no beginning of a stream
            if new(window, place) and (content := _as_text(window)) is not None:
                put(content, path, depth, place, False)
            continue
        if isinstance(layer, bytes):  # bytes of a part: a stream, text or neither
            kind = _kind(layer)
            if not (kind and opened([layer], kind, path, depth, place)) and (content := _as_text(layer)) is not None:
                put(content, path, depth, place, False)
            continue
        for rule, a, b, value in _matches(layer):
            found = (rule, *span(place, a, b), hashlib.sha256(value.encode("utf-8", "surrogatepass")).hexdigest())
            if whole and found in told:
                continue
            told.add(found)
            out.append((rule, path or "text", depth, *found[1:], value[:4] + "*" * max(0, min(len(value), 12) - 4)))
        for a, b, data in _base64s(layer):
            put(data, f"{path}>base64" if path else "base64", depth + 1, span(place, a, b), False)
        for step, a, b, data in _coded_streams(layer):
            put(data, f"{path}>{step}" if path else step, depth + 1, span(place, a, b), False)
        for step, sign, pattern, decode in reversed(_WHOLE):
            if any(x in layer for x in sign) and (got := _undone(layer, pattern, decode)):
                put(got[0], f"{path}>{step}" if path else step, depth + 1, place if isinstance(place, tuple) else [*place, got[1]], True)
    return out


def findings(docs: DataFrame) -> DataFrame:
    """(doc_id, rule, layers, depth, span_start, span_end, secret_sha256, preview): a row a finding; spans in characters."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    types = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        for part, texts in K.text_batches(batches):
            rows, at = [], []
            for i, text in enumerate(texts.to_pylist()):
                for f in scan(text) if text else ():
                    rows.append(f)
                    at.append(i)
            if rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(at)), *columns], names=["doc_id", *(x.split()[0] for x in SCHEMA.split(", "))])

    return arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, {SCHEMA}")
