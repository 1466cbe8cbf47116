"""Vectorised text kernels over Arrow string columns.

Python workers get Arrow batches; these functions turn a string column into flat
numpy arrays (bytes, code points, words, pieces) without a Python object per row.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text that are expanded at once; a longer text goes alone, whole.
CHUNK_BYTES = 1 << 19
#: Texts that are expanded at once.
CHUNK_ROWS = 4000
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@cache
def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _grown(n: int) -> int:
    return max(1 << 16, 1 << int(n).bit_length())


class Rolling:
    """Polynomial hashes of any span of a sequence, from one prefix sum."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        size = _grown(n + 1)
        self.prefix = np.zeros(n + 1, U64)
        np.cumsum(values * _powers(size, _BASE)[:n], out=self.prefix[1:])
        self.inverse = _powers(size, _INVERSE)

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of values[start:end], wherever in the sequence it stands."""
        raw = (self.prefix[end] - self.prefix[start]) * self.inverse[start]
        return mix64(raw + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def strings(column: pa.Array) -> pa.Array:
    """A large_string array without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    return pc.fill_null(column, "") if column.null_count else column


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a column from strings()."""
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return (d[o[0] : o[-1]], o - o[0]) if len(o) else (d[:0], np.zeros(1, np.int64))


def slices(column: pa.Array, budget: int = CHUNK_BYTES, rows: int = CHUNK_ROWS) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most budget bytes; each has a row at least."""
    o = utf8(column)[1]
    at, n = 0, len(column)
    while at < n:
        to = int(np.searchsorted(o, o[at] + budget, "right")) - 1
        to = min(max(to, at + 1), at + rows, n)
        yield at, to
        at = to


_WORD = np.zeros(256, bool)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _WORD[_lo:_hi] = True
_BYTES = mix64(np.arange(1, 257, dtype=U64) * U64(_BASE))


class Words(NamedTuple):
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    """first[i]: index of the first word of text i; one entry more than texts."""


def words(column: pa.Array) -> Words:
    """Lower-case words: runs of ASCII letters, digits and non-ASCII characters."""
    data, o = utf8(strings(pc.utf8_lower(column)))
    n = len(data)
    inside = _WORD[data]
    edge = np.zeros(n + 1, bool)
    edge[o] = True
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return Words(data, start, end, Rolling(_BYTES[data]).span(start, end), np.searchsorted(start, o))


def owner(first: np.ndarray) -> np.ndarray:
    """The text of each element, from the bounds of each text."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def codepoints(column: pa.Array) -> tuple[str, np.ndarray, np.ndarray]:
    """(concatenated text, code points, bounds of each text)."""
    data, o = utf8(column)
    try:
        text = data.tobytes().decode()
        lead = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
        bounds = lead[o]
    except UnicodeDecodeError:  # bytes that aren't UTF-8: each text by itself
        raw = data.tobytes()
        each = [raw[a:b].decode(errors="replace") for a, b in zip(o[:-1], o[1:], strict=True)]
        text = "".join(each)
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in each], dtype=np.int64)])
    return text, np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), bounds


@cache
def classes() -> np.ndarray:
    """Of each code point: 1 letter, 2 number, 3 white space, 0 other."""
    out = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            out[cp] = 1
        elif kind == "N":
            out[cp] = 2
    out[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = 3
    return out


@cache
def _cp_values() -> np.ndarray:
    return mix64(np.arange(1, 0x110001, dtype=U64) * U64(_BASE))


def cp_values(cp: np.ndarray) -> np.ndarray:
    """Well mixed 64-bit words of code points, for Rolling."""
    return _cp_values()[cp]


def pieces(cp: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Starts of the pieces into which byte-level BPE splits texts before merging.

    The same split as the public pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+|
    ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`` makes, text by text.
    """
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    c = classes()[cp]
    head = np.zeros(n + 4, bool)
    head[bounds] = True
    edge = head[:n]
    s = edge.copy()
    s[1:] |= c[1:] != c[:-1]
    i = np.flatnonzero(s[1:] & (c[1:] != 3) & (c[:-1] == 3) & ~edge[1:]) + 1
    s[i - 1] = True
    s[i[cp[i - 1] == 32]] = False
    pad = np.concatenate([cp, np.zeros(4, np.uint32)])
    kinds = np.concatenate([c, np.full(4, 9, np.uint8)])
    i = np.flatnonzero(s & (cp == 39))
    i = i[(kinds[i + 1] == 1) & ~head[i + 1]]
    if len(i):
        a, b = pad[i + 1], pad[i + 2]
        two = ((((a == 114) | (a == 118)) & (b == 101)) | ((a == 108) & (b == 108))) & ~head[i + 2]
        one = (a == 115) | (a == 116) | (a == 109) | (a == 100)
        for j, k in ((i[one], 2), (i[two], 3)):
            s[j + 1] = False
            k = j + k
            k = k[(kinds[k] == 1) & ~head[k]]
            s[k] = True
    return np.flatnonzero(s)


def uniques(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, where each stands first, index of each key among the distinct)."""
    d = pa.array(keys).dictionary_encode()
    index = np.asarray(d.indices)
    first = np.empty(len(d.dictionary), np.int64)
    first[index[::-1]] = np.arange(len(keys) - 1, -1, -1)
    return np.asarray(d.dictionary), first, index


def ragged(lens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges starts[i] .. starts[i] + lens[i]."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lens), lens) + np.arange(total)


def text_batches(batches, text: str = "text", budget: int = CHUNK_BYTES):
    """(slice of the batch, its texts) of bounded size, over all batches."""
    for batch in batches:
        column = strings(batch.column(batch.schema.get_field_index(text)))
        for a, b in slices(column, budget):
            yield batch.slice(a, b - a), column.slice(a, b - a)
    give_back()


def give_back() -> None:
    """Return freed memory to the machine; a worker lives on after its task."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
