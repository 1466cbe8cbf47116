"""Byte-level BPE over whole batches: each distinct piece is encoded once."""

from __future__ import annotations

import base64
from functools import cache

import numpy as np
import pyarrow as pa

from . import kernels as K

#: Pieces that a worker remembers.
CACHE_PIECES = 150_000


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@cache
def encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks


class Encoder:
    """encode(texts): (ids, bounds of each text), as the tokenizer's own encode gives them."""

    def __init__(self, path: str | None = None, make=None):
        self.coder, self.ranks = encoding(path or default_ranks())
        self.known: dict[int, bytes] = {}
        self.make = make or (lambda piece: np.array(self.coder._core_bpe.encode_single_piece(piece.encode()), np.uint32).tobytes())
        self.width = 4

    def split(self, texts: pa.Array):
        text, cp, bounds = K.codepoints(K.strings(texts))
        start = K.pieces(cp, bounds)
        end = np.append(start[1:], len(cp))[: len(start)]
        return text, cp, bounds, start, end

    def table(self, text: str, cp: np.ndarray, start: np.ndarray, end: np.ndarray):
        """(values of the distinct pieces, their lengths and offsets, index of each piece)."""
        keys, first, index = K.uniques(K.Rolling(K.cp_values(cp)).span(start, end))
        if len(self.known) > CACHE_PIECES:
            self.known.clear()
        known, found = self.known, []
        for k, a, b in zip(keys.tolist(), start[first].tolist(), end[first].tolist(), strict=True):
            v = known.get(k)
            if v is None:
                v = self.make(text[a:b])
                if b - a < 64:
                    known[k] = v
            found.append(v)
        lens = np.fromiter(map(len, found), np.int64, len(found)) // self.width
        return b"".join(found), lens, np.cumsum(lens) - lens, index

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        text, cp, bounds, start, end = self.split(texts)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        values, lens, offs, index = self.table(text, cp, start, end)
        each = lens[index]
        ids = np.frombuffer(values, np.uint32)[K.ragged(each, offs[index])]
        upto = np.concatenate([[0], np.cumsum(each)])
        return ids, upto[np.searchsorted(start, bounds)]
