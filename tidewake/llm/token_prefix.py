"""Token counts of every prefix, by prefix dynamic programming.

For each character position of a text the exact number of tokens that the text up to
there has is stored, so that a cut at any place, or the longest prefix within a budget,
is read off without encoding again.

Inside a piece (the unit that byte-level BPE merges in) the last token of each prefix
follows from those before: a prefix's encoding is that of a shorter prefix and one more
token, and it is the token whose pair with the shorter prefix's last token doesn't merge
further. Distinct pieces are computed once; a text's counts are the pieces' counts on
top of the totals before them. The last character of a run of white space is counted as
the end of the run, as a text cut there is split.

Counts are stored as differences between neighbours, one signed byte each (``width`` 1;
2 or 4 bytes if a difference needs it), and are never cut short.

Defined results: null text has null counts; empty text has 0 tokens and no differences;
repeated rows each get a row; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.runtime import arrow

from . import kernels as K
from .bpe import Encoder, default_ranks

#: Token budgets whose longest prefixes the query reports.
BUDGETS = (512, 2048)
#: Bytes of a piece's beginning that are kept for other pieces, and entries that a worker remembers.
HEAD = 6
CACHE_HEADS, CACHE_PAIRS = 40_000, 200_000


class PrefixCounter:
    """Counts of the prefixes of pieces and texts."""

    def __init__(self, path: str | None = None):
        self.encoder = Encoder(path, self._piece)
        self.coder, self.ranks = self.encoder.coder, self.encoder.ranks
        self.longest = max(map(len, self.ranks))
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.heads: dict[bytes, tuple[list, list, list]] = {}
        self.single = self.coder._core_bpe.encode_single_piece

    def counts(self, piece: str) -> list[int]:
        """Tokens of each prefix of a piece, by characters."""
        if piece[0] == "'" and 1 < len(piece) <= 3:  # a contraction's prefixes are split otherwise
            return [len(self.coder.encode_ordinary(piece[:i])) for i in range(1, len(piece) + 1)]
        data, ranks, pairs, longest, heads = piece.encode("utf-8", "surrogatepass"), self.ranks, self.pairs, self.longest, self.heads
        n = len(data)
        at = min(n, HEAD)
        while at and data[:at] not in heads:
            at -= 1
        if at:  # go on from a prefix that another piece had
            count, last, whole = (x[:] for x in heads[data[:at]])
        else:
            count, last, whole = [0], [b""], [0]
        for i in range(at + 1, n + 1):
            for size in range(1, min(i, longest) + 1):
                t = data[i - size : i]
                if t not in ranks:
                    continue
                before = last[i - size]
                if before:
                    ok = pairs.get((before, t))
                    if ok is None:
                        ok = pairs[before, t] = self.single(before + t) == [ranks[before], ranks[t]]
                    if not ok:
                        continue
                count.append(count[i - size] + 1)
                last.append(t)
                break
            whole.append(1 if data[:i] in ranks else count[i])
        if at < min(n, HEAD):
            head = min(n, HEAD)
            heads[data[:head]] = (count[: head + 1], last[: head + 1], whole[: head + 1])
        if len(pairs) > CACHE_PAIRS:
            pairs.clear()
        if len(heads) > CACHE_HEADS:
            heads.clear()
        if n == len(piece):
            return whole[1:]
        ends = np.flatnonzero(np.frombuffer(data + b"a", np.uint8)[1:] & 0xC0 != 0x80) + 1
        return [whole[i] for i in ends.tolist()]

    def _piece(self, piece: str) -> bytes:
        return np.array(self.counts(piece), np.int32).tobytes()

    def prefixes(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(tokens up to and with each character, bounds of each text in characters)."""
        text, cp, bounds, start, end = self.encoder.split(texts)
        if not len(start):
            return np.zeros(0, np.int64), bounds
        values, lens, offs, index = self.encoder.table(text, cp, start, end)
        pool = np.frombuffer(values, np.int32)
        inside = pool[K.ragged(lens[index], offs[index])].astype(np.int64)
        full = pool[(offs + lens - 1)[index]]
        before = np.concatenate([[0], np.cumsum(full)])
        first = np.searchsorted(start, bounds)  # pieces of each text
        out = inside + np.repeat(before[:-1] - before[first[:-1]][np.searchsorted(first, np.arange(len(start)), "right") - 1], lens[index])
        # the end of a run of two or more white-space characters before other text
        space = K.classes()[cp] == 3
        head = np.zeros(len(cp) + 1, bool)
        head[bounds] = True
        close = np.flatnonzero(space[1:-1] & space[:-2] & ~space[2:] & ~head[1:-2] & ~head[2:-1]) + 1 if len(cp) > 2 else []
        for i in close:
            a = int(i)
            while a > 0 and space[a - 1] and not head[a]:
                a -= 1
            base = out[a - 1] if a > 0 and not head[a] else 0
            out[i] = base + len(self.single(text[a : i + 1].encode()))
        return out, bounds


def _differences(batches, path: str, budgets):
    counter = PrefixCounter(path)
    for part, texts in K.text_batches(batches):
        upto, bounds = counter.prefixes(texts)
        diff = np.diff(upto, prepend=0)
        starts = bounds[:-1][np.diff(bounds) > 0]
        diff[starts] = upto[starts]
        null = np.asarray(part.column("text").is_null())
        rows, widths, cuts = [], [], {b: [] for b in budgets}
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            d = diff[a:b]
            top = int(np.abs(d).max()) if b > a else 0
            width = 1 if top < 128 else 2 if top < 1 << 15 else 4
            rows.append(d.astype(f"<i{width}").tobytes())
            widths.append(width)
            for budget in budgets:
                fit = np.flatnonzero(upto[a:b] <= budget)
                cuts[budget].append(int(fit[-1]) + 1 if len(fit) else 0)
        total = np.where(np.diff(bounds) > 0, upto[np.maximum(bounds[1:] - 1, 0)] if len(upto) else 0, 0)
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(np.diff(bounds), mask=null), pa.array(total.astype(np.int64), mask=null), pa.array(widths, pa.int32()), pa.array(rows, pa.binary(), mask=null), *[pa.array(np.array(cuts[b], np.int64), mask=null) for b in budgets]],
            names=["doc_id", "n_prefixes", "n_tokens", "width", "differences", *(f"fits_{b}" for b in budgets)],
        )


def prefix_counts(docs: DataFrame, ranks: str | None = None, budgets=BUDGETS) -> DataFrame:
    """(doc_id, n_prefixes, n_tokens, width, differences, fits_B..): a row for each document.

    fits_B is the length in characters of the longest prefix of at most B tokens.
    """
    path = ranks or default_ranks()
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_prefixes long, n_tokens long, width int, differences binary, {', '.join(f'fits_{b} long' for b in budgets)}"
    return arrow(docs.select("doc_id", "text"), lambda batches: _differences(batches, path, budgets), schema)


def answer(counts: DataFrame, questions: DataFrame) -> DataFrame:
    """questions(doc_id, n_chars, budget) with tokens of the first n_chars characters and the longest prefix within budget.

    Read from the stored differences; either question may be null, and n_chars beyond the
    text counts as its end.
    """
    both = questions.join(counts.select("doc_id", "width", "differences"), "doc_id", "left")

    def run(batches):
        for b in batches:
            tokens, fits = [], []
            for n, budget, width, data in zip(*(b.column(c).to_pylist() for c in ("n_chars", "budget", "width", "differences")), strict=True):
                upto = None if data is None else np.cumsum(np.frombuffer(data, f"<i{width}").astype(np.int64))
                tokens.append(None if upto is None or n is None else int(upto[min(n, len(upto)) - 1]) if n > 0 and len(upto) else 0)
                ok = [] if upto is None or budget is None else np.flatnonzero(upto <= budget)
                fits.append(None if upto is None or budget is None else int(ok[-1]) + 1 if len(ok) else 0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_chars"), b.column("budget"), pa.array(tokens, pa.int64()), pa.array(fits, pa.int64())], names=["doc_id", "n_chars", "budget", "tokens", "fits"])

    q = both.select("doc_id", F.col("n_chars").cast("long"), F.col("budget").cast("long"), "width", "differences")
    return arrow(q, run, f"doc_id {questions.schema['doc_id'].dataType.simpleString()}, n_chars long, budget long, tokens long, fits long")
