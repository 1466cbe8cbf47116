"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, in benchmark items and documents
alike: a number is a run of digits (with ``.`` or ``,`` between runs), a name is a run of
words with a capital in the middle of a sentence, a unit is a known unit word right after
a number. Windows of WINDOW template tokens with LITERALS other tokens at least are
hash-joined; an item of fewer tokens is one window by itself, if it has SHORT_LITERALS
literal tokens. Windows that match on one alignment of item and document must fill the
item's slots consistently: one name, number or unit of the item is one of the document
throughout.
A window's first token, if it has a capital, is a name or a literal: it stands for both.

Windows of WINDOW case-folded words (or of a short item's) are joined alike, numbers as
they are, so that a verbatim copy is found in any capitals and at any place.

The benchmark's windows are broadcast up to ``max_windows``; a larger benchmark is
taken in parts, one scan of the documents for each, and one part at a time is held by the
driver and the executors. Documents are never shuffled.

Defined results: null or empty texts, and items with too few literal tokens, match
nothing; repeated rows each get their own result rows; items that share a window each
get a row. Columns besides doc_id, text (item_id, text) are ignored by ``leaks`` and
carried by ``drop_leaks``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.runtime import arrow, cut

from . import kernels as K

WINDOW = 13
LITERALS = 8
SHORT_LITERALS = 5
MAX_WINDOWS = 4_000_000
UNITS = frozenset(
    "mm cm m km kg g mg lb lbs oz l ml in ft yd mi mile miles meter meters metre metres kilometer kilometers kilometre kilometres gram grams kilogram kilograms liter liters litre litres inch inches foot feet yard yards "
    "second seconds sec s minute minutes min hour hours hr h day days week weeks month months year years dollar dollars cent cents euro euros pound pounds percent mph kph degree degrees celsius watt watts volt volts "
    "heure heures jour jours semaine semaines mois an ans stunde stunden tag tage woche wochen monat monate jahr jahre hora horas dia dias semana semanas mes meses kilometros metros gramos".split()
)
_NUM, _NAME, _UNIT = (np.uint64(0x1000 + i) for i in range(3))


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each code point: in a word, a capital, its lower case."""
    import unicodedata

    inside = K.classes() % 3 != 0
    low = np.arange(0x110000, dtype=np.uint32)
    capital = np.zeros(0x110000, bool)
    for i in range(0x110000):
        kind = unicodedata.category(chr(i))
        if kind[0] == "M":
            inside[i] = True
        elif kind in ("Lu", "Lt"):
            capital[i] = True
            x = chr(i).lower()
            if len(x) == 1:
                low[i] = ord(x)
    return inside, capital, low


@cache
def _unit_hashes() -> np.ndarray:
    words = sorted(UNITS)
    _, cp, bounds = K.codepoints(K.strings(pa.array(words)))
    return np.sort(K.Rolling(K.cp_values(cp)).span(bounds[:-1], bounds[1:]))


class _Tokens:
    """Tokens of texts: code, place in the text, bounds of each text, and which have a capital."""

    def __init__(self, text: str, code: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, capital: np.ndarray):
        self.text, self.code, self.start, self.end, self.first, self.capital = text, code, start, end, first, capital
        self.literal = np.concatenate([[0], np.cumsum(code >> np.uint64(63), dtype=np.int64)])
        self.roll = K.Rolling(K.mix64(code))

    def windows(self, size: int, literals: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, first token) of the windows that lie in one text and have enough literals; two of one whose first token is a literal with a capital."""
        n = len(self.code)
        if n < size:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.arange(n - size + 1)
        of = np.searchsorted(self.first, at, "right")
        inside = at + size <= self.first[np.minimum(of, len(self.first) - 1)]
        some = self.literal[at + size] - self.literal[at]
        rest = lambda x: self.roll.span(x + 1, x + size) * np.uint64(0x9E3779B97F4A7C15)
        as_is = at[inside & (some >= literals)]
        named = at[inside & self.capital[at] & (some - 1 >= literals)]
        h = [K.mix64(rest(as_is) + self.code[as_is]), K.mix64(rest(named) + _NAME)]
        return np.concatenate(h), np.concatenate([as_is, named])

    def slot(self, i: int) -> str:
        return self.text[self.start[i] : self.end[i]].casefold()


class Template(_Tokens):
    """Template tokens of texts; plain: their words."""

    def __init__(self, texts: pa.Array):
        inside, capital, low = _tables()
        text, cp, bounds = K.codepoints(K.strings(texts))
        n = len(cp)
        head = np.zeros(n + 1, bool)
        head[bounds] = True
        w = inside[cp]
        start = np.flatnonzero(w & (np.concatenate([[True], ~w[:-1]])[:n] | head[:n]))
        end = np.flatnonzero(w & (np.concatenate([~w[1:], [True]])[-n or None :] | head[1:])) + 1 if n else start
        code = K.Rolling(K.cp_values(low[cp])).span(start, end) | np.uint64(1 << 63)
        number = K.classes()[cp[start]] == 2
        pad = np.concatenate([np.zeros(2, np.uint32), cp])
        before, before2 = pad[start + 1], pad[start]
        same = ~head[np.maximum(start - 1, 0)] & ~head[start] & (start > 1)
        name = capital[cp[start]] & same & (before == 32) & (inside[before2] | (before2 == 44))
        gap = np.concatenate([[9], start[1:] - end[:-1]]) if len(start) else start
        first = np.searchsorted(start, bounds)
        fresh = np.zeros(len(start) + 1, bool)
        fresh[first] = True
        joined = ~fresh[: len(start)] & (gap == 1)
        prev_number, prev_name = (np.concatenate([[False], x[:-1]])[: len(start)] for x in (number, name))
        unit = joined | ((gap == 0) & ~fresh[: len(start)])
        unit &= prev_number & np.isin(code & np.uint64((1 << 63) - 1), _unit_hashes() & np.uint64((1 << 63) - 1))
        more = joined & ((number & prev_number & ((before == 46) | (before == 44))) | (name & prev_name))
        words = np.where(number, code & np.uint64((1 << 63) - 1), code)
        self.plain = _Tokens(text, words, start, end, first, np.zeros(len(start), bool))
        code[number], code[name], code[unit] = _NUM, _NAME, _UNIT
        keep = np.flatnonzero(~more)
        last = np.append(keep[1:], len(start)) - 1
        ends = end[last] if len(start) else end
        super().__init__(text, code[keep], start[keep], ends, np.searchsorted(keep, first), (capital[cp[start]] & (code >> np.uint64(63) == 1))[keep])


class Index:
    """Windows of some benchmark items."""

    def __init__(self, ids: list, texts: list, window: int, literals: int, short: int):
        self.ids, self.t = ids, Template(pa.array(texts, pa.string()))
        self.by_size = [(t is self.t, size, *found) for t in (self.t, self.t.plain) for size, found in self._sizes(t, window, literals, short).items()]

    @staticmethod
    def _sizes(t: _Tokens, window: int, literals: int, short: int) -> dict[int, tuple]:
        """{size: (sorted hashes, first tokens, literals)}"""
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
        found[window].append(t.windows(window, literals))
        sizes = np.diff(t.first)
        for n in np.unique(sizes[(sizes < window) & (sizes > 0)]):
            h, at = t.windows(int(n), short)
            whole = np.isin(at, t.first[:-1][sizes == n])
            found[int(n)].append((h[whole], at[whole]))
        out = {}
        for size, parts in found.items():
            h, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(h, kind="stable")
            out[size] = h[order], at[order], literals if size == window else short
        return out

    def matches(self, t: Template):
        """{(text, item): ([(token in the text, token in the item, size)], the same of words)}"""
        out = defaultdict(lambda: (set(), set()))
        for template, size, keys, item_at, literals in self.by_size:
            if not len(keys):
                continue
            own, its = (self.t, t) if template else (self.t.plain, t.plain)
            h, at = its.windows(size, literals)
            i = np.searchsorted(keys, h)
            i[i == len(keys)] = 0
            for k in np.flatnonzero(keys[i] == h):
                j = i[k]
                while j < len(keys) and keys[j] == h[k]:
                    item = int(np.searchsorted(own.first, item_at[j], "right")) - 1
                    text = int(np.searchsorted(its.first, at[k], "right")) - 1
                    out[text, item][not template].add((int(at[k]), int(item_at[j]), size))
                    j += 1
        return out

    def best(self, t: Template, item: int, hits: tuple[set, set]):
        """(windows, share of the item's tokens covered, verbatim, first token) of the best alignment, or None; of words where they cover more than consistent templates."""
        out = None
        for own, its, found, kind in ((self.t, t, hits[0], None), (self.t.plain, t.plain, hits[1], True)):
            if got := found and self._consistent(own, its, found):
                share = got[1] / int(own.first[item + 1] - own.first[item])
                if out is None or share > out[1] or share == out[1] and kind and not out[2]:
                    first = got[3] if kind is None else int(np.searchsorted(t.start, its.start[got[3]], "right")) - 1
                    out = got[0], share, kind or got[2], first
        return out

    @staticmethod
    def _consistent(own: _Tokens, its: _Tokens, hits: set[tuple[int, int, int]]):
        """(windows, item tokens covered, verbatim, first token) of the best alignment without a contradiction."""
        by = defaultdict(list)
        for a, b, size in sorted(hits):
            by[a - b].append((a, b, size))
        best = None
        for shift, every in by.items():
            strict = [x for x in every if own.code[x[1]] == its.code[x[0]]]  # without those whose first token is a name here, a literal there
            for group in (every, strict) if 0 < len(strict) < len(every) else (every,):
                covered, names, ok, same = set(), {}, True, True
                for _, b, size in group:
                    covered.update(range(b, b + size))
                for b in covered:
                    here, there = own.code[b], its.code[b + shift]
                    if here >> np.uint64(63) and here == there:
                        continue
                    x, y = own.slot(b), its.slot(b + shift)
                    same &= x == y
                    if names.setdefault((here if here in (_NUM, _UNIT) else _NAME, x), y) != y:
                        ok = False
                        break
                if ok:
                    if best is None or len(covered) > best[1]:
                        best = (len(group), len(covered), same, min(a for a, _, _ in group))
                    break
        return best


def _indexes(benchmark: DataFrame, window: int, literals: int, short: int, max_windows: int) -> tuple[int, Iterator[Index]]:
    """(number of parts, the parts' indexes, made one by one)."""
    items = benchmark.where("text is not null").select("item_id", "text")
    words = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-words // (3 * max_windows)))

    def each():
        for p in range(parts):
            part = items if parts == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == p)
            got = part.toArrow()
            yield Index(got.column("item_id").to_pylist(), got.column("text").to_pylist(), window, literals, short)

    return parts, each()


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, literals: int = LITERALS, short: int = SHORT_LITERALS, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """(doc_id, item_id, windows, covered, kind, first_token): a row for each item in each document.

    kind is verbatim if all slots agree, else reparameterised; covered is the share of
    the item's template tokens, or of its words where those are covered better.
    """
    types = [docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()]
    doc_type, item_type = (pa.int64() if x in ("bigint", "long") else pa.int32() if x == "int" else pa.string() for x in types)

    def scan(sent):
        def run(batches):
            index = sent.value
            for part, texts in K.text_batches(batches):
                t = Template(texts)
                rows = []
                ids = part.column("doc_id")
                for (text, item), hits in index.matches(t).items():
                    if best := index.best(t, item, hits):
                        rows.append((ids[text].as_py(), index.ids[item], best[0], best[1], "verbatim" if best[2] else "reparameterised", best[3] - int(t.first[text])))
                if rows:
                    c = list(zip(*rows, strict=True))
                    kinds = (doc_type, item_type, pa.int64(), pa.float64(), pa.string(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds, strict=True)], names=["doc_id", "item_id", "windows", "covered", "kind", "first_token"])

        return run

    sc, found = docs.sparkSession.sparkContext, []
    parts, indexes = _indexes(benchmark, window, literals, short, max_windows)
    for index in indexes:
        sent = sc.broadcast(index)
        del index
        part = arrow(docs.select("doc_id", "text"), scan(sent), f"doc_id {types[0]}, item_id {types[1]}, windows long, covered double, kind string, first_token long")
        if parts > 1:  # a row a leak
            part = cut(part)
            sent.destroy()
        found.append(part)
    return reduce(DataFrame.unionByName, found)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, literals: int = LITERALS, short: int = SHORT_LITERALS, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """docs without those that hold a benchmark item's window, with their columns."""
    sc = docs.sparkSession.sparkContext
    place = docs.columns.index("text")

    def clean(sent):
        def run(batches):
            index = sent.value
            for batch in batches:
                column = K.strings(batch.column(place))
                for a, b in K.slices(column):
                    t = Template(column.slice(a, b - a))
                    keep = np.ones(b - a, bool)
                    for (text, item), hits in index.matches(t).items():
                        if keep[text] and index.best(t, item, hits):
                            keep[text] = False
                    yield batch.slice(a, b - a).filter(pa.array(keep))
            K.give_back()

        return run

    parts, indexes = _indexes(benchmark, window, literals, short, max_windows)
    for index in indexes:
        if parts == 1:
            return arrow(docs, clean(sc.broadcast(index)), docs.schema)
        sent = sc.broadcast(index)
        del index
        docs = cut(arrow(docs, clean(sent), docs.schema))
        sent.destroy()
    return docs
