"""Toxicity: a logistic classifier that is regularised by counterfactuals.

Features are a text's distinct words and word beginnings, hashed into slots; those that
tell the classes apart in the fitting sample are used. The model is fitted on labelled
documents. Labelled sentences that name a group (an identity term) are copied with the
term swapped for each of a few others of its language, and the squared change of score
(logit) is added to the loss, times ``penalty``: a group's name alone can't move a score,
so neutral mentions of groups aren't held against a text.

A bounded sample of labelled documents is used for fitting (``sample`` of either class and
``sample_chars`` characters of those, the ones that come first by a hash of doc_id; one row
of a doc_id that repeats); every document is scored, whole.

Defined results: null or empty text has score sigmoid(bias) and isn't toxic; without
labels of both kinds nothing is toxic and scores are null; a doc_id labelled twice is
toxic if any row says so; repeated rows each get a row; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewake.runtime import arrow

from . import kernels as K

SLOT_BITS = 20
#: Bytes of word beginnings that are features besides whole words.
BEGINNINGS = (4, 5, 6, 7, 8)
#: Labelled documents of each class that the model is fitted on at most, and their characters.
SAMPLE, SAMPLE_CHARS = 4_000, 60_000_000
#: Chi-square with which a feature tells the classes apart, at least.
CHI2 = 12.0
PENALTY = 5.0
L2 = 3e-4
#: Fitting documents that have a word at least, else it has no weight: a word of few documents only names them.
LEAST_DOCS = 5
ROUNDS = 400
SWAPS = 3
THRESHOLD = 0.5
IDENTITY = {
    "en": "women men muslims christians jews buddhists hindus atheists immigrants refugees asians africans europeans americans mexicans black white gay straight lesbian transgender disabled deaf blind old young",
    "fr": "femmes hommes musulmans chrétiens juifs bouddhistes athées immigrés réfugiés asiatiques africains européens noirs blancs gays lesbiennes handicapés sourds aveugles vieux jeunes",
    "de": "frauen männer muslime christen juden buddhisten atheisten einwanderer flüchtlinge asiaten afrikaner europäer schwarze weiße schwule lesben behinderte gehörlose blinde alte junge",
    "es": "mujeres hombres musulmanes cristianos judíos budistas ateos inmigrantes refugiados asiáticos africanos europeos negros blancos gays lesbianas discapacitados sordos ciegos viejos jóvenes",
}
_LISTS = {lang: ws.split() for lang, ws in IDENTITY.items()}
_OWN = {lang: {w: ws for w in ws} for lang, ws in _LISTS.items()}
#: For texts of an unknown language: the terms that one language alone has.
_OWN[None] = {w: ws for ws in _LISTS.values() for w in ws if sum(w in x for x in _LISTS.values()) == 1}
_TERM = {lang: re.compile(r"\b(" + "|".join(sorted(terms, key=len, reverse=True)) + r")\b", re.IGNORECASE) for lang, terms in _OWN.items()}
_SENTENCE = re.compile(r"[^.!?\n]+[.!?]?")


def features(texts: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(slots of the distinct words and word beginnings, bounds of each text); only those wanted, if given."""
    w = K.words(texts)
    doc = K.owner(w.first).astype(np.uint64)
    roll = K.Rolling(K._BYTES[w.data])
    slots, docs = [w.hash >> np.uint64(64 - SLOT_BITS)], [doc]
    for n in BEGINNINGS:
        long = w.end - w.start > n
        slots.append(K.mix64(roll.span(w.start[long], w.start[long] + n) + np.uint64(n)) >> np.uint64(64 - SLOT_BITS))
        docs.append(doc[long])
    slot, of = np.concatenate(slots), np.concatenate(docs)
    if wanted is not None:
        m = wanted[slot]
        slot, of = slot[m], of[m]
    key = np.sort(of << np.uint64(SLOT_BITS) | slot)
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    bounds = np.searchsorted(key, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(SLOT_BITS))
    return (key & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64), bounds


def swapped(text: str, lang: str | None = None, swaps: int = SWAPS) -> list[tuple[str, str]]:
    """(sentence, the same with its identity term swapped) pairs, terms of the same language."""
    lang, out = lang if lang in _LISTS else None, []
    for m in _SENTENCE.finditer(text):
        sentence = m.group()
        for t in _TERM[lang].finditer(sentence):
            own = t.group().lower()
            terms = _OWN[lang].get(own)
            if not terms:  # a letter whose lower case is written otherwise
                continue
            at = terms.index(own)
            for k in range(1, swaps + 1):
                out.append((sentence, sentence[: t.start()] + terms[(at + k * 5) % len(terms)] + sentence[t.end() :]))
    return out


def _sums(w: np.ndarray, slots: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0.0], np.cumsum(w[slots])])
    return upto[bounds[1:]] - upto[bounds[:-1]]


def fit(texts: list[str], toxic: np.ndarray, penalty: float = PENALTY, l2: float = L2, rounds: int = ROUNDS, langs: list | None = None) -> tuple[np.ndarray, float]:
    """(weights, bias) by full-batch Adam; the clean class weighs three times the toxic one."""
    def many(x: list[str], wanted=None):
        s, b = [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
        column = K.strings(pa.array(x, pa.string()))
        for i, j in K.slices(column):
            slots, bounds = features(column.slice(i, j - i), wanted)
            s.append(slots)
            b.append(bounds[1:] + b[-1][-1])
        return np.concatenate(s), np.concatenate(b)

    y = toxic.astype(float)
    column = K.strings(pa.array(texts, pa.string()))
    yes, no = np.zeros(1 << SLOT_BITS), np.zeros(1 << SLOT_BITS)
    for i, j in K.slices(column):
        slots, bounds = features(column.slice(i, j - i))
        of = y[i:j][K.owner(bounds)] > 0
        yes += np.bincount(slots[of], minlength=1 << SLOT_BITS)
        no += np.bincount(slots[~of], minlength=1 << SLOT_BITS)
    n1, n0 = y.sum(), (1 - y).sum()
    share = (yes + no) / (n1 + n0)
    with np.errstate(divide="ignore", invalid="ignore"):
        chi2 = (yes / n1 - no / n0) ** 2 / (share * (1 - share) * (1 / n1 + 1 / n0))
    wanted = (chi2 >= CHI2) & (yes + no >= LEAST_DOCS)
    used = np.flatnonzero(wanted)
    place = np.cumsum(wanted) - 1
    x, bounds = many(texts, wanted)
    pairs = [p for t, lang in zip(texts, langs or [None] * len(texts), strict=True) for p in swapped(t, lang)]
    (xa, ba), (xb, bb) = many([a for a, _ in pairs], wanted), many([b for _, b in pairs], wanted)
    x, xa, xb = place[x], place[xa], place[xb]
    weight = np.where(y > 0, 0.25 / max(n1, 1), 0.75 / max(n0, 1))
    w, bias = np.zeros(len(used)), 0.0
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    row, ra, rb = K.owner(bounds), K.owner(ba), K.owner(bb)
    for step in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(_sums(w, x, bounds) + bias, -30, 30)))
        g = weight * (p - y)
        grad = np.bincount(x, g[row], len(used)) + l2 * w
        if pairs:
            d = 2 * penalty / len(pairs) * (_sums(w, xa, ba) - _sums(w, xb, bb))
            grad += np.bincount(xa, d[ra], len(used)) - np.bincount(xb, d[rb], len(used))
        full = np.append(grad, g.sum())
        m = 0.9 * m + 0.1 * full
        v = 0.99 * v + 0.01 * full**2
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, bias = w - move[:-1], bias - move[-1]
    dense = np.zeros(1 << SLOT_BITS, np.float32)
    dense[used] = w
    return dense, float(bias)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, penalty: float = PENALTY, sample_chars: int = SAMPLE_CHARS) -> tuple[np.ndarray, float] | None:
    lang = F.lower(F.substring_index("lang", "-", 1)) if "lang" in docs.columns else F.lit(None).cast("string")
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    first = [marks.where(c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for c in ("toxic > 0", "toxic <= 0")]
    chosen = first[0].unionByName(first[1])
    rows = docs.select("doc_id", "text", lang.alias("lang")).where("text is not null").join(F.broadcast(chosen), "doc_id")  # at most twice `sample` rows on the broadcast side
    one = F.struct(F.xxhash64("text").alias("h"), "text", "lang")  # of a doc_id that repeats, one row
    rows = rows.groupBy("doc_id", "toxic").agg(F.min(one).alias("x")).select("doc_id", "toxic", "x.text", "x.lang")
    upto = F.sum(F.length("text")).over(Window.partitionBy(F.col("toxic") > 0).orderBy(F.xxhash64("doc_id"), "doc_id"))  # of `sample` rows each
    got = rows.withColumn("upto", upto).where(F.col("upto") <= sample_chars).orderBy("doc_id").select("text", "toxic", "lang").toArrow()
    y = np.array(got.column("toxic").to_pylist(), float)
    if not len(y) or y.min() == y.max():
        return None
    return fit(got.column("text").to_pylist(), y, penalty, langs=got.column("lang").to_pylist())


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, penalty: float = PENALTY, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, toxic): a row for each document."""
    model = train(docs, labels, sample, penalty)
    if model is None:
        return docs.select("doc_id", F.lit(None).cast("double").alias("score"), F.lit(False).alias("toxic"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 4 MB, whatever the input

    def run(batches):
        w, bias = sent.value
        wanted = w != 0
        for part, texts in K.text_batches(batches):
            slots, bounds = features(texts, wanted)
            z = _sums(w, slots, bounds) + bias
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p), pa.array((p >= threshold) & (np.diff(bounds) > 0))], names=["doc_id", "score", "toxic"])

    return arrow(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, toxic boolean")
