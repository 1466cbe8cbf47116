"""Quality classifier: interpolated modified Kneser-Ney character n-grams.

Models are trained on trusted text (documents labelled quality = 1), one per language
and fold. A document is scored by the model of the fold that it is not in, so no text
is scored by a model that has seen it. Its perplexity is held against a threshold, the
QUANTILE of the trusted texts of its language, so about 1 - QUANTILE of good text goes.

Counts are gathered by n-gram, context and suffix through sharded joins. Scoring looks
n-grams up in the model's key table: broadcast while it is at most ``lookup_rows`` long
(its size is counted first); beyond that documents are cut into chunks and the chunks'
distinct n-grams are joined with the table shard by shard.

Defined results: null or empty text has no perplexity and is kept; a null language is
the language ``und``; a language without trusted text has no model, and its documents
are kept; repeated rows each get a row; a label given twice counts as trusted if any
row says so. Columns besides doc_id, text and lang are carried by ``keep_good`` and
ignored by ``score``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewake.runtime import arrow, cut, fresh, small

from . import kernels as K

ORDER = 5
#: Rows of the model's key table that are broadcast at most (12 bytes each).
LOOKUP_ROWS = 8_000_000
#: Documents of a chunk, where keys are joined.
CHUNK_DOCS = 4000
#: Threshold: this quantile of the log-perplexities of a language's trusted texts.
QUANTILE = 0.99
#: Characters at the language's mean rate that are added to each text, so that a few words can't decide.
PRIOR_CHARS = 50
_PAD = "\x02"


def _padded(column: pa.Array) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """(text, code points, positions of real characters, characters of each text), each text led by ORDER - 1 pads."""
    import pyarrow.compute as pc

    text, cp, bounds = K.codepoints(K.strings(pc.binary_join_element_wise(pa.scalar(_PAD * (ORDER - 1), pa.large_string()), column, pa.scalar("", pa.large_string()))))
    lens = np.diff(bounds) - (ORDER - 1)
    at = K.ragged(lens, bounds[:-1] + ORDER - 1)
    return text, cp, at, lens


def _model_salt(model: np.ndarray) -> np.ndarray:
    return K.mix64(model.astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + np.uint64(1))


def _keys(roll: K.Rolling, end: np.ndarray, n: int, salt: np.ndarray, context: bool) -> np.ndarray:
    """Keys of the n characters before each end (as a context of the next, or as an n-gram)."""
    h = roll.span(end - n, end) if n else np.zeros(len(end), np.uint64)
    return K.mix64(h ^ salt ^ np.uint64((n << 1 | context) * 0x9FB21C651E98DF25 & (1 << 64) - 1))


def _count_grams(batches):
    for part, texts in K.text_batches(batches):
        text, cp, at, lens = _padded(texts)
        if not len(at):
            continue
        salt = np.repeat(_model_salt(np.asarray(part.column("model"))), lens)
        model = np.repeat(np.asarray(part.column("model")), lens)
        h = K.Rolling(K.cp_values(cp)).span(at - (ORDER - 1), at + 1) ^ salt
        _, first, index = K.uniques(h)
        starts = at[first] - (ORDER - 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(model[first]), pa.array([text[i : i + ORDER] for i in starts], pa.string()), pa.array(np.bincount(index, minlength=len(first)).astype(np.int64))],
            names=["model", "gram", "n"],
        )


def _hash_entries(batches):
    for b in batches:
        if not b.num_rows:
            continue
        grams = K.strings(b.column("gram"))
        _, cp, bounds = K.codepoints(grams)
        roll = K.Rolling(K.cp_values(cp))
        salt = _model_salt(np.asarray(b.column("model")))
        lens = np.diff(bounds)
        context = np.asarray(b.column("context").cast(pa.int8())).astype(bool)
        key = np.zeros(b.num_rows, np.uint64)
        for n in range(ORDER + 1):
            for c in (False, True):
                m = (lens == n) & (context == c)
                if m.any():
                    key[m] = _keys(roll, bounds[1:][m], n, salt[m], c)
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b.column("val").cast(pa.float32())], names=["key", "val"])


def entries(trusted: DataFrame) -> DataFrame:
    """(model, gram, context, val) of trusted(model, text).

    For an n-gram that was seen: the log of its interpolated probability. For a
    context: the log of the weight that is left to the next lower order.
    """
    top = cut(arrow(trusted.select("model", "text"), _count_grams, "model long, gram string, n long").groupBy("model", "gram").agg(F.sum("n").alias("v")))
    counts = {ORDER: top}
    for k in range(ORDER - 1, 0, -1):  # continuation counts: distinct left neighbours
        counts[k] = cut(counts[k + 1].groupBy("model", F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("v")))
    vocabulary = counts[1].groupBy("model").agg((F.count("*") + 1).cast("double").alias("vocab"))
    lower, out = None, []
    for k in range(1, ORDER + 1):
        n = [F.sum(F.when(F.col("v") == i, 1.0).otherwise(0.0)) for i in (1, 2, 3, 4)]
        d = counts[k].groupBy("model").agg(*[x.alias(f"n{i}") for i, x in enumerate(n, 1)])
        y = F.col("n1") / F.greatest(F.lit(1.0), F.col("n1") + 2 * F.col("n2"))
        for i in (1, 2, 3):
            d = d.withColumn(f"d{i}", F.greatest(F.lit(0.01), F.lit(float(i)) - (i + 1) * y * F.col(f"n{i + 1}") / F.greatest(F.lit(1.0), F.col(f"n{i}"))))
        if k == 1:
            d = d.join(F.broadcast(vocabulary), "model")
        d = F.broadcast(cut(d.drop("n1", "n2", "n3", "n4")))  # a row a model
        c = counts[k].withColumn("ctx", F.substring("gram", 1, k - 1)).join(d, "model")
        discount = F.when(F.col("v") == 1, F.col("d1")).when(F.col("v") == 2, F.col("d2")).otherwise(F.col("d3"))
        g = cut(c.groupBy("model", "ctx").agg(F.sum("v").alias("total"), (F.sum(discount) / F.sum("v")).alias("gamma")))
        p = c.join(g, ["model", "ctx"]).withColumn("own", (F.col("v") - discount) / F.col("total"))
        if k == 1:
            p = p.withColumn("low", 1.0 / F.col("vocab"))
            unseen = p.groupBy("model").agg((F.max("gamma") / F.max("vocab")).alias("u"))
            out.append(unseen.select("model", F.lit("").alias("gram"), F.lit(False).alias("context"), F.log("u").alias("val")))
        else:
            p = p.withColumn("suffix", F.substring("gram", 2, k - 1)).join(lower, ["model", "suffix"])
            out.append(g.select("model", F.col("ctx").alias("gram"), F.lit(True).alias("context"), F.log("gamma").alias("val")))
        p = cut(p.select("model", "gram", (F.col("own") + F.col("gamma") * F.col("low")).alias("p")))
        lower = p.select("model", F.col("gram").alias("suffix"), F.col("p").alias("low"))
        out.append(p.select("model", "gram", F.lit(False).alias("context"), F.log("p").alias("val")))
    all_ = out[0]
    for x in out[1:]:
        all_ = all_.unionByName(x)
    return all_


class _Table:
    """A sorted key table; get() tells values and which keys it has."""

    def __init__(self, keys: np.ndarray, vals: np.ndarray):
        self.keys, self.vals = keys, vals

    def get(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(k), np.float32), np.zeros(len(k), bool)
        order = np.argsort(k)  # neighbouring look-ups share cache lines
        i = np.empty(len(k), np.int64)
        i[order] = np.searchsorted(self.keys, k[order])
        i[i == len(self.keys)] = 0
        return self.vals[i], self.keys[i] == k


def _log_probabilities(table: _Table, roll: K.Rolling, at: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """ln P(character at each position | those before); NaN without a model."""
    out = np.zeros(len(at))
    todo = np.arange(len(at))
    for n in range(ORDER, -1, -1):
        val, there = table.get(_keys(roll, at[todo] + 1, n, salt[todo], False) if n else _keys(roll, at[todo], 0, salt[todo], False))
        out[todo[there]] += val[there]
        todo = todo[~there]
        if not len(todo):
            return out
        if n > 1:
            val, there = table.get(_keys(roll, at[todo], n - 1, salt[todo], True))
            out[todo[there]] += val[there]
    out[todo] = np.nan
    return out


def _scored(part: pa.RecordBatch, texts: pa.Array, table: _Table, model: str) -> tuple[np.ndarray, np.ndarray]:
    """(summed negative log-probability or NaN, characters) of each text."""
    _, cp, at, lens = _padded(texts)
    nll = np.full(len(texts), np.nan)
    if len(at):
        salt = np.repeat(_model_salt(np.asarray(part.column(part.schema.get_field_index(model)))), lens)
        roll = K.Rolling(K.cp_values(cp))
        h = roll.span(at - (ORDER - 1), at + 1) ^ salt
        _, first, index = K.uniques(h)
        lp = _log_probabilities(table, roll, at[first], salt[first])[index]
        full = np.flatnonzero(lens)
        nll[full] = -np.add.reduceat(lp, np.concatenate([[0], np.cumsum(lens[full])[:-1]]))
    return nll, lens


def _request(batches):
    """Every key that the texts of a chunk may ask for."""
    for part, texts in K.text_batches(batches):
        _, cp, at, lens = _padded(texts)
        if not len(at):
            continue
        model = np.asarray(part.column("model"))
        salt, chunk = np.repeat(_model_salt(model), lens), np.repeat(np.asarray(part.column("chunk")), lens)
        roll = K.Rolling(K.cp_values(cp))
        _, first, _ = K.uniques(K.mix64(roll.span(at - (ORDER - 1), at + 1) ^ salt) + chunk.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
        a, s, c = at[first], salt[first], chunk[first]
        keys = [_keys(roll, a + 1, n, s, False) for n in range(1, ORDER + 1)] + [_keys(roll, a, n, s, True) for n in range(1, ORDER)] + [_keys(roll, a, 0, s, False)]
        both = np.stack([np.tile(c, len(keys)).astype(np.uint64), np.concatenate(keys)])
        both = np.unique(both, axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(both[0].astype(np.int64)), pa.array(both[1].view(np.int64))], names=["chunk", "key"])


def score(docs: DataFrame, model_entries: DataFrame, nll: str = "nll", n: str = "n", model: str = "model", lookup_rows: int = LOOKUP_ROWS, chunks: int = 0) -> DataFrame:
    """docs (text and a model column among its columns) with each text's nll and characters."""
    table = cut(arrow(model_entries, _hash_entries, "key long, val float"))
    schema = T.StructType([*docs.schema.fields, T.StructField(nll, T.DoubleType()), T.StructField(n, T.LongType())])
    spark = docs.sparkSession

    def add(part, values, lens):
        return pa.RecordBatch.from_arrays([*part.columns, pa.array(values, from_pandas=True), pa.array(lens.astype(np.int64))], names=[*part.schema.names, nll, n])

    if table.count() <= lookup_rows:
        got = table.toArrow()
        keys = np.asarray(got.column("key").combine_chunks()).view(np.uint64)
        order = np.argsort(keys)
        sent = spark.sparkContext.broadcast((keys[order], np.asarray(got.column("val").combine_chunks())[order]))
        del got, keys, order

        def whole(batches):
            t = _Table(*sent.value)
            for part, texts in K.text_batches(batches):
                yield add(part, *_scored(part, texts, t, model))

        return arrow(docs, whole, schema)

    # by all columns, so that the copies of a text are in many chunks; a chunk is a group, not a partition
    (chunk,) = fresh(docs, "chunk")
    chunks = chunks or max(spark.sparkContext.defaultParallelism, docs.count() // CHUNK_DOCS + 1)
    spread = [F.col(f"`{f.name}`") for f in docs.schema if not isinstance(f.dataType, T.MapType)]
    cut_docs = docs.withColumn(chunk, F.pmod(F.xxhash64(*spread), F.lit(chunks)))
    rows = cut_docs.select(F.col(chunk).alias("chunk"), F.col(model).alias("model"), "text")
    asked = arrow(rows, _request, "chunk long, key long").distinct()
    answers = asked.join(table, "key")

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = np.asarray(right.column("key").combine_chunks()).view(np.uint64)
        order = np.argsort(keys)
        t = _Table(keys[order], np.asarray(right.column("val").combine_chunks())[order])
        left = left.drop_columns([chunk])
        rows = [add(p, *_scored(p, x, t, model)) for p, x in K.text_batches(left.to_batches())]
        return pa.Table.from_batches(rows) if rows else pa.Table.from_batches([], schema=add(left.slice(0, 0).combine_chunks().to_batches()[0], np.zeros(0), np.zeros(0)).schema)

    return cut_docs.groupBy(chunk).cogroup(answers.groupBy("chunk")).applyInArrow(one, schema)


def _with_model(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, str, str, str]:
    """docs with language, whether trusted, and the model that scores it (trains the other)."""
    lang, trusted, model, key = fresh(docs, "tw_lang", "tw_trusted", "tw_model", "tw_key")
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias(key)).distinct()
    df = docs.join(small(good), docs["doc_id"] == F.col(key), "left")
    df = df.withColumn(lang, F.coalesce("lang", F.lit("und"))).withColumn(trusted, F.col(key).isNotNull()).drop(key)
    fold = F.pmod(F.xxhash64("text"), F.lit(2))  # by text: copies are in one fold
    return df.withColumn(model, F.xxhash64(lang).bitwiseAND(F.lit(-2)) + fold), lang, trusted, model


def _rates(scored: DataFrame, lang: str, nll: str, n: str, quantile: float, prior: float, names: tuple = ("tw_of", "mean_rate", "limit_rate")) -> DataFrame:
    """A language's mean rate and threshold."""
    of, mean, limit = names
    means = scored.groupBy(lang).agg((F.sum(nll) / F.sum(n)).alias(mean))
    rate = (F.col(nll) + prior * F.col(mean)) / (F.col(n) + prior)
    q = scored.join(small(means), lang).groupBy(lang, mean).agg(F.percentile_approx(rate, quantile, 100_000).alias(limit))
    return q.select(F.col(lang).alias(of), mean, limit)


def judged(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, prior: float = PRIOR_CHARS, lookup_rows: int = LOOKUP_ROWS) -> tuple[DataFrame, dict]:
    """docs with scores, rates and thresholds; the names of the added columns."""
    df, lang, trusted, model = _with_model(docs, labels)
    nll, n, rate, mean, limit, of = fresh(df, "tw_nll", "tw_n", "tw_rate", "tw_mean", "tw_limit", "tw_of")
    c = {"lang": lang, "trusted": trusted, "nll": nll, "n": n, "rate": rate, "mean": mean, "limit": limit, "of": of}
    texts = df.where(F.col(trusted)).select((F.col(model).bitwiseXOR(F.lit(1))).alias("model"), "text")
    ent = cut(entries(texts))
    scored_trusted = cut(score(df.where(F.col(trusted)).select(lang, model, "text"), ent, nll, n, model, lookup_rows).where(F.col(nll).isNotNull()).select(lang, nll, n))
    limits = cut(_rates(scored_trusted, lang, nll, n, quantile, prior, (of, mean, limit)))
    out = score(df, ent, nll, n, model, lookup_rows).join(small(limits), F.col(lang) == F.col(of), "left")
    return out.withColumn(rate, (F.col(nll) + prior * F.col(mean)) / (F.col(n) + prior)), c


def classify(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """A row for each document: doc_id, lang, n_chars_scored, perplexity, threshold, keep."""
    out, c = judged(docs.select("doc_id", "text", "lang"), labels, **how)
    return out.select(
        "doc_id", F.col(c["lang"]).alias("lang"), F.col(c["n"]).alias("n_chars_scored"), F.exp(c["rate"]).alias("perplexity"), F.exp(c["limit"]).alias("threshold"),
        F.coalesce(F.col(c["rate"]) <= F.col(c["limit"]), F.lit(True)).alias("keep"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The documents that the classifier keeps, with the columns of docs."""
    out, c = judged(docs, labels, **how)
    return out.where(F.coalesce(F.col(c["rate"]) <= F.col(c["limit"]), F.lit(True))).select(*[f"`{x}`" for x in docs.columns])
