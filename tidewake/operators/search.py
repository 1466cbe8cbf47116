"""Ids and their parts, lookups by name, baselines and the signals of files."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewake.operators.text import bm25, top_k
from tidewake.runtime import TASK_PAIRS, cut, ship, small, spread

#: Share of equal characters that a suggestion has at least.
LIKENESS = 0.6
TEST_FILES = r"(^|/)tests?(/|_|$)|(^|/)test_|\.test\.|\.spec\."


def symbol_file(id):
    """The part of an id before its first colon."""
    return F.substring_index(id, ":", 1)


def symbol_name(id):
    """The part after the first colon; the whole id without one."""
    return F.substr(id, F.instr(id, ":") + 1)


def bare_name(name):
    """The last part of a dotted name."""
    return F.element_at(F.split(name, r"\."), -1)


def is_test_file(path):
    return F.col(path).rlike(TEST_FILES)


def subsystem(path, root: str = "django", nested: str = "contrib"):
    """The first folder below root, with one more below nested; else the first folder."""
    p = F.split(F.regexp_replace(path, r"^(\./)+", ""), "/")
    deep = F.concat_ws("/", F.element_at(p, 2), F.element_at(p, 3))
    return F.when((F.size(p) >= 3) & (p[0] == root) & (p[1] == nested), deep).when((F.size(p) >= 2) & (p[0] == root), p[1]).otherwise(p[0])


def role(score, is_changed):
    """changed, impacted from 70 points on, else dependency."""
    return F.when(is_changed, "changed").when(score >= 70, "impacted").otherwise("dependency")


def hostname(url):
    """The lower-case host of scheme://[user@]host or of user@host:path."""
    u = F.lower(F.trim(F.col(url)))
    plain = F.regexp_extract(u, r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?(\[[0-9a-f:.]+\]|[^/:?#]+)", 1)
    short = F.regexp_extract(u, r"^[^/@:\s]+@([^/:\s]+):", 1)
    host = F.when(plain != "", plain).otherwise(short)
    return F.when(host != "", F.regexp_replace(host, r"^\[|\]$", ""))


def clone_url_problem(url):
    """Why a URL isn't to be cloned: another scheme, no host, credentials, or a host of this machine or a private net; null if none."""
    u, host = F.lower(F.trim(F.col(url))), hostname(url)
    private = host.rlike(r"^(localhost|.*\.local|.*\.internal|0\.0\.0\.0|127\.\d+\.\d+\.\d+|10\.\d+\.\d+\.\d+|192\.168\.\d+\.\d+|169\.254\.\d+\.\d+|172\.(1[6-9]|2\d|3[01])\.\d+\.\d+|::1|f[cd][0-9a-f]{2}:.*|fe80:.*)$")
    return F.when(u.isNull() | ~u.rlike(r"^https?://"), "scheme").when(host.isNull(), "host").when(u.rlike(r"^https?://[^/?#]*@"), "credentials").when(private, "private")


def same_file(symbols: DataFrame, changed: DataFrame) -> DataFrame:
    """(query_id, id) of symbols(id, file) in a file of a changed(query_id, id), those left out."""
    files = changed.join(symbols.select("id", "file"), "id").select("query_id", "file").distinct()
    return symbols.join(files, "file").select("query_id", "id").join(changed.select("query_id", "id"), ["query_id", "id"], "left_anti")


def scores_for_symbols(symbols: DataFrame, file_scores: DataFrame) -> DataFrame:
    """(query_id, id, score): each symbol has the score of its file."""
    return symbols.select("id", "file").join(file_scores, "file").select("query_id", "id", "score")


def bm25_baseline(symbols: DataFrame, query_ids: DataFrame, k: int) -> DataFrame:
    """The k best of the other symbols by BM25 for each symbol asked for."""
    asked = symbols.join(small(query_ids.select(F.col("query_id").alias("id")).distinct()), "id", "left_semi").select(F.col("id").alias("query_id"), F.col("code").alias("text"))
    scores = bm25(symbols, asked, k + 1).where("id <> query_id")  # one more than k: its own
    return top_k(scores.withColumn("score", F.round("score", 6)), k)


def random_baseline(ids: DataFrame, queries: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """(query_id, id, rank): k ids of ids(id) by a SHA-256 of seed, query and id; each query is held against all ids.

    Draws are uniform, so those under a bound that about 4 k + 40 of a query reach are
    ranked first; a query with fewer than k under it is ranked again with all of its draws.
    """
    draw = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("query_id").cast("string"), F.col("id").cast("string")), 256)
    asked = cut(queries.select("query_id").distinct())
    n, m = ids.count(), asked.count()

    def drawn(of):
        every = spread(ids.select("id"), n * m, each=TASK_PAIRS).crossJoin(small(of))
        return every.where(~F.col("id").eqNullSafe(F.col("query_id"))).withColumn("draw", draw)

    share = (4 * k + 40) / max(n, 1)
    if share >= 1:
        r = drawn(asked)
    else:
        r = cut(drawn(asked).where(F.col("draw") < format(int(share * 16**8), "08x")))
        enough = r.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k).select(F.col("query_id").alias("done"))
        short = cut(asked.join(small(enough), F.col("query_id").eqNullSafe(F.col("done")), "left_anti"))
        if not short.isEmpty():
            r = r.join(small(enough), F.col("query_id").eqNullSafe(F.col("done")), "left_semi").unionByName(drawn(short))
    return r.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("draw", "id"))).where(F.col("rank") <= k).select("query_id", "id", "rank")


def grep_baseline(symbols: DataFrame, names: DataFrame, mark: str = "(") -> DataFrame:
    """(query_id, id, rank) of symbols(id, file, lineno, code) whose code holds name and mark, for names(query_id, name), by file and line.

    Names are few: each text is searched for all of them.
    """
    hit = symbols.join(small(names.select("query_id", "name")), F.col("code").contains(F.concat("name", F.lit(mark))) & ~F.col("id").eqNullSafe(F.col("query_id")))
    return hit.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("file", "lineno", "id"))).select("query_id", "id", "rank")


def id_tokens(id):
    """The lower-case words of an id, split at punctuation and where a capital follows a small letter."""
    spaced = F.regexp_replace(F.col(id), r"([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(spaced), r"[^a-z0-9]+"), lambda t: F.length(t) > 0)


def service_search(symbols: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank): BM25 over the words of ids; for a query that finds nothing so, ids that hold its text."""
    words = lambda c: F.concat_ws(" ", id_tokens(c))
    found = bm25(symbols.select("id", words("id").alias("code")), queries.select("query_id", words("text").alias("text")))
    rest = small(queries.join(found.select("query_id").distinct(), "query_id", "left_anti").where("length(trim(text)) > 0"))
    plain = symbols.select("id").join(rest, F.lower("id").contains(F.lower(F.trim("text")))).select("query_id", "id", F.lit(0.0).alias("score"))
    return top_k(found.withColumn("score", F.round("score", 6)).unionByName(plain), k)


def unknown_symbols(asked: DataFrame, *known: DataFrame) -> DataFrame:
    """The ids asked for that are in none of the known tables."""
    for k in known:
        asked = asked.join(k.select("id"), "id", "left_anti")
    return asked


def likeness(a, b):
    """The share of characters of two strings in matching blocks, from 0 to 1."""

    def ratio(a, b):
        return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")

    ratio.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(ratio, T.DoubleType())(a, b)


def suggest_similar(unknown: DataFrame, known: DataFrame, k: int = 1) -> DataFrame:
    """(id, suggestion, likeness, rank): known ids for the unknown ones.

    Ids of the same bare name come first, nearest by id; without any, ids of the bare names
    that are most alike, LIKENESS at least. Distinct names are compared once each, with those of
    a length that allows it.
    """
    ship(unknown.sparkSession)
    last = lambda df: df.select("id", bare_name(F.element_at(F.split("id", ":"), -1)).alias("name")).distinct()
    u, ids = last(unknown).withColumnRenamed("id", "asked"), last(known)
    same = u.join(ids, "name").select("asked", F.col("id").alias("suggestion"), F.lit(1).alias("tier"))
    rest = u.join(same.select("asked").distinct(), "asked", "left_anti")
    most = (2.0 - LIKENESS) / LIKENESS  # 2 * shorter / (shorter + longer) is the greatest share that two lengths allow
    lengths = F.sequence(F.ceil(F.length("name") / most).cast("int"), F.floor(F.length("name") * most).cast("int"))
    a = rest.select("name").distinct().select("name", F.explode(lengths).alias("size"))
    b = ids.select(F.col("name").alias("other")).distinct().withColumn("size", F.length("other"))
    near = b.join(small(a), "size").select("name", "other").withColumn("like", likeness("name", "other")).where(F.col("like") >= LIKENESS)
    other = rest.join(near, "name").join(ids.withColumnRenamed("name", "other"), "other").select("asked", F.col("id").alias("suggestion"), F.lit(2).alias("tier"), "like")
    every = same.withColumn("like", F.lit(1.0)).unionByName(other).withColumn("whole", likeness("asked", "suggestion"))
    w = Window.partitionBy("asked").orderBy("tier", F.desc("like"), F.desc("whole"), "suggestion")
    return every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("asked").alias("id"), "suggestion", F.col("whole").alias("likeness"), "rank")


def resolve_names(asked: DataFrame, known: DataFrame, k: int = 5) -> DataFrame:
    """(name, id, exact, rank) for asked(name): ids of that name or bare name, else the k most alike."""
    ids = known.select("id", F.element_at(F.split("id", ":"), -1).alias("full")).withColumn("bare", bare_name("full"))
    exact = asked.join(ids, (F.col("name") == F.col("bare"))).select("name", "id").unionByName(asked.join(ids, F.col("name") == F.col("full")).select("name", "id")).unionByName(asked.join(ids, F.col("name") == F.col("id")).select("name", "id")).distinct()
    exact = exact.withColumn("rank", F.row_number().over(Window.partitionBy("name").orderBy("id"))).select("name", "id", F.lit(True).alias("exact"), "rank")
    rest = asked.join(exact.select("name").distinct(), "name", "left_anti").select(F.col("name").alias("id"))
    near = suggest_similar(rest, known, k)
    return exact.unionByName(near.select(F.col("id").alias("name"), F.col("suggestion").alias("id"), F.lit(False).alias("exact"), "rank"))
