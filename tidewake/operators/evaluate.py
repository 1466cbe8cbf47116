"""Retrieval metrics over retrieved(query_id, id, rank) and truth(query_id, id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewake.runtime import spread

KS = (10, 20, 30, 50, 70)


def judged(retrieved: DataFrame, truth: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query_id, size) of truth, and retrieved with good, 1 or 0.

    truth(query_id, id), or truth(id, label): what has a query's label is relevant to it, itself
    left out. Labels are counted and looked up, their pairs aren't made.
    """
    if "label" in truth.columns:
        t = truth.select("id", "label").where("id is not null and label is not null").distinct()
        own = t.select(F.col("id").alias("query_id"), F.col("label").alias("of"))
        if t.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            sizes = own.join(t.groupBy("label").agg((F.count("*") - 1).alias("size")), F.col("of") == F.col("label")).where("size > 0").select("query_id", "size")
            good = F.when((F.col("of") == F.col("label")) & (F.col("id") != F.col("query_id")), 1).otherwise(0)
            return sizes, retrieved.join(own, "query_id", "left").join(t, "id", "left").withColumn("good", good).drop("of", "label")
        truth = own.join(t, F.col("of") == F.col("label")).where("id <> query_id")  # ids of several labels
    t = truth.select("query_id", "id").distinct()
    sizes = t.groupBy("query_id").agg(F.count("*").alias("size"))
    return sizes, retrieved.join(t.withColumn("good", F.lit(1)), ["query_id", "id"], "left").withColumn("good", F.coalesce("good", F.lit(0)))


def case_metrics(retrieved: DataFrame, truth: DataFrame, ks=KS) -> DataFrame:
    """(query_id, hit, precision, recall, f1, p_at_k, r_at_k) against truth as in ``judged``: p_at_k divides by k."""
    sizes, marked = judged(retrieved, truth)
    m = marked.groupBy("query_id").agg(F.count("*").alias("n"), F.sum("good").alias("tp"), *[F.sum(F.when(F.col("rank") <= k, F.col("good")).otherwise(0)).alias(f"tp{k}") for k in ks])
    r = sizes.join(m, "query_id", "left").na.fill(0)
    p = F.when(F.col("n") > 0, F.col("tp") / F.nullif("n", F.lit(0))).otherwise(0.0)
    rec = F.col("tp") / F.col("size")
    out = r.select("query_id", (F.col("tp") > 0).cast("int").alias("hit"), p.alias("precision"), rec.alias("recall"), *[(F.col(f"tp{k}") / F.lit(float(k))).alias(f"p_at_{k}") for k in ks], *[(F.col(f"tp{k}") / F.col("size")).alias(f"r_at_{k}") for k in ks])
    return out.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0))).otherwise(0.0))


def rank_metrics(retrieved: DataFrame, truth: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, mrr, ap, ndcg) against truth as in ``judged``: ap divides by the number of relevant ids."""
    sizes, marked = judged(retrieved, truth)
    good = marked.where("good = 1").withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    g = good.groupBy("query_id").agg(F.max(1.0 / F.col("rank")).alias("mrr"), F.sum(F.col("nth") / F.col("rank")).alias("s"), F.sum(F.when(F.col("rank") <= k, 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("size", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    return sizes.join(g, "query_id", "left").select("query_id", F.coalesce("mrr", F.lit(0.0)).alias("mrr"), (F.coalesce("s", F.lit(0.0)) / F.col("size")).alias("ap"), (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"))


def two_level_mean(rows: DataFrame, group: str, value: str) -> DataFrame:
    """The mean of group means."""
    return rows.groupBy(group).agg(F.avg(value).alias("m")).agg(F.avg("m").alias("mean"), F.count("*").alias("groups"))


def stratum(size):
    return F.when(size <= 2, "1-2").when(size <= 5, "3-5").otherwise("6+")


def contribution_patterns(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(pattern, n): the exact set of signals(query_id, id, signal) that found each relevant id."""
    f = found.select("query_id", "id", "signal").distinct()
    sets = truth.select("query_id", "id").distinct().join(f, ["query_id", "id"], "left").groupBy("query_id", "id").agg(F.array_join(F.array_sort(F.collect_set("signal")), "+").alias("pattern"))
    return sets.groupBy("pattern").agg(F.count("*").alias("n"))


def disclosure(truth: DataFrame, included: DataFrame, dropped: DataFrame) -> DataFrame:
    """(state, n): relevant ids in the context, named as dropped, or invisible."""
    keys = ["query_id", "id"]
    side = lambda df, t, a, b: df.select(*keys, F.lit(t).alias("t"), F.lit(a).alias("a"), F.lit(b).alias("b"))
    every = side(truth, 1, 0, 0).unionByName(side(included, 0, 1, 0)).unionByName(side(dropped, 0, 0, 1))
    every = spread(every, truth.count() + included.count() + dropped.count(), *keys).groupBy(*keys).agg(*[F.max(c).alias(c) for c in "tab"]).where("t = 1")
    whole = F.col("query_id").isNotNull() & F.col("id").isNotNull()  # a null is equal to none
    return every.groupBy(F.when(whole & (F.col("a") == 1), "in_context").when(whole & (F.col("b") == 1), "disclosed").otherwise("invisible").alias("state")).agg(F.count("*").alias("n"))


def common_tasks(results: DataFrame) -> DataFrame:
    """results(provider, task, ..) of tasks that every provider has."""
    n = results.select("provider").distinct().agg(F.count("*").alias("n"))
    full = results.groupBy("task").agg(F.countDistinct("provider").alias("k")).crossJoin(F.broadcast(n)).where("k = n").select("task")
    return results.join(full, "task", "left_semi")


def by_file(affected: DataFrame) -> DataFrame:
    """(file, n, first) of affected(file, id)."""
    return affected.groupBy("file").agg(F.count("*").alias("n"), F.min("id").alias("first"))


def module_snapshot(symbols: DataFrame, selected: DataFrame) -> DataFrame:
    """(file, total, selected) of symbols(file, id) and the ids selected."""
    s = symbols.join(selected.select("id").distinct().withColumn("tw_in", F.lit(1)), "id", "left")
    return s.groupBy("file").agg(F.count("*").alias("total"), F.count("tw_in").alias("selected"))
