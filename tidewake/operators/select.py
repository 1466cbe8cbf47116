"""Cutoffs and budgeted selection over ranked candidates."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewake.runtime import in_order

SCAN, EPSILON, ITEM_SHARE = 50, 1e-12, 0.25


def gap_cut(scores: DataFrame) -> DataFrame:
    """(query_id, keep): rows before the largest ratio of neighbours among the first SCAN; all if fewer than three."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    s = scores.select("query_id", "score", F.row_number().over(w).alias("rn"), F.lead("score").over(w).alias("next"))
    s = s.withColumn("ratio", F.when(F.col("next").isNotNull() & (F.col("rn") < SCAN), F.col("score") / F.greatest(F.col("next"), F.lit(EPSILON))))
    g = s.groupBy("query_id").agg(F.count("*").alias("n"), F.max(F.when(F.col("ratio").isNotNull(), F.struct(F.col("ratio"), (-F.col("rn")).alias("m")))).alias("top"))
    return g.select("query_id", F.when(F.col("n") < 3, F.col("n")).otherwise(-F.col("top.m")).cast("long").alias("keep"))


def mass_cut(scores: DataFrame, share: float) -> DataFrame:
    """The shortest prefix by score that holds the share of the query's total."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    before = F.coalesce(F.sum("score").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return scores.withColumn("before", before).withColumn("total", F.sum("score").over(Window.partitionBy("query_id"))).where(F.col("before") < share * F.col("total")).drop("before", "total")


def budget_prefix(ranked: DataFrame, budget: int) -> DataFrame:
    """ranked(query_id, rank, id, cost) up to the first that overflows."""
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranked.withColumn("spent", F.sum("cost").over(w)).where(F.col("spent") <= budget)


def budget_greedy(ranked: DataFrame, budget: int, item_cap: int | None = None, top_k: int | None = None) -> DataFrame:
    """(query_id, id, rank): in rank order, what still fits is taken and the rest skipped.

    Rows whose ``forced`` is true, if ranked has that column, come first, are charged and
    taken whatever they cost, and don't count for top_k.
    """
    return _packed(ranked, budget, item_cap, top_k).where("taken").select("query_id", "id", "rank")


def _packed(ranked: DataFrame, budget: int | None, item_cap: int | None, top_k: int | None) -> DataFrame:
    """ranked(query_id, rank, id, cost) with taken, by one ordered pass over each query's rows."""
    forced = F.coalesce("forced", F.lit(False)) if "forced" in ranked.columns else F.lit(False)
    rows = ranked.select("query_id", F.col("rank").cast("long").alias("rank"), "id", F.col("cost").cast("long").alias("cost"), forced.alias("forced"))
    limit, cap, most = budget if budget is not None else 1 << 62, item_cap if item_cap is not None else 1 << 62, top_k if top_k is not None else 1 << 62

    def fold(batches):
        query, spent, taken = object(), 0, 0
        for b in batches:
            out = []
            for q, cost, must in zip(b.column("query_id").to_pylist(), b.column("cost").to_pylist(), b.column("forced").to_pylist(), strict=True):
                if q != query:
                    query, spent, taken = q, 0, 0
                fits = must or taken < most and cost <= cap and spent + cost <= limit
                if fits:
                    spent, taken = spent + cost, taken + (not must)
                out.append(fits)
            yield pa.RecordBatch.from_arrays([b.column("query_id"), b.column("rank"), b.column("id"), b.column("forced"), pa.array(out, pa.bool_())], names=["query_id", "rank", "id", "forced", "taken"])

    kind = lambda c: rows.schema[c].dataType.simpleString()
    return in_order(rows, "query_id", [F.desc("forced"), "rank", "id"], fold, f"query_id {kind('query_id')}, rank long, id {kind('id')}, forced boolean, taken boolean")


def select_context(candidates: DataFrame, changed: DataFrame, budget: int | None, top_k: int | None = None, gap: bool = False) -> DataFrame:
    """(query_id, id, role) of candidates(query_id, id, score, cost): changed, related or dropped.

    Changed ids are taken and charged. The others come by score: under gap those before the
    largest gap, zero scores left out; then at most top_k, of at most ITEM_SHARE of the
    budget each, as far as the budget goes. What isn't taken is dropped, and told.
    A changed id without a candidate row is selected and costs nothing.
    """
    keys = changed.select("query_id", "id").distinct()
    mine = candidates.join(keys, ["query_id", "id"], "left_semi").select("query_id", "id", "cost", F.lit(0).cast("long").alias("rank"), F.lit(True).alias("forced"))
    others = candidates.join(keys, ["query_id", "id"], "left_anti")
    c, cut_off = others, None
    if gap:
        positive = others.where(F.col("score") > EPSILON)
        r = positive.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).join(gap_cut(positive), "query_id")
        c = r.where("rank <= keep")
        cut_off = others.join(c.select("query_id", "id"), ["query_id", "id"], "left_anti").select("query_id", "id", F.lit("dropped").alias("role"))
    c = c.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")).cast("long"))
    rows = mine.unionByName(c.select("query_id", "id", "cost", "rank", F.lit(False).alias("forced")))
    packed = _packed(rows, budget, None if budget is None else int(ITEM_SHARE * budget), top_k)
    out = packed.select("query_id", "id", F.when(F.col("forced"), "changed").when(F.col("taken"), "related").otherwise("dropped").alias("role"))
    out = out.unionByName(keys.join(mine.select("query_id", "id"), ["query_id", "id"], "left_anti").select("query_id", "id", F.lit("changed").alias("role")))
    return out if cut_off is None else out.unionByName(cut_off)


def cutoff_policies(scores: DataFrame) -> DataFrame:
    """(policy, query_id, id, rank): what each cutoff keeps of scores > 0: top k, a share of the peak, the gap, a share of the mass."""
    r = scores.where(F.col("score") > EPSILON)
    w = Window.partitionBy("query_id")
    order = w.orderBy(F.desc("score"), "id")
    upto = F.sum("score").over(order.rowsBetween(Window.unboundedPreceding, -1)) / F.sum("score").over(w)
    r = r.join(gap_cut(r), "query_id").select("query_id", "id", "score", "keep", F.row_number().over(order).alias("rank"), F.max("score").over(w).alias("peak"), F.coalesce(upto, F.lit(0.0)).alias("mass"))
    rules = {f"topk_{k}": F.col("rank") <= k for k in (10, 20, 30, 50)}
    rules |= {f"rel_{a}": F.col("score") >= a * F.col("peak") for a in (0.05, 0.1, 0.2, 0.3, 0.5)}
    rules |= {"gap50": F.col("rank") <= F.col("keep")} | {f"mass_{b}": F.col("mass") < b for b in (0.5, 0.7, 0.9)}
    kept = F.filter(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())
    return r.select(F.explode(kept).alias("policy"), "query_id", "id", "rank")


def all_relevant(scores: DataFrame, extra: DataFrame) -> DataFrame:
    """(query_id, id, pos): scored ids by score, then extra ids without one."""
    keys = ["query_id", "id"]
    s = scores.select(*keys, F.lit(0).alias("o"), F.col("score").cast("double").alias("score"))
    rest = extra.select(*keys).distinct().join(scores.select(*keys), keys, "left_anti").select(*keys, F.lit(1).alias("o"), F.lit(0.0).alias("score"))
    w = Window.partitionBy("query_id").orderBy("o", F.desc("score"), "id")
    return s.unionByName(rest).select(*keys, F.row_number().over(w).cast("long").alias("pos"))


def newest(entries: DataFrame, k: int = 5) -> DataFrame:
    """The k newest of entries(key, id, at) of each key: what a cache keeps."""
    w = Window.partitionBy("key").orderBy(F.desc("at"), F.desc("id"))
    return entries.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).select("key", "id")


def trim(candidates: DataFrame, changed: DataFrame, budget: int) -> DataFrame:
    """(query_id, id) of candidates(query_id, id, score, cost) that stay when the lowest scores go until the rest costs at most budget; changed ids stay."""
    mine = changed.select("query_id", "id", F.lit(True).alias("forced")).distinct()
    c = candidates.join(mine, ["query_id", "id"], "left").withColumn("forced", F.coalesce("forced", F.lit(False)))
    w = Window.partitionBy("query_id")
    before = F.coalesce(F.sum("cost").over(w.orderBy("forced", "score", F.desc("id")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    c = c.withColumn("before", before).withColumn("over", F.sum("cost").over(w) - budget)
    return c.where(F.col("forced") | (F.col("before") >= F.col("over"))).select("query_id", "id")
