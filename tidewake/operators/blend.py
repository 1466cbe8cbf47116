"""Blending and fusing ranked signals(query_id, id, score)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewake.runtime import BROADCAST_ROWS, TASK_PAIRS, cut, small, spread

WEIGHTS, HISTORY_WEIGHT, FULL_CONFIDENCE, RRF_K = (0.3, 0.5, 0.2), 0.15, 8, 60
#: About the ids of a file that one array holds.
BLOCK = 1024


def normalise(scores: DataFrame) -> DataFrame:
    """Min-max by query; a constant signal is 0.5."""
    w = Window.partitionBy("query_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return scores.select("query_id", "id", F.when(high == low, 0.5).otherwise((F.col("score") - low) / F.nullif(high - low, F.lit(0.0))).alias("score"))


def adaptive_weights(graph: DataFrame, weights=WEIGHTS, queries: DataFrame | None = None) -> DataFrame:
    """(query_id, wg, wb, wf): few graph candidates move graph weight to the lexical one.

    queries(query_id), if given, have a row each, also where the graph has no candidate.
    """
    g, b, f = weights
    n = graph.groupBy("query_id").agg(F.count("*").alias("n"))
    if queries is not None:
        n = queries.select("query_id").distinct().join(n, "query_id", "left")
    c = F.least(F.lit(1.0), F.coalesce("n", F.lit(0)) / F.lit(float(FULL_CONFIDENCE)))
    return n.withColumn("c", c).select("query_id", (g * F.col("c")).alias("wg"), (F.lit(b) + g * (1 - F.col("c"))).alias("wb"), F.lit(f).alias("wf"))


def _in_files(q: DataFrame, members: DataFrame, inside: DataFrame, gone: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """inside(query_id, id, ..) with shared (1 where both are in one file), the pairs of one file that neither inside nor gone has, and other pairs.

    q(query_id, file) and members(id, file). A file's ids are kept in blocks of BLOCK; a query has a
    row a block, less what inside has of it, and its other ids come out of the block's array, so that
    pairs are never shuffled. Queries and ids of several rows are left to the other pairs, made one by one.
    """
    single = lambda df, c: cut(df.where("file is not null").groupBy(c).agg(F.min("file").alias("file"), F.count("*").alias("n")).where((F.col("n") == 1) & F.col(c).isNotNull()).select(c, "file"))
    q1, m1 = single(q, "query_id"), single(members, "id")
    odd_q, odd_m = cut(q.where("file is not null").join(q1.select("query_id"), "query_id", "left_anti")), cut(members.where("file is not null").join(m1.select("id"), "id", "left_anti"))
    other = None
    if not (odd_q.isEmpty() and odd_m.isEmpty()):
        other = odd_q.join(members, "file").select("query_id", "id").unionByName(q1.join(odd_m, "file").select("query_id", "id"))
    sizes = cut(m1.groupBy("file").agg(F.count("*").alias("size")))
    blocks = F.ceil(F.col("size") / BLOCK)
    placed = m1.join(small(sizes), "file").select("id", "file", F.pmod(F.xxhash64("id"), blocks).alias("block"))
    placed = cut(placed)
    inside = inside.join(small(q1.withColumnRenamed("file", "tw_of")), "query_id", "left").join(small(placed, 4 * BROADCAST_ROWS), "id", "left").withColumn("shared", F.when(F.col("tw_of") == F.col("file"), 1).otherwise(0))
    inside = cut(inside.drop("tw_of"))
    seen = inside.where("shared = 1").select("query_id", "id", "block")
    if gone is not None:
        seen = seen.unionByName(gone.join(placed, "id").select("query_id", "id", "block"))
    seen = seen.groupBy("query_id", "block").agg(F.collect_list("id").alias("seen"))
    asked = q1.join(sizes, "file").select("query_id", "file", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"))
    n = q1.join(sizes, "file").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first().n
    arrays = placed.groupBy("file", "block").agg(F.collect_list("id").alias("ids"))
    left = F.when(F.col("seen").isNull(), F.col("ids")).otherwise(F.array_except("ids", "seen"))
    asked = asked.join(seen, ["query_id", "block"], "left")
    outside = spread(asked, n, "file", "block", each=TASK_PAIRS).join(arrays, ["file", "block"]).select("query_id", F.explode(left).alias("id"))
    return inside.drop("file", "block"), outside, other


def hybrid(graph: DataFrame, lexical: DataFrame, same_file: DataFrame | tuple, weights: DataFrame | None = None, history: DataFrame | None = None, changed: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score), 100 times the weighted sum; history is added without renormalising.

    Without weights they are adaptive, over every query of a signal; a query that weights
    don't name has no graph candidate. changed(query_id, id) take no part and keep their
    graph score; a query without any keeps its graph scores as they are. same_file is
    (query_id, id), or (queries(query_id, file), ids(id, file)) where these pairs are many.
    """
    files = same_file if isinstance(same_file, tuple) else None
    keys = None
    untouched = None
    if changed is not None:
        keys, known = changed.select("query_id", "id").distinct(), changed.select("query_id").distinct()
        rest = graph.select("query_id", "id", "score").join(known, "query_id", "left_anti")
        untouched = graph.select("query_id", "id", "score").join(keys, ["query_id", "id"], "left_semi").unionByName(rest)
        apart = lambda s: s if s is None else s.join(known, "query_id", "left_semi").join(keys, ["query_id", "id"], "left_anti")
        graph, lexical, history = apart(graph), apart(lexical), apart(history)
        if files is None:
            same_file = apart(same_file)
        else:
            files = (files[0].join(known, "query_id", "left_semi"), files[1])
    if weights is None:
        weights = adaptive_weights(graph)
    signals = [(normalise(graph), "wg"), (normalise(lexical), "wb")]
    if files is None:
        signals.append((same_file.select("query_id", "id", F.lit(1.0).alias("score")), "wf"))
    alone = {"wg": 0.0, "wb": WEIGHTS[0] + WEIGHTS[1], "wf": WEIGHTS[2]}
    rows = None
    for s, name in signals:
        part = s.join(weights, "query_id", "left").select("query_id", "id", (F.coalesce(name, F.lit(alone[name])) * F.col("score")).alias("part"))
        rows = part if rows is None else rows.unionByName(part)
    if history is not None:
        rows = rows.unionByName(history.select("query_id", "id", (HISTORY_WEIGHT * F.col("score")).alias("part")))
    if files is None:
        out = rows.groupBy("query_id", "id").agg((100 * F.sum("part")).alias("score"))
    else:
        inside, outside, other = _in_files(*files, rows.groupBy("query_id", "id").agg(F.sum("part").alias("part")), keys)
        wf = F.coalesce("wf", F.lit(alone["wf"]))
        own = small(cut(weights.select("query_id", "wf")))
        out = inside.join(own, "query_id", "left").select("query_id", "id", (F.col("part") + wf * F.col("shared")).alias("part"))
        if other is not None:
            other = other if changed is None else apart(other)
            out = out.unionByName(other.join(own, "query_id", "left").select("query_id", "id", wf.alias("part"))).groupBy("query_id", "id").agg(F.sum("part").alias("part"))
        rest = outside.join(own, "query_id", "left").select("query_id", "id", wf.alias("part"))
        out = out.unionByName(rest).select("query_id", "id", (100 * F.col("part")).alias("score"))
    return out if untouched is None else out.unionByName(untouched)


def ranked(scores: DataFrame) -> DataFrame:
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))


def reciprocal_rank_fusion(ranks: DataFrame, k: int = RRF_K) -> DataFrame:
    """ranks(query_id, signal, id, rank) to (query_id, id, score, best), ordered by score, best rank, id."""
    return ranks.groupBy("query_id", "id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.min("rank").alias("best"))


def best_of(ranks: DataFrame) -> DataFrame:
    """(query_id, id, rank): the best rank over signals."""
    return ranks.groupBy("query_id", "id").agg(F.min("rank").alias("rank"))


def peak_cut(scores: DataFrame, share: float = 0.05, least: int = 10, most: int = 100) -> DataFrame:
    """What reaches a share of the query's peak, least rows at least and most at most."""
    r = ranked(scores).withColumn("peak", F.max("score").over(Window.partitionBy("query_id")))
    return r.where((F.col("rank") <= most) & ((F.col("score") >= share * F.col("peak")) | (F.col("rank") <= least))).drop("peak")


def merge_seeds(ranks: DataFrame) -> DataFrame:
    """(query_id, id, score): the best reciprocal rank over the seeds of ranks(query_id, seed, id, rank)."""
    return ranks.groupBy("query_id", "id").agg(F.max(1.0 / F.col("rank")).alias("score"))


def variants(signals: dict[str, DataFrame], weights: dict[str, dict[str, float]]) -> DataFrame:
    """(variant, query_id, id, score): weighted sums of signals in [0, 1] for each named set of weights; signals are read once."""
    rows = None
    for name, s in signals.items():
        of = F.array(*[F.struct(F.lit(v).alias("variant"), F.lit(float(w[name])).alias("w")) for v, w in weights.items() if name in w])
        part = s.select("query_id", "id", F.explode(of).alias("x"), F.lit(name).alias("signal"), "score").select("x.variant", "query_id", "id", "signal", (F.col("x.w") * F.col("score")).alias("part"))
        rows = part if rows is None else rows.unionByName(part)
    # signal by signal, so that a sum's last bits don't follow from the order of rows
    own = [F.sum(F.when(F.col("signal") == n, F.col("part")).otherwise(0.0)) for n in signals]
    return rows.groupBy("variant", "query_id", "id").agg(sum(own[1:], own[0]).alias("score"))


def simplex_grid(spark: SparkSession, names: list[str], ticks: int) -> DataFrame:
    """All weights of the names on steps of 1 / ticks that add to 1."""
    g = spark.range(1).select(F.lit(ticks).alias("tw_rest"))
    for n in names[:-1]:
        g = g.withColumn(n, F.explode(F.sequence(F.lit(0), F.col("tw_rest")))).withColumn("tw_rest", F.col("tw_rest") - F.col(n))
    return g.select(*[(F.col(n) / ticks).alias(n) for n in names[:-1]], (F.col("tw_rest") / ticks).alias(names[-1]))


def grid_scores(candidates: DataFrame, grid: DataFrame, names: list[str]) -> DataFrame:
    """(choice, query_id, id, score) of candidates(query_id, id, a column a signal) under each row of a grid(choice, ..); grids are small."""
    g = grid.select("choice", *[F.col(n).alias(f"tw_{n}") for n in names])
    score = sum((F.col(n) * F.col(f"tw_{n}") for n in names), F.lit(0.0))
    return candidates.crossJoin(F.broadcast(g.limit(100_000))).select("choice", "query_id", "id", score.alias("score"))


def redistribute(counts: DataFrame, weights: dict[str, float], enough: float) -> DataFrame:
    """A row a query of counts(query_id, n): the first weight times min(1, n / enough), what it lacks spread over the others in proportion."""
    (first, w0), *rest = weights.items()
    r = F.least(F.lit(1.0), F.col("n") / F.lit(float(enough)))
    total = sum(w for _, w in rest)
    scale = (total + w0 * (1 - r)) / total if total > 1e-9 else F.lit(1.0)
    return counts.select("query_id", (w0 * r).alias(first), *[(w * scale).alias(n) for n, w in rest])
