"""Closures and components of directed graphs given as edges(src, dst).

Loops run over DataFrames: each round is a join of the frontier with the edges and an
anti-join with what was reached, and its result is written to the checkpoint folder, so
that plans stay short and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.runtime import cut, range_sorted, small, spread


def reverse_graph(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of each edge, once, without loops."""
    pairs = edges.select("src", "dst")
    return pairs.union(edges.select("dst", "src")).where("src <> dst").distinct()


def min_hops(edges: DataFrame, seeds: DataFrame, max_hops: int | None = None, ready: bool = False) -> DataFrame:
    """(query_id, id, hops): least hops from the seeds(query_id, id) of each query along edges, seeds at 0.

    All queries advance together; a node is expanded once a query. ready: edges are distinct and written already.
    """
    steps = edges.select("src", "dst") if ready else cut(edges.select("src", "dst").distinct())
    frontier = cut(seeds.select("query_id", "id").distinct())
    reached = frontier.withColumn("hops", F.lit(0))
    hop = 0
    while max_hops is None or hop < max_hops:
        hop += 1
        new = small(frontier).join(steps, frontier["id"] == steps["src"]).select("query_id", F.col("dst").alias("id")).distinct()
        frontier = cut(new.join(reached, ["query_id", "id"], "left_anti"))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier.withColumn("hops", F.lit(hop)))
        if hop % 8 == 0:
            reached = cut(reached)
    return reached


def blast_radius(edges: DataFrame, seeds: DataFrame, max_hops: int | None = None) -> DataFrame:
    """Transitive callers of the seeds, which are left out themselves."""
    return min_hops(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), seeds, max_hops).where("hops > 0")


def expand_dependencies(edges: DataFrame, seeds: DataFrame, max_hops: int | None = None) -> DataFrame:
    """What the seeds depend on, the seeds included."""
    return min_hops(edges, seeds, max_hops)


def within_undirected(edges: DataFrame, seeds: DataFrame, max_hops: int) -> DataFrame:
    return min_hops(undirected(edges), seeds, max_hops)


def min_label_components(edges: DataFrame) -> DataFrame:
    """(id, label): the least id of the component of each id that has an edge.

    Each id points to the least of itself and its neighbours, pointers jump to their ends,
    and the edges are drawn between these: loops and repeated edges fall away, so later rounds
    run over few. A component's least id keeps its name to the end.
    """
    def drawn(pairs, n):
        once = pairs.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        return cut(spread(once, n, "src", "dst").distinct())

    live, maps = drawn(edges.select("src", "dst"), edges.count()), []
    while n := live.count():
        low = live.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("m")).unionByName(live.groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("m")))
        to = cut(low.groupBy("id").agg(F.min("m").alias("m")).select("id", F.least("id", "m").alias("label"), F.lit(True).alias("moved")))
        while not to.where("moved").isEmpty():
            further = to.select(F.col("id").alias("label"), F.col("label").alias("next"))
            to = cut(to.select("id", "label").join(small(further), "label").select("id", F.col("next").alias("label"), (F.col("label") != F.col("next")).alias("moved")))
        to = to.select("id", "label")
        maps.append(to)
        at = lambda c: small(to.select(F.col("id").alias(c), F.col("label").alias(f"to_{c}")))  # noqa: B023, E731
        live = drawn(live.join(at("src"), "src").join(at("dst"), "dst").select(F.col("to_src").alias("src"), F.col("to_dst").alias("dst")), n)
    if not maps:
        return live.select(F.col("src").alias("id"), F.col("dst").alias("label"))
    labels = maps.pop()
    while maps:
        later = labels.select(F.col("id").alias("label"), F.col("label").alias("last"))
        labels = maps.pop().join(small(later), "label", "left").select("id", F.coalesce("last", "label").alias("label"))
    return cut(labels)


def reach(edges: DataFrame, starts: DataFrame, max_hops: int) -> DataFrame:
    """(query_id, id) within max_hops of the starts(query_id, id) along distinct edges, the starts included.

    Queries are the bits of numbers, 60 in each, so an edge is followed once for all queries of a number.
    """
    q = range_sorted(starts.select("query_id").distinct(), "query_id", names=("tw_part", "tw_no")).select(F.col("query_id").alias("of"), F.floor((F.col("tw_no") - 1) / 60).alias("block"), F.expr("shiftleft(1L, cast((tw_no - 1) % 60 as int))").alias("bit"))
    q = cut(q)
    state = starts.join(small(q), F.col("query_id").eqNullSafe(F.col("of"))).groupBy("id", "block").agg(F.bit_or("bit").alias("bits"))
    state = cut(state.withColumn("new", F.col("bits")))
    for _ in range(max_hops):
        front = state.where("new <> 0")
        step = front.join(edges, front["id"] == edges["src"]).select(F.col("dst").alias("id"), "block", "new").groupBy("id", "block").agg(F.bit_or("new").alias("got"))
        both = state.select("id", "block", "bits", F.lit(0).cast("long").alias("got")).unionByName(step.select("id", "block", F.lit(0).cast("long").alias("bits"), "got"))
        both = both.groupBy("id", "block").agg(F.bit_or("bits").alias("bits"), F.bit_or("got").alias("got"))
        state = cut(both.select("id", "block", F.col("bits").bitwiseOR(F.col("got")).alias("bits"), F.expr("got & ~bits").alias("new")))
    return state.join(small(q), "block").where("bits & bit <> 0").select(F.col("of").alias("query_id"), "id")
