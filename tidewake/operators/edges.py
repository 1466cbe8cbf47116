"""Edge producers over symbols(id, file, lineno): edges(src, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewake.runtime import TASK_PAIRS, cut, small, spread

WINDOW_FILE_CAP, IMPORT_CAP, DIRECTORY_CAP, DISPATCH_CAP, CHILD_CAP, DECORATOR_CAP = 60, 10, 20, 6, 8, 6


def connect_pairs(pairs: DataFrame) -> DataFrame:
    """Both directions, once, without loops."""
    return pairs.select("src", "dst").union(pairs.select("dst", "src")).where("src <> dst").distinct()


def window_edges(symbols: DataFrame, reach: int = 3, cap: int = WINDOW_FILE_CAP) -> DataFrame:
    """Neighbours within reach in definition order, in files of 2 to cap symbols."""
    order = Window.partitionBy("file").orderBy("lineno", "id")
    s = symbols.select("id", *[F.lead("id", i).over(order).alias(f"n{i}") for i in range(1, reach + 1)], F.count("*").over(Window.partitionBy("file")).alias("n"))
    s = s.where((F.col("n") >= 2) & (F.col("n") <= cap))
    near = s.select(F.col("id").alias("src"), F.explode(F.array(*[f"n{i}" for i in range(1, reach + 1)])).alias("dst")).where("dst is not null")
    return connect_pairs(near)


def representatives(symbols: DataFrame) -> DataFrame:
    """(file, rep): the first symbol of each file."""
    return symbols.groupBy("file").agg(F.min_by("id", F.struct("lineno", "id")).alias("rep"))


def _group_pairs(members: DataFrame, key: str, least: int, most: int) -> DataFrame:
    sized = members.join(members.groupBy(key).agg(F.count("*").alias("n")).where((F.col("n") >= least) & (F.col("n") <= most)).select(key), key)
    a, b = sized.select(key, F.col("rep").alias("src")), sized.select(key, F.col("rep").alias("dst"))
    return connect_pairs(a.join(b, key).where("src < dst"))


def shared_import_edges(symbols: DataFrame, imports: DataFrame, cap: int = IMPORT_CAP) -> DataFrame:
    """First symbols of files that import(file, target) the same target, of 2 to cap files; files without symbols count."""
    i = imports.select("file", "target").distinct()
    few = i.groupBy("target").agg(F.count("*").alias("n")).where((F.col("n") >= 2) & (F.col("n") <= cap)).select("target")
    return _group_pairs(i.join(few, "target").join(representatives(symbols), "file"), "target", 2, cap)


def same_directory_edges(symbols: DataFrame, cap: int = DIRECTORY_CAP) -> DataFrame:
    """First symbols of files in the same directory(file, directory), of 2 to cap files."""
    reps = representatives(symbols).join(symbols.select("file", "directory").distinct(), "file")
    return _group_pairs(reps, "directory", 2, cap)


def sibling_override_edges(methods: DataFrame, cap: int = DISPATCH_CAP) -> DataFrame:
    """Overriders of one method(base, method, id), families of 2 to cap; dunder methods aren't dispatch."""
    m = methods.where(~F.col("method").startswith("__")).select(F.struct("base", "method").alias("family"), F.col("id").alias("rep")).distinct()
    return _group_pairs(m, "family", 2, cap)


def keyed_pairs(own: DataFrame, other: DataFrame) -> DataFrame:
    """(src, dst) of own(src, key) and other(dst, key) of one key, each pair once, without loops.

    A pair can come twice only from a src and a dst that both have several keys: these pairs
    alone are made distinct, all others go out as they are joined.
    """
    whole = lambda df, c: cut(df.select(c, "key").where("key is not null").distinct().withColumn("many", F.count("*").over(Window.partitionBy(c)) > 1))
    a, b = whole(own, "src"), whole(other, "dst")
    size = lambda df, n: df.groupBy("key").agg(F.count("*").alias(n))
    pairs = size(a, "na").join(size(b, "nb"), "key").agg(F.sum(F.col("na") * F.col("nb")).alias("n")).first().n or 0

    def joined(a, b):
        b = b.select("dst", "key")
        thin = small(b)
        if thin is not b:
            return spread(a.select("src", "key"), pairs, each=TASK_PAIRS).join(thin, "key").where("src <> dst").select("src", "dst")
        each = TASK_PAIRS
        return spread(a.select("src", "key"), pairs, "key", each=each).join(spread(b, pairs, "key", each=each), "key").where("src <> dst").select("src", "dst")

    twice = a.where("many")
    if twice.isEmpty() or b.where("many").isEmpty():
        return joined(a, b)
    again = joined(twice, b.where("many")).distinct()
    return joined(a.where("not many"), b).unionByName(joined(twice, b.where("not many"))).unionByName(again)


def override_edges(methods: DataFrame, parents: DataFrame) -> DataFrame:
    """Child method to the parent's of the same name, where the parent(child, parent) has it."""
    key = lambda c: F.when(F.col(c).isNotNull() & F.col("method").isNotNull(), F.struct(F.col(c).alias("cls"), "method")).alias("key")
    own = methods.select(F.col("cls").alias("child"), "method", F.col("id").alias("src")).join(parents, "child").select("src", key("parent"))
    return keyed_pairs(own, methods.select(F.col("id").alias("dst"), key("cls")))


def parent_child_edges(overrides: DataFrame, cap: int = CHILD_CAP) -> DataFrame:
    """Overrides reversed, for parents with at most cap overriders."""
    n = F.count("*").over(Window.partitionBy("dst"))
    return overrides.withColumn("n", n).where(F.col("n") <= cap).select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()


def decorator_edges(decorated: DataFrame, cap: int = DECORATOR_CAP) -> DataFrame:
    """decorated(src, dst, ord): the first cap decorators of each function."""
    w = Window.partitionBy("src").orderBy("ord")
    return decorated.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= cap).select("src", "dst").where("src <> dst").distinct()


def call_edges(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """calls(src, name) joined with symbols of that bare name."""
    return keyed_pairs(calls.select("src", F.col("name").alias("key")), symbols.select(F.col("id").alias("dst"), F.col("name").alias("key")))


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, indeg, outdeg) of every node, isolated ones included."""
    ends = edges.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(edges.select("dst", F.lit(1), F.lit(0)))
    d = ends.groupBy("id").agg(F.sum("i").alias("indeg"), F.sum("o").alias("outdeg"))
    return nodes.select("id").distinct().join(d, "id", "left").select("id", F.coalesce("indeg", F.lit(0)).alias("indeg"), F.coalesce("outdeg", F.lit(0)).alias("outdeg"))


def graph_confidence(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Share of edges whose target is a known symbol; 1 without edges."""
    known = symbols.select(F.col("id").alias("known")).distinct()
    return edges.join(known, edges["dst"] == known["known"], "left").agg(F.coalesce(F.avg(F.when(F.col("known").isNotNull(), 1.0).otherwise(0.0)), F.lit(1.0)).alias("confidence"))
