"""Co-change association over commit_files(commit, file)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewake.runtime import cut, small, spread

MAX_FILES, MIN_COCHANGES = 25, 2


def file_counts(commit_files: DataFrame, rows: int | None = None) -> DataFrame:
    """(file, n): commits of each file, sweeping and single ones included; rows, if known, split the work."""
    c = commit_files.select("commit", "file")
    if rows is not None:
        c = spread(c, rows, "file")
    return c.distinct().groupBy("file").agg(F.count("*").alias("n"))


def pair_counts(commit_files: DataFrame, max_files: int = MAX_FILES, least: int = 1, only: DataFrame | None = None, rows: int | None = None) -> DataFrame:
    """(a, b, n), both ways, over commits of 2 to max_files files, n at least least; with only(file), of these a.

    A commit's files become one array, of max_files at most, once their number is known. Pairs are
    counted one way and then turned, unless they are of certain files. Tasks are split by rows.
    """
    rows = commit_files.count() if rows is None else rows
    c = spread(commit_files.select("commit", "file"), rows, "commit").distinct().withColumn("size", F.count("*").over(Window.partitionBy("commit"))).where((F.col("size") >= 2) & (F.col("size") <= max_files))
    if only is not None:
        c = c.join(small(only.select("file").distinct().withColumn("tw_in", F.lit(True))), "file", "left")
    mine = F.coalesce("tw_in", F.lit(False)) if only is not None else F.lit(True)
    sets = c.groupBy("commit").agg(F.collect_list(F.when(F.col("file").isNotNull(), F.struct(F.col("file").alias("f"), mine.alias("mine")))).alias("fs"))
    if only is not None:
        sets = sets.where(F.exists("fs", lambda x: x["mine"]))
    one = sets.select("fs", F.explode("fs").alias("x")).where("x.mine").select(F.col("x.f").alias("a"), F.explode("fs").alias("y")).select("a", F.col("y.f").alias("b"))
    one = one.where("a < b" if only is None else "a <> b")
    n = spread(one, rows * (3 if only is None else 1), "a", "b").groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    if only is not None:
        return n
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return n.select("n", F.explode(ways).alias("w")).select("w.a", "w.b", "n")


def association(commit_files: DataFrame, max_files: int = MAX_FILES, least: int = MIN_COCHANGES, only: DataFrame | None = None) -> DataFrame:
    """(a, b, assoc): how often b changed when a did; with only(file), of these a.

    Both sides are written first, so that no task counts, sorts and joins in one.
    """
    rows = commit_files.count()
    pairs = cut(pair_counts(commit_files, max_files, least, only, rows))
    files = cut(file_counts(commit_files, rows).select(F.col("file").alias("a"), F.col("n").alias("total")))
    n = pairs.count() + files.count()
    return spread(pairs, n, "a").join(spread(files, n, "a"), "a").select("a", "b", (F.col("n") / F.col("total")).alias("assoc"))


def scores_for_files(commit_files: DataFrame, changed: DataFrame, max_files: int = MAX_FILES, least: int = MIN_COCHANGES, some: bool = False) -> DataFrame:
    """(query_id, file, score): the strongest association with a changed(query_id, file).

    some says that few of all files are changed: only their pairs are counted then.
    """
    only = changed.select("file") if some else None
    ab, m = cut(association(commit_files, max_files, least, only)), changed.count()
    n = ab.count() + m
    hit = spread(changed.select("query_id", F.col("file").alias("a")), n, "a").join(spread(ab, n, "a"), "a").select("query_id", F.col("b").alias("file"), "assoc")
    n = hit.count() + m
    best = spread(hit, n, "query_id", "file").groupBy("query_id", "file").agg(F.max("assoc").alias("score"))
    return best.join(spread(changed.select("query_id", "file"), n, "query_id", "file"), ["query_id", "file"], "left_anti")


def excluding(commit_files: DataFrame, commits: DataFrame) -> DataFrame:
    return commit_files.join(commits.select("commit"), "commit", "left_anti")


def following(rows: DataFrame, window: int) -> DataFrame:
    """(src, dst): for each of rows(key, t, id) the next `window` of its key in time."""
    order = Window.partitionBy("key").orderBy("t", "id")
    after = F.array(*[F.lead("id", i).over(order) for i in range(1, window + 1)])
    return rows.select(F.col("id").alias("src"), after.alias("after")).select("src", F.explode("after").alias("dst")).where("dst is not null")
