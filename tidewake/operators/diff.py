"""Snapshots, intervals and co-change cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Lines of a bin of an interval join.
BIN_LINES = 256


def compare_states(old: DataFrame, new: DataFrame, broken: DataFrame | None = None) -> DataFrame:
    """(id, status) of symbols(id, code, file): added, modified, deleted; gone from a broken file is modified."""
    o, n = old.select("id", F.col("code").alias("old"), F.col("file").alias("file"), F.lit(1).alias("o")), new.select("id", F.col("code").alias("new"), F.lit(1).alias("n"))
    both = o.join(n, "id", "full")
    if broken is not None:
        both = both.join(broken.select("file", F.lit(1).alias("b")).distinct(), "file", "left")
    else:
        both = both.withColumn("b", F.lit(None))
    status = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), F.when(F.col("b").isNotNull(), "modified").otherwise("deleted")).when(~F.col("old").eqNullSafe(F.col("new")), "modified")
    return both.select("id", status.alias("status")).where("status is not null")


def touched_symbols(symbols: DataFrame, hunks: DataFrame, bin_lines: int = BIN_LINES) -> DataFrame:
    """Symbols(file, id, start, end) that a hunk(file, hstart, hend) overlaps.

    Both sides are cut into bins of bin_lines, which are joined with the file, so that a
    long file is spread and a symbol meets the hunks of its own bins only.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bin_lines), F.floor(F.greatest(a, b) / bin_lines)))
    s = symbols.select("file", "id", "start", "end").withColumn("bin", bins("start", "end"))
    h = hunks.select("file", "hstart", "hend").distinct().withColumn("bin", bins("hstart", "hend"))
    return s.join(h, ["file", "bin"]).where("hstart <= end and hend >= start").select("id").distinct()


def cochange_cases(commit_symbols: DataFrame) -> DataFrame:
    """(query, commit, truth): each symbol once, with the newest commit that changed it and others."""
    c = commit_symbols.select("commit", "ord", "id").distinct().withColumn("size", F.count("*").over(Window.partitionBy("commit"))).where("size >= 2")
    first = c.withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("ord"), "commit"))).where("rn = 1").select(F.col("id").alias("query"), "commit")
    return first.join(c.select("commit", "id"), "commit").where("id <> query").groupBy("query", "commit").agg(F.array_sort(F.collect_list("id")).alias("truth"))


def noisy_commits(commits: DataFrame) -> DataFrame:
    """commits(commit, n_symbols, n_files) with reason: 20 symbols, else 10 files."""
    return commits.withColumn("reason", F.when(F.col("n_symbols") >= 20, "symbols").when(F.col("n_files") >= 10, "files").otherwise("none"))


def changed_symbols(touched: DataFrame, prior: DataFrame, current: DataFrame, broken: DataFrame) -> DataFrame:
    """Ids(id) touched by hunks, prior(id, file) ids of broken(file) files, and prior ids that current(id) lacks."""
    held = prior.join(broken.select("file").distinct(), "file", "left_semi").select("id")
    gone = prior.select("id").join(current.select("id"), "id", "left_anti")
    return touched.select("id").union(held).union(gone).distinct()
