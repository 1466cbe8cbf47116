"""Paired statistics and calibration over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewake.runtime import cut, range_sorted, small


def average_ranks(values: DataFrame, x: str, n: str) -> DataFrame:
    """(x, r) of distinct values(x, n), n times each: the rank over all, which ties share as their mean.

    Values are range-sorted and their counts added up by part, so no task has all of them.
    """
    s = range_sorted(values.select(x, n), x, names=("tw_part", "tw_pos"))
    here = F.sum(n).over(Window.partitionBy("tw_part").orderBy(x).rowsBetween(Window.unboundedPreceding, -1))
    s = s.withColumn("tw_here", F.coalesce(here, F.lit(0)))
    parts = s.groupBy("tw_part").agg(F.sum(n).alias("tw_sum")).select(F.col("tw_part").alias("tw_of"), F.coalesce(F.sum("tw_sum").over(Window.orderBy("tw_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("tw_ahead"))
    before = F.col("tw_ahead") + F.col("tw_here")
    return s.join(small(parts), F.col("tw_part") == F.col("tw_of")).select(x, (before + (F.col(n) + 1) / 2.0).alias("r"))


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """r, or null under three rows or for a constant."""
    a = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(F.count("*").alias("n"), F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"), F.corr(x, y).alias("r"))
    return a.select("n", F.when((F.col("n") >= 3) & (F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1")), F.col("r")).alias("r"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson's r of average ranks, over distinct pairs with their counts."""
    pairs = cut(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("n")))
    rx = average_ranks(pairs.groupBy("x").agg(F.sum("n").alias("n")), "x", "n").withColumnRenamed("r", "rx")
    ry = average_ranks(pairs.groupBy("y").agg(F.sum("n").alias("n")), "y", "n").withColumnRenamed("r", "ry")
    mean = pairs.agg(((F.sum("n") + 1) / 2.0).alias("m"))  # of ranks, known
    d = pairs.join(rx, "x").join(ry, "y").crossJoin(F.broadcast(mean)).select("n", (F.col("rx") - F.col("m")).alias("a"), (F.col("ry") - F.col("m")).alias("b"))
    s = d.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("a") * F.col("b")).alias("ab"), F.sum(F.col("n") * F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("n") * F.col("b") * F.col("b")).alias("bb"))
    return s.select(F.coalesce("n", F.lit(0)).alias("n"), F.when((F.col("n") >= 3) & (F.col("aa") > 0) & (F.col("bb") > 0), F.col("ab") / F.sqrt(F.col("aa") * F.col("bb"))).alias("r"))


def two_sided_p(z):
    """P(|Z| >= |z|) of a standard normal, from a Chebyshev fit of erfc with a relative error under 1.2e-7."""
    x = F.abs(z) / 2.0**0.5
    t = 1.0 / (1.0 + x / 2.0)
    poly = F.lit(0.17087277)
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        poly = poly * t + c
    return t * F.exp(-x * x + poly)


def wilcoxon(pairs: DataFrame) -> DataFrame:
    """(n, w, z, p) of pairs(a, b): zeros dropped, ties averaged, with tie correction; under six pairs z is null and p 1."""
    d = pairs.select((F.col("a") - F.col("b")).alias("d")).where("d <> 0")
    m = cut(d.groupBy(F.abs("d").alias("m")).agg(F.count("*").alias("n"), F.count_if(F.col("d") > 0).alias("up"), F.count_if(F.col("d") < 0).alias("down")))
    r = m.join(average_ranks(m, "m", "n"), "m")
    t = F.col("n").cast("double")
    s = r.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("up") * F.col("r")), F.lit(0.0)).alias("up"), F.coalesce(F.sum(F.col("down") * F.col("r")), F.lit(0.0)).alias("down"),
        F.coalesce(F.sum(t * t * t - t), F.lit(0.0)).alias("ties"),
    )
    n = F.col("n").cast("double")
    variance = n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    s = s.select("n", F.least("up", "down").alias("w"), F.when((F.col("n") >= 6) & (variance > 0), (F.least("up", "down") - n * (n + 1) / 4 + 0.5) / F.sqrt(variance)).alias("z"))
    return s.select("n", "w", "z", F.coalesce(F.least(F.lit(1.0), two_sided_p(F.col("z"))), F.lit(1.0)).alias("p"))


def holm(tests: DataFrame) -> DataFrame:
    """tests(name, p) with adjusted: the running maximum of (m - rank) * p, 1 at most.

    Tests are range-sorted; each part's maximum is carried over those before it.
    """
    s = range_sorted(tests, "p", "name")
    s = s.crossJoin(F.broadcast(tests.agg(F.count("*").alias("tw_m"))))
    s = s.withColumn("tw_raw", (F.col("tw_m") - F.col("tw_pos") + 1) * F.col("p"))
    parts = s.groupBy("tw_part").agg(F.max("tw_raw").alias("top")).select(F.col("tw_part").alias("tw_of"), F.max("top").over(Window.orderBy("tw_part").rowsBetween(Window.unboundedPreceding, -1)).alias("tw_top"))
    here = F.max("tw_raw").over(Window.partitionBy("tw_part").orderBy("tw_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    s = s.withColumn("tw_here", here).join(small(parts), F.col("tw_part") == F.col("tw_of"))
    return s.withColumn("adjusted", F.least(F.lit(1.0), F.greatest("tw_here", "tw_top"))).select(*tests.columns, "adjusted")


def reliability(df: DataFrame, p: str, y: str, bins: int = 5) -> DataFrame:
    """(bin, n, mean_p, mean_y); the last bin is closed."""
    return df.groupBy(F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("mean_y"))


def ece_brier(df: DataFrame, p: str, y: str, bins: int = 5) -> DataFrame:
    ece = reliability(df, p, y, bins).agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("mean_y"))) / F.sum("n")).alias("ece"))
    return ece.crossJoin(df.agg(F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).alias("brier")))


def calibration_buckets(df: DataFrame, score: str, recall: str) -> DataFrame:
    """Buckets of 20 points; 100 is in the last."""
    return df.groupBy(F.least(F.floor(F.col(score) / 20), F.lit(4)).cast("int").alias("bucket")).agg(F.count("*").alias("n"), F.avg(recall).alias("mean_recall"))


def moments(df: DataFrame, xs: list[str], y: str) -> DataFrame:
    """One row: n, the mean of each column (m0.., the last of y) and of each product of two (p0_0..)."""
    cols = [*xs, y]
    return df.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)], *[F.avg(F.col(a) * F.col(b)).alias(f"p{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j])


def ridge(df: DataFrame, xs: list[str], y: str, lam: float = 1e-6, least: int = 30):
    """(intercept, weights) on standardised columns, or None under `least` rows; moments in Spark, a small solve here."""
    import numpy as np

    row, k = moments(df, xs, y).first(), len(xs) + 1
    if row["n"] < least:
        return None
    m = np.array([row[f"m{i}"] for i in range(k)], float)
    c = np.array([[row[f"p{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float) - np.outer(m, m)
    s = np.sqrt(np.maximum(np.diag(c)[:-1], 0))
    s[s <= 1e-6] = 1
    w = np.linalg.solve(c[:-1, :-1] / np.outer(s, s) + lam / row["n"] * np.eye(k - 1), c[:-1, -1] / s) / s
    return float(m[-1] - w @ m[:-1]), w


def predict_recall(intercept: float, weights, xs: list[str]):
    """The fitted recall of a row, from 0 to 1."""
    raw = F.lit(float(intercept))
    for c, w in zip(xs, weights, strict=True):
        raw = raw + F.col(c) * float(w)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw))


def _draw(seed: int, *of):
    """A number from 0 to 1 that follows from the columns."""
    return F.pmod(F.xxhash64(F.lit(seed), *of), F.lit(1 << 52)) / F.lit(float(1 << 52))


def bootstrap_ci(values: DataFrame, x: str, key: str, rounds: int = 1000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """(low, high): percentiles of the mean over resamples.

    Each row is weighted in each round by a Poisson number of rate 1 that a hash of its key
    and the round draws, so rounds are sums that every partition adds up by itself.
    """
    cumulative, p, total = [], 2.718281828459045**-1, 0.0
    for k in range(1, 13):
        total += p
        cumulative.append(total)
        p /= k
    draw = _draw(seed, F.col(key), F.col("round"))
    weight = sum((F.when(draw >= c, 1).otherwise(0) for c in cumulative), F.lit(0))
    rows = values.where(F.col(x).isNotNull()).select(F.col(x).cast("double").alias("v"), key).withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    means = rows.withColumn("weight", weight).groupBy("round").agg((F.sum(F.col("weight") * F.col("v")) / F.nullif(F.sum("weight"), F.lit(0))).alias("mean"))
    at = F.row_number().over(Window.orderBy("mean")) - 1  # a row a round
    lo, hi = int((1 - level) / 2 * rounds), min(int((1 + level) / 2 * rounds), rounds - 1)
    return means.where("mean is not null").withColumn("i", at).agg(F.max(F.when(F.col("i") == lo, F.col("mean"))).alias("low"), F.max(F.when(F.col("i") == hi, F.col("mean"))).alias("high"))


def permutation_p(pairs: DataFrame, key: str, rounds: int = 10_000, seed: int = 42) -> DataFrame:
    """(n, observed, p) of pairs(a, b, key): two-sided test of the mean difference by flipping signs, which hashes draw."""
    d = pairs.select((F.col("a") - F.col("b")).cast("double").alias("d"), key).where("d is not null")
    total = d.agg(F.count("*").alias("n"), F.sum("d").alias("s"))
    flips = d.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    sums = flips.groupBy("round").agg(F.sum(F.when(_draw(seed, F.col(key), F.col("round")) < 0.5, F.col("d")).otherwise(-F.col("d"))).alias("t"))
    hits = sums.crossJoin(F.broadcast(total)).groupBy("n", "s").agg(F.count_if(F.abs("t") >= F.abs("s") - 1e-12 * F.abs("s")).alias("k"))
    return hits.select("n", (F.col("s") / F.col("n")).alias("observed"), ((F.col("k") + 1) / F.lit(rounds + 1.0)).alias("p"))
