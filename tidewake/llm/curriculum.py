"""Mixing sources to target weights that change over training.

A source's weight is a piecewise linear function of training time t in [0, 1]; weights
add to 1 at each knot. They are given as a table ``targets(source, t, weight)``, a row a
source and knot (a pair without a row weighs 0, sources without text are left out and the
others' weights scaled to add to 1), or follow from the sources' shares. Its integral times the token budget is what the source must have
supplied by t. A document's tokens stand somewhere in its source's stream (documents in
the order of md5(doc_id)), and the time at which demand reaches their middle is the
document's training position; documents are range-sorted by it. A source that demands
more than it has starts over, as often as its demand takes (up to ``max_epochs``, if that
is given); what exceeds its demand isn't used.

Prefix sums are taken in two levels, over buckets of a source and inside a bucket, so a
hot source is spread over BUCKETS tasks.

Defined results: a null source is ``unknown``; a source that ``targets`` doesn't name isn't
used; a null doc_id is ordered by its text; tokens are runs of characters that aren't
white space; a document without one has no share and is left out; repeated rows each
take their own tokens; equal keys are interchangeable, since they have equal texts or
are ordered by text length. Other columns are ignored by ``positions`` and carried by
``mixed``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewake.runtime import cut, fresh

#: Hex digits of md5 that make a bucket.
BUCKET_DIGITS = 3
#: Knots of a table of targets at most.
MOST_KNOTS = 1_000
#: Knots of time, and at each the exponent's blend of natural shares and their square roots.
KNOTS = (0.0, 0.5, 1.0)
FLATNESS = (0.0, 1.0, 1.0)


def schedule(supply: DataFrame, knots=KNOTS, flatness=FLATNESS) -> DataFrame:
    """(source, supply, total, w0.., c0..): weights and their integral at each knot.

    At a knot of flatness f the weight is (1 - f) * p + f * sqrt(p) / sum(sqrt(p)), p the
    source's share of all tokens.
    """
    every = Window.partitionBy(F.lit(0))  # a row a source
    s = supply.withColumn("total", F.sum("supply").over(every)).withColumn("p", F.col("supply") / F.col("total"))
    s = s.withColumn("r", F.sqrt("p")).withColumn("r", F.col("r") / F.sum("r").over(every))
    for i, f in enumerate(flatness):
        s = s.withColumn(f"w{i}", F.col("p") * (1.0 - f) + F.col("r") * f)
    return _integrated(s.drop("p", "r"), knots)


def _integrated(s: DataFrame, knots) -> DataFrame:
    s = s.withColumn("c0", F.lit(0.0))
    for i in range(1, len(knots)):
        s = s.withColumn(f"c{i}", F.col(f"c{i - 1}") + (F.col(f"w{i - 1}") + F.col(f"w{i}")) * ((knots[i] - knots[i - 1]) / 2.0))
    return s


def knots_of(targets: DataFrame) -> tuple[float, ...]:
    """The distinct times of targets, which must hold 0 and 1 and MOST_KNOTS at most."""
    times = [r[0] for r in targets.select(F.col("t").cast("double").alias("t")).where("t is not null").distinct().orderBy("t").limit(MOST_KNOTS + 1).collect()]
    if len(times) > MOST_KNOTS or len(times) < 2 or times[0] != 0.0 or times[-1] != 1.0:
        raise ValueError(f"targets need times from 0 to 1, and at most {MOST_KNOTS} of them")
    return tuple(times)


def schedule_from(supply: DataFrame, targets: DataFrame, knots) -> DataFrame:
    """The like of ``schedule`` from given weights, scaled to add to 1 at each knot."""
    at = [F.sum(F.when(F.col("t").cast("double") == k, F.greatest(F.col("weight").cast("double"), F.lit(0.0))).otherwise(0.0)).alias(f"w{i}") for i, k in enumerate(knots)]
    given = targets.groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(*at)
    every = Window.partitionBy(F.lit(0))  # a row a source
    s = supply.withColumn("total", F.sum("supply").over(every)).join(given, "source")
    for i in range(len(knots)):
        s = s.withColumn(f"w{i}", F.coalesce(F.col(f"w{i}") / F.nullif(F.sum(f"w{i}").over(every), F.lit(0.0)), F.lit(0.0)))
    return _integrated(s, knots)


def _position(x, knots):
    """The time at which the integral of the weight reaches x."""
    out = None
    for i in range(len(knots) - 1, 0, -1):
        w0, w1, c0, width = F.col(f"w{i - 1}"), F.col(f"w{i}"), F.col(f"c{i - 1}"), knots[i] - knots[i - 1]
        y = F.greatest(x - c0, F.lit(0.0))
        u = 2.0 * y / F.nullif(w0 + F.sqrt(F.greatest(w0 * w0 + (w1 - w0) * (2.0 / width) * y, F.lit(0.0))), F.lit(0.0))
        at = F.least(F.lit(knots[i - 1]) + F.coalesce(u, F.lit(0.0)), F.lit(knots[i]))
        out = at if out is None else F.when(x <= F.col(f"c{i}"), at).otherwise(out)
    return out


def _placed(docs: DataFrame, keep: list[str], budget: int | None, knots, flatness, max_epochs: int | None, targets: DataFrame | None) -> DataFrame:
    source, n, key, bucket = "tw_source", "tw_n", "tw_key", "tw_bucket"  # names in keep are of the callers here
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")).cast("binary"))
    df = docs.select(
        *keep, F.coalesce("source", F.lit("unknown")).alias(source), F.regexp_count("text", F.lit(r"\S+")).cast("long").alias(n),
        digest.alias(key), F.length("text").alias("tw_len"),
    ).where(F.col(n) > 0)
    df = df.withColumn(bucket, F.substring(key, 1, BUCKET_DIGITS))
    narrow = docs.select(
        F.coalesce("source", F.lit("unknown")).alias("source"), F.substring(digest, 1, BUCKET_DIGITS).alias("bucket"),
        F.regexp_count("text", F.lit(r"\S+")).cast("long").alias("n"),
    ).where("n > 0")
    sums = cut(narrow.groupBy("source", "bucket").agg(F.sum("n").alias("n")))
    supply = sums.groupBy("source").agg(F.sum("n").alias("supply"))
    if targets is None:
        plan = schedule(supply, knots, flatness)
    else:
        knots = knots_of(targets)
        plan = schedule_from(supply, targets, knots)
    if budget:
        plan = plan.withColumn("total", F.lit(budget).cast("long"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n").join(plan, "source").withColumnRenamed("source", "tw_s").withColumnRenamed("bucket", "tw_b")
    within = Window.partitionBy(source, bucket).orderBy(key, "tw_len", n).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("tw_upto", F.sum(n).over(within))
    # rows are at their (source, bucket) already, for the prefix sums: only these few are moved
    df = df.join(cut(sums).hint("shuffle_hash"), (F.col(source) == F.col("tw_s")) & (F.col(bucket) == F.col("tw_b")))
    last = len(knots) - 1
    uses = F.greatest(F.lit(1), F.ceil(F.col(f"c{last}") * F.col("total") / F.col("supply")).cast("int"))
    uses = uses if max_epochs is None else F.least(uses, F.lit(max_epochs))
    df = df.withColumn("tw_epoch", F.explode(F.sequence(F.lit(0), uses - 1)))
    x = (F.col("tw_epoch") * F.col("supply") + F.col("ahead") + F.col("tw_upto") - F.col(n) / F.lit(2.0)) / F.col("total")
    return df.withColumn("tw_x", x).where(F.col("tw_x") <= F.col(f"c{last}")).withColumn("tw_position", _position(F.col("tw_x"), knots)).withColumnRenamed(source, "tw_source_").withColumnRenamed(n, "tw_n_")


def positions(docs: DataFrame, budget: int | None = None, knots=KNOTS, flatness=FLATNESS, max_epochs: int | None = None, targets: DataFrame | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, epoch, position), a row for each use of a document, in training order."""
    d = _placed(docs, ["doc_id"], budget, knots, flatness, max_epochs, targets)
    out = d.select("doc_id", F.col("tw_source_").alias("source"), F.col("tw_n_").alias("n_tokens"), F.col("tw_epoch").alias("epoch"), F.round("tw_position", 6).alias("position"))
    return out.orderBy("position", "doc_id")


def mixed(docs: DataFrame, budget: int | None = None, knots=KNOTS, flatness=FLATNESS, max_epochs: int | None = None, targets: DataFrame | None = None) -> DataFrame:
    """The rows of docs in training order, each as often as it is used."""
    names = fresh(docs, *[f"tw_column_{i}" for i in range(len(docs.columns))])
    d = docs.select("*", *[F.col(f"`{c}`").alias(t) for c, t in zip(docs.columns, names, strict=True)])
    out = _placed(d, names, budget, knots, flatness, max_epochs, targets).select(*names, "tw_position").orderBy("tw_position").drop("tw_position")
    return out.toDF(*docs.columns)


POSITIONS_SQL = r"""
with d as (
  select doc_id, coalesce(source, 'unknown') as source, cast(len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')) as bigint) as n_tokens,
         md5(coalesce(cast(doc_id as varchar), '')) as k, length(text) as len
  from documents where text is not null),
e as (select * from d where n_tokens > 0),
s as (select source, cast(sum(n_tokens) as bigint) as supply from e group by 1),
t as (select source, supply, cast(sum(supply) over () as bigint) as total, supply / sum(supply) over () as p from s),
r as (select *, sqrt(p) / sum(sqrt(p)) over () as r from t),
w as (select source, supply, total, p as w0, r as w1, r as w2, (p + r) * 0.25 as c1, (p + r) * 0.25 + (r + r) * 0.25 as c2 from r),
o as (select *, sum(n_tokens) over (partition by source order by k, len, n_tokens rows unbounded preceding) as upto from e),
x as (select o.doc_id, o.source, o.n_tokens, w.*exclude(source), ep.epoch, (ep.epoch * w.supply + o.upto - o.n_tokens / 2.0) / w.total as x
      from o join w using (source), (select unnest([0, 1, 2, 3]) as epoch) ep)
select doc_id, source, n_tokens, cast(epoch as integer) as epoch,
  round(case when x <= c1 then least(2.0 * x / (w0 + sqrt(w0 * w0 + (w1 - w0) * 4.0 * x)), 0.5)
             else least(0.5 + 2.0 * greatest(x - c1, 0.0) / (w1 + sqrt(w1 * w1 + (w2 - w1) * 4.0 * greatest(x - c1, 0.0))), 1.0) end, 6) as position
from x where x <= c2
"""
