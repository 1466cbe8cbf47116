"""Named queries over the test tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir), with its SQL if it has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


from pyspark.sql import Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tidewake.functions import stats  # noqa: E402
from tidewake.operators import blend, closure, diff, edges, evaluate, history, scoring, select, text  # noqa: E402
from tidewake.runtime import spread  # noqa: E402
from tidewake.streaming import limiter  # noqa: E402


def symbols(spark, d):
    """Documents as symbols: a source is a file, a language a directory."""
    line = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("lineno")
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("file"), F.col("lang").alias("directory"), F.col("text").alias("code"), line)


def fk_edges(spark, d):
    """The foreign keys as a dependency graph, as often as they stand: what reads it makes edges distinct."""
    k = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    parts = [("lineitem", "p:", "l_partkey", "s:", "l_suppkey"), ("supplier", "s:", "s_suppkey", "n:", "s_nationkey"), ("customer", "c:", "c_custkey", "n:", "c_nationkey"), ("nation", "n:", "n_nationkey", "r:", "n_regionkey")]
    rows = [table(spark, d, t).select(k(p, a).alias("src"), k(q, b).alias("dst")) for t, p, a, q, b in parts]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3])


def regions(spark, d):
    return table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("query_id"), F.concat(F.lit("r:"), F.col("r_regionkey").cast("string")).alias("id"))


def commit_files(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("file"))


def items(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


SYM = "symbols as (select doc_id as id, source as file, lang as directory, text as code, row_number() over (partition by source order by doc_id) as lineno from documents)"
TOK = "tok as (select id, lower(t) as term from (select id, unnest(regexp_extract_all(code, '[a-zA-Z_][a-zA-Z0-9_]*')) as t from symbols) where length(t) > 1), post as (select id, term, count(*) as tf from tok group by 1, 2), lens as (select s.id, coalesce(n, 0) as len from symbols s left join (select id, count(*) as n from tok group by 1) using (id))"
IDF = "df as (select term, count(*) as df from post group by 1), raw as (select term, df, ln((select count(*) from symbols) - df + 0.5) - ln(df + 0.5) as raw from df), fl as (select case when avg(raw) * 0.25 > 0 then avg(raw) * 0.25 else 0.25 end as f from raw), idf as (select term, df, case when raw < 0 then (select f from fl) else raw end as idf from raw)"
BM25 = f"{SYM}, {TOK}, {IDF}, q as (select query_id, lower(t) as term, count(*) as qf from (select item_id as query_id, unnest(regexp_extract_all(text, '[a-zA-Z_][a-zA-Z0-9_]*')) as t from benchmark) where length(t) > 1 group by 1, 2), bm as (select query_id, post.id, sum(qf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * len / (select avg(len) from lens)))) as score from post join q using (term) join idf using (term) join lens on lens.id = post.id group by 1, 2)"
FK = "edges as (select distinct 'p:' || l_partkey as src, 's:' || l_suppkey as dst from lineitem union all select 's:' || s_suppkey, 'n:' || s_nationkey from supplier union all select 'c:' || c_custkey, 'n:' || c_nationkey from customer union all select 'n:' || n_nationkey, 'r:' || n_regionkey from nation)"
BLAST = f"with recursive {FK}, b(query_id, id, hops) as (select cast(r_regionkey as bigint), 'r:' || r_regionkey, 0 from region union select b.query_id, e.src, hops + 1 from b join edges e on e.dst = b.id), m as (select query_id, id, min(hops) as hops from b group by 1, 2)"
CF = "cf as (select distinct l_orderkey as commit, l_partkey as file from lineitem), sz as (select commit, count(*) as size from cf group by 1), ok as (select cf.* from cf join sz using (commit) where size between 2 and 25), pairs as (select a.file as a, b.file as b, count(*) as n from ok a join ok b on a.commit = b.commit and a.file <> b.file group by 1, 2), tot as (select file, count(*) as n from cf group by 1)"


@query(f"{BLAST} select left(id, 1) as kind, hops, count(*) as n, round(85.0 * power(0.85, hops - 1), 6) as score from m where hops > 0 group by 1, 2")
def blast_by_kind(spark, d):
    b = closure.blast_radius(fk_edges(spark, d), regions(spark, d))
    return b.groupBy(F.substring("id", 1, 1).alias("kind"), "hops").agg(F.count("*").alias("n")).withColumn("score", F.round(85.0 * F.pow(F.lit(0.85), F.col("hops") - 1), 6))


@query(f"{BLAST} select query_id, id from m where hops > 0")
def blast_radius(spark, d):
    return closure.blast_radius(fk_edges(spark, d), regions(spark, d)).select("query_id", "id")


@query(f"with recursive {FK}, b(query_id, id, hops) as (select c_custkey, 'c:' || c_custkey, 0 from customer union all select b.query_id, e.dst, hops + 1 from b join edges e on e.src = b.id where hops < 2) select distinct query_id, id from b")
def expand_deps_depth2(spark, d):
    seeds = table(spark, d, "customer").select(F.col("c_custkey").alias("query_id"), F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("id"))
    return closure.expand_dependencies(fk_edges(spark, d), seeds, 2).select("query_id", "id")


@query(f"with recursive {FK}, u as (select src, dst from edges union select dst, src from edges), b(query_id, id, hops) as (select cast(r_regionkey as bigint), 'r:' || r_regionkey, 0 from region union select b.query_id, u.dst, hops + 1 from b join u on u.src = b.id where hops < 3) select query_id, count(distinct id) as n from b group by 1")
def undirected_within_3(spark, d):
    return closure.within_undirected(fk_edges(spark, d), regions(spark, d), 3).groupBy("query_id").agg(F.count("*").alias("n"))


@query(f"with {FK} select distinct dst as src, src as dst from edges")
def reverse_graph(spark, d):
    return closure.reverse_graph(fk_edges(spark, d))


@query()
def weak_components(spark, d):
    """Components over all foreign keys: their least id and size; a test has union-find over the same edges."""
    return closure.min_label_components(fk_edges(spark, d)).groupBy(F.col("label").alias("component")).agg(F.count("*").alias("n"))


@query(f"with {FK}, e as (select distinct src, dst from edges), nodes as (select src as id from e union select dst from e), i as (select dst as id, count(*) as c from e group by 1), o as (select src as id, count(*) as c from e group by 1) select cast(coalesce(i.c, 0) as bigint) as indeg, cast(coalesce(o.c, 0) as bigint) as outdeg, count(*) as n from nodes left join i using (id) left join o using (id) group by 1, 2")
def degree_stats(spark, d):
    e = fk_edges(spark, d).distinct()
    g = edges.degrees(e, e.select(F.col("src").alias("id")).union(e.select("dst")))
    return g.groupBy(F.col("indeg").cast("long").alias("indeg"), F.col("outdeg").cast("long").alias("outdeg")).agg(F.count("*").alias("n"))


@query("select cast(avg(case when o_custkey is not null then 1.0 else 0.0 end) as double) as confidence from customer left join (select distinct o_custkey from orders) on c_custkey = o_custkey")
def graph_confidence(spark, d):
    e = table(spark, d, "customer").select(F.lit(0).alias("src"), F.col("c_custkey").alias("dst"))
    return edges.graph_confidence(e, table(spark, d, "orders").select(F.col("o_custkey").alias("id")))


@query(f"with {SYM} select sum(len) as tokens, count(*) as docs, sum(a) as estimate_a, sum(b) as estimate_b from (select len(list_filter(regexp_extract_all(code, '[a-zA-Z_][a-zA-Z0-9_]*'), lambda t: length(t) > 1)) as len, greatest(1, cast(floor(length(code) / 4 * 1.2) as bigint)) as a, greatest(1, length(code) // 4) as b from symbols)".replace("sum(len)", "cast(sum(len) as bigint)").replace("sum(a)", "cast(sum(a) as bigint)").replace("sum(b)", "cast(sum(b) as bigint)"))
def token_estimates(spark, d):
    s = symbols(spark, d)
    return s.agg(F.sum(F.size(text.tokens()).cast("long")).alias("tokens"), F.count("*").alias("docs"), F.sum(text.estimate_tokens()).alias("estimate_a"), F.sum(text.estimate_tokens_final()).alias("estimate_b"))


@query(f"with {SYM}, {TOK}, {IDF} select term, df, round(idf, 6) as idf from idf")
def bm25_idf(spark, d):
    s = symbols(spark, d)
    return text.bm25_idf(text.term_counts(s), s.agg(F.count("*").alias("n"))).select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"with {BM25} select query_id, id, rank from (select query_id, id, row_number() over (partition by query_id order by round(score, 6) desc, id) as rank from bm where score > 0) where rank <= 10")
def bm25_topk(spark, d):
    s = text.bm25(symbols(spark, d), items(spark, d), 10).withColumn("score", F.round("score", 6))
    return text.top_k(s, 10).select("query_id", "id", "rank")


@query("with n as (select vec_id as id, embedding, label, sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * x))) as norm from embeddings), p as (select a.id as query_id, b.id as id, list_dot_product(cast(a.embedding as double[]), cast(b.embedding as double[])) / (a.norm * b.norm) as score from n a join n b on a.id <> b.id) select query_id, id, rank from (select query_id, id, row_number() over (partition by query_id order by round(score, 5) desc, id) as rank from p) where rank <= 10")
def dense_cosine_topk(spark, d):
    v = vectors(spark, d)
    return text.dense_topk(v, v.select(F.col("id").alias("query_id")), 10).select("query_id", "id", "rank")


@query(f"with {CF} select a, b, n from pairs where n >= 2")
def cochange_pairs(spark, d):
    return history.pair_counts(commit_files(spark, d), least=2)


@query(f"with {CF} select a, b, round(pairs.n / cast(tot.n as double), 6) as assoc from pairs join tot on tot.file = a where pairs.n >= 2")
def cochange_assoc(spark, d):
    return history.association(commit_files(spark, d)).select("a", "b", F.round("assoc", 6).alias("assoc"))


@query(f"with {CF}, ch as (select ps as query_id, p_partkey as file from (select p_partkey, p_size as ps from part)), s as (select query_id, b as file, max(pairs.n / cast(tot.n as double)) as score from ch join pairs on a = ch.file join tot on tot.file = a where pairs.n >= 2 group by 1, 2) select s.query_id, s.file, round(score, 6) as score from s left join ch using (query_id, file) where ch.file is null")
def cochange_for_changed(spark, d):
    changed = table(spark, d, "part").select(F.col("p_size").alias("query_id"), F.col("p_partkey").alias("file"))
    return history.scores_for_files(commit_files(spark, d), changed).select("query_id", "file", F.round("score", 6).alias("score"))


@query("with cf as (select distinct l_orderkey as commit, l_partkey as file from lineitem), keep as (select cf.* from cf left join (select o_orderkey from orders where o_orderstatus = 'F') on o_orderkey = commit where o_orderkey is null) select file, count(*) as n from keep group by 1")
def cochange_excluding(spark, d):
    gone = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("commit"))
    return history.file_counts(history.excluding(commit_files(spark, d), gone))


@query("with s as (select conv_id, turn, row_number() over (partition by conv_id order by turn) as rn, count(*) over (partition by conv_id) as n from conversations), p as (select a.conv_id, a.turn as x, b.turn as y from s a join s b on a.conv_id = b.conv_id and b.rn - a.rn between 1 and 3 where a.n between 2 and 60) select conv_id || ':' || x as src, conv_id || ':' || y as dst from p union select conv_id || ':' || y, conv_id || ':' || x from p")
def window_edges(spark, d):
    s = table(spark, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), F.col("conv_id").alias("file"), F.col("turn").alias("lineno"))
    return edges.window_edges(s)


@query(f"with {SYM}, rep as (select file, min(id) as rep from symbols group by 1), dir as (select distinct file, directory from symbols), m as (select directory, rep from dir join rep using (file)), ok as (select directory from m group by 1 having count(*) between 2 and 20) select distinct a.rep as src, b.rep as dst from m a join m b on a.directory = b.directory and a.rep <> b.rep join ok on ok.directory = a.directory")
def same_dir_edges(spark, d):
    return edges.same_directory_edges(symbols(spark, d))


@query("with m as (select distinct c_nationkey as target, c_mktsegment as file from customer), s as (select c_mktsegment as file, min(c_custkey) as rep from customer group by 1), x as (select target, rep from m join s using (file)), ok as (select target from x group by 1 having count(*) between 2 and 10) select distinct a.rep as src, b.rep as dst from x a join x b on a.target = b.target and a.rep <> b.rep join ok on ok.target = a.target")
def shared_import_edges(spark, d):
    c = table(spark, d, "customer")
    s = c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("file"), F.col("c_custkey").alias("lineno"))
    return edges.shared_import_edges(s, c.select(F.col("c_mktsegment").alias("file"), F.col("c_nationkey").alias("target")))


@query("with m as (select p_brand || '/' || p_type || '/' || p_size as fam, p_partkey as id from part), ok as (select fam from m group by 1 having count(*) between 2 and 6) select a.id as src, b.id as dst from m a join m b on a.fam = b.fam and a.id <> b.id join ok on ok.fam = a.fam")
def sibling_override_edges(spark, d):
    m = table(spark, d, "part").select(F.concat_ws("/", "p_brand", "p_type").alias("base"), F.col("p_size").cast("string").alias("method"), F.col("p_partkey").alias("id"))
    return edges.sibling_override_edges(m)


@query("with o as (select s_suppkey as src, s_nationkey as dst from supplier), ok as (select dst from o group by 1 having count(*) <= 8) select dst as src, src as dst from o join ok using (dst)")
def parent_child_edges(spark, d):
    return edges.parent_child_edges(table(spark, d, "supplier").select(F.col("s_suppkey").alias("src"), F.col("s_nationkey").cast("long").alias("dst"))).select(F.col("src").cast("int").alias("src"), "dst")


@query(f"{BLAST} select query_id, id, round(85.0 * power(0.85, hops - 1), 6) as score from m where hops between 1 and 8")
def score_backward(spark, d):
    return scoring.backward_scores(fk_edges(spark, d), regions(spark, d)).withColumn("score", F.round("score", 6))


@query(f"with {FK}, e as (select distinct src, dst from edges), ch as (select s_suppkey as query_id, 's:' || s_suppkey as id from supplier), od as (select src, count(*) as k from e group by 1 having count(*) > 1), co as (select ch.query_id, x.dst as id, k from ch join e c on c.dst = ch.id join od on od.src = c.src join e x on x.src = c.src where x.dst <> ch.id) select query_id, id, round(least(sum(log2(1 + 60.0 / k)), 80.0), 6) as bonus from co group by 1, 2")
def sibling_bonus(spark, d):
    changed = table(spark, d, "supplier").select(F.col("s_suppkey").alias("query_id"), F.concat(F.lit("s:"), F.col("s_suppkey").cast("string")).alias("id"))
    return scoring.sibling_bonus(fk_edges(spark, d), changed).withColumn("bonus", F.round("bonus", 6))


@query(f"{BLAST}, e as (select distinct src, dst from edges), i as (select dst as id, count(*) as c from e group by 1), o as (select src as id, count(*) as c from e group by 1), s as (select query_id, id, case when hops = 0 then 100.0 when hops <= 8 then 85.0 * power(0.85, hops - 1) end as score from m), dep as (select distinct m.query_id, e.dst as id from m join e on e.src = m.id union select distinct m.query_id, f.dst from m join e on e.src = m.id join e f on f.src = e.dst), al as (select coalesce(s.query_id, dep.query_id) as query_id, coalesce(s.id, dep.id) as id, coalesce(score, 30.0) as score from s full join dep on s.query_id = dep.query_id and s.id = dep.id), sib as (select m.query_id, x.dst as id, least(sum(log2(1 + 60.0 / k)), 80.0) as bonus from m join e c on c.dst = m.id and m.hops = 0 join (select src, count(*) as k from e group by 1 having count(*) > 1) od on od.src = c.src join e x on x.src = c.src where x.dst <> m.id group by 1, 2) select al.query_id, al.id, round(score + coalesce(bonus, 0) + least(15.0, 3 * log2(1.0 + coalesce(i.c, 0)) + log2(1.0 + coalesce(o.c, 0))), 6) as score from al left join sib on sib.query_id = al.query_id and sib.id = al.id left join i on i.id = al.id left join o on o.id = al.id")
def impact_scores(spark, d):
    return scoring.impact_scores(fk_edges(spark, d), regions(spark, d)).withColumn("score", F.round("score", 6))


def _signals(spark, d, by_query=False):
    """by_query: shuffled once by query, which serves all windows and sums over a query's rows."""
    li = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_quantity")
    if by_query:
        li = spread(li, li.count(), "l_suppkey")
    e = li.groupBy(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("id")).agg(F.sum("l_quantity").alias("score"), F.count("*").alias("n"))
    return e


SIG = "sig as (select l_suppkey as query_id, l_partkey as id, sum(l_quantity) as score, count(*) as n from lineitem group by 1, 2)"


@query(f"with {SIG}, w as (select *, min(score) over (partition by query_id) as a, max(score) over (partition by query_id) as b from sig) select query_id, id, round(case when a = b then 0.5 else (score - a) / nullif(b - a, 0) end, 6) as score from w")
def minmax_normalize(spark, d):
    return blend.normalise(_signals(spark, d)).withColumn("score", F.round("score", 6))


@query(f"with {SIG} select query_id, round(0.3 * least(1.0, count(*) / 8.0), 6) as wg, round(0.5 + 0.3 * (1 - least(1.0, count(*) / 8.0)), 6) as wb, 0.2::double as wf from sig group by 1")
def adaptive_weights(spark, d):
    w = blend.adaptive_weights(_signals(spark, d))
    return w.select("query_id", F.round("wg", 6).alias("wg"), F.round("wb", 6).alias("wb"), "wf")


def _same_brand(spark, d):
    """The brand of the part that has the query's number, and that of each part."""
    p = table(spark, d, "part")
    own = p.select(F.col("p_partkey").alias("query_id"), "p_brand").join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("query_id")), "query_id", "left_semi")
    return own.select("query_id", F.col("p_brand").alias("file")), p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("file"))


NORM = """
g as (
  select query_id, id, case when min(score) over w = max(score) over w then 0.5
    else (score - min(score) over w) / nullif(max(score) over w - min(score) over w, 0) end as s
  from graph window w as (partition by query_id)),
l as (
  select query_id, id, case when min(n) over w = max(n) over w then 0.5
    else (n - min(n) over w) / cast(nullif(max(n) over w - min(n) over w, 0) as double) end as s
  from lexical window w as (partition by query_id)),
f as (
  select a.p_partkey as query_id, b.p_partkey as id from part a join part b using (p_brand)
  where a.p_partkey in (select s_suppkey from supplier)),
c as (select query_id, least(1.0, count(*) / 8.0) as c from graph group by 1)"""


@query(f"""
with {SIG}, graph as (select * from sig), lexical as (select * from sig), {NORM}
select query_id, id, round(sum(x), 10) as score from (
  select query_id, id, 100 * 0.3 * c * s as x from g join c using (query_id)
  union all select query_id, id, 100 * (0.8 - 0.3 * coalesce(c, 0)) * s from l left join c using (query_id)
  union all select query_id, id, 20.0 from f) group by 1, 2""")
def hybrid_blend(spark, d):
    s = _signals(spark, d, True)
    lex = s.select("query_id", "id", F.col("n").cast("double").alias("score"))
    return blend.hybrid(s.select("query_id", "id", "score"), lex, _same_brand(spark, d)).withColumn("score", F.round("score", 10))


@query(f"""
with {SIG}, ch as (select query_id, min(id) as id from sig group by 1),
graph as (select sig.* from sig join supplier on s_suppkey = query_id where s_acctbal >= 0 and id not in (select id from ch where ch.query_id = sig.query_id)),
lexical as (select * from sig where id not in (select id from ch where ch.query_id = sig.query_id)), {NORM}, {CF},
h as (
  select query_id, b as id, max(pairs.n / cast(tot.n as double)) as s
  from ch join pairs on a = ch.id join tot on tot.file = a where pairs.n >= 2 group by 1, 2)
select query_id, id, round(sum(x), 10) as score from (
  select query_id, id, 100 * 0.3 * c * s as x from g join c using (query_id)
  union all select query_id, id, 100 * (0.8 - 0.3 * coalesce(c, 0)) * s from l left join c using (query_id)
  union all select f.query_id, f.id, 20.0 from f anti join ch on ch.query_id = f.query_id and ch.id = f.id
    where f.query_id in (select query_id from ch)
  union all select query_id, id, 15 * s from h) group by 1, 2
union all select sig.query_id, sig.id, round(score, 10) from sig join ch on ch.query_id = sig.query_id and ch.id = sig.id
  join supplier on s_suppkey = sig.query_id where s_acctbal >= 0""")
def hybrid_cochange(spark, d):
    """All four signals; queries of suppliers in debt have no graph candidate, the changed part keeps its graph score."""
    s = _signals(spark, d, True)
    changed = s.groupBy("query_id").agg(F.min("id").alias("id"))
    graph = s.join(table(spark, d, "supplier").where("s_acctbal >= 0").select(F.col("s_suppkey").alias("query_id")), "query_id", "left_semi").select("query_id", "id", "score")
    lex = s.select("query_id", "id", F.col("n").cast("double").alias("score"))
    past = history.scores_for_files(commit_files(spark, d), changed.withColumnRenamed("id", "file"), some=True).withColumnRenamed("file", "id")
    return blend.hybrid(graph, lex, _same_brand(spark, d), None, past, changed).withColumn("score", F.round("score", 10))


@query(f"with {SIG}, r as (select query_id, id, row_number() over (partition by query_id order by score desc, id) as rank from sig union all select query_id, id, row_number() over (partition by query_id order by n desc, id) from sig) select query_id, id, round(sum(1.0 / (60 + rank)), 6) as score, min(rank) as best from r group by 1, 2")
def rrf_fusion(spark, d):
    s = _signals(spark, d)
    ranks = blend.ranked(s.select("query_id", "id", "score")).select("query_id", "id", "rank").unionByName(blend.ranked(s.select("query_id", "id", F.col("n").alias("score"))).select("query_id", "id", "rank"))
    return blend.reciprocal_rank_fusion(ranks).withColumn("score", F.round("score", 6)).withColumn("best", F.col("best").cast("long"))


@query(f"with {SIG}, r as (select *, row_number() over (partition by query_id order by score desc, id) as rank, max(score) over (partition by query_id) as peak from sig) select query_id, id, rank from r where rank <= 100 and (score >= 0.5 * peak or rank <= 10)")
def rel_peak_cutoff(spark, d):
    return blend.peak_cut(_signals(spark, d), 0.5).select("query_id", "id", F.col("rank").cast("long").alias("rank"))


@query(f"with {SIG}, r as (select query_id, score, row_number() over w as rn, lead(score) over w as nx from sig window w as (partition by query_id order by score desc, id)), t as (select query_id, rn, case when nx is not null and rn < 50 then score / greatest(nx, 1e-12) end as ratio from r), b as (select *, row_number() over (partition by query_id order by ratio desc nulls last, rn) as o, count(*) over (partition by query_id) as n from t) select query_id, case when n < 3 then n else rn end as keep from b where o = 1")
def gap_cut(spark, d):
    return select.gap_cut(_signals(spark, d))


@query(f"with {SIG}, r as (select query_id, id, coalesce(sum(score) over (partition by query_id order by score desc, id rows between unbounded preceding and 1 preceding), 0) as b, sum(score) over (partition by query_id) as t from sig) select query_id, id from r where b < 0.5 * t")
def mass_cut(spark, d):
    return select.mass_cut(_signals(spark, d), 0.5).select("query_id", "id")


@query(f"with {SYM}, r as (select file as query_id, id, row_number() over (partition by file order by id) as rank, greatest(1, length(code) // 4) as cost from symbols) select query_id, id, cast(spent as bigint) as spent from (select *, sum(cost) over (partition by query_id order by rank) as spent from r) where spent <= 8000")
def budget_prefix(spark, d):
    r = symbols(spark, d).select(F.col("file").alias("query_id"), "id", F.col("lineno").alias("rank"), text.estimate_tokens_final().alias("cost"))
    return select.budget_prefix(r, 8000).select("query_id", "id", "spent")


@query(f"with recursive {SYM}, r as (select file as query_id, id, row_number() over (partition by file order by id) as rank, greatest(1, length(code) // 4) as cost from symbols), f(query_id, rank, spent, took, id) as (select query_id, cast(0 as bigint), cast(0 as bigint), false, cast(null as bigint) from (select distinct query_id from r) union all select r.query_id, r.rank, case when f.spent + r.cost <= 8000 then f.spent + r.cost else f.spent end, f.spent + r.cost <= 8000, r.id from f join r on r.query_id = f.query_id and r.rank = f.rank + 1) select query_id, id, rank from f where took")
def budget_greedy(spark, d):
    r = symbols(spark, d).select(F.col("file").alias("query_id"), "id", F.col("lineno").alias("rank"), text.estimate_tokens_final().alias("cost"))
    return select.budget_greedy(r, 8000)


@query("select coalesce(c_custkey, s_suppkey) as id, case when c_custkey is null then 'added' when s_suppkey is null then case when c_nationkey < 3 then 'modified' else 'deleted' end else 'modified' end as status from customer full join supplier on c_custkey = s_suppkey where c_custkey is null or s_suppkey is null or c_nationkey <> s_nationkey")
def snapshot_diff(spark, d):
    """The whole of customer against the whole of supplier."""
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("code"), F.col("c_nationkey").alias("file"))
    new = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("code"))
    return diff.compare_states(old, new, table(spark, d, "nation").where("n_nationkey < 3").select(F.col("n_nationkey").alias("file")))


@query("with s as (select doc_id as id, source as file, sum(n_chars) over (partition by source order by doc_id) as e, sum(n_chars) over (partition by source order by doc_id) - n_chars as b from documents), h as (select 'src' || (event_id % 20) as file, event_id * 7 as hs, event_id * 7 + 40 as he from events) select distinct s.id from s join h on s.file = h.file and hs <= e and he >= b")
def changed_symbols_interval(spark, d):
    end = F.sum("n_chars").over(Window.partitionBy("source").orderBy("doc_id"))
    s = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("file"), end.alias("end"), (end - F.col("n_chars")).alias("start"))
    h = table(spark, d, "events").select(F.concat(F.lit("src"), (F.col("event_id") % 20).cast("string")).alias("file"), (F.col("event_id") * 7).alias("hstart"), (F.col("event_id") * 7 + 40).alias("hend"))
    return diff.touched_symbols(s, h)


@query("with cf as (select distinct l_orderkey as commit, l_partkey as id from lineitem), s as (select *, count(*) over (partition by commit) as n from cf), o as (select * from s where n >= 2), f as (select id as query, commit from (select *, row_number() over (partition by id order by commit desc) as rn from o) where rn = 1) select query, f.commit, count(*) as n_truth, cast(sum(o.id) as bigint) as sum_truth from f join o on o.commit = f.commit and o.id <> query group by 1, 2")
def cochange_cases(spark, d):
    c = commit_files(spark, d).select("commit", F.col("commit").alias("ord"), F.col("file").alias("id"))
    return diff.cochange_cases(c).select("query", "commit", F.size("truth").cast("long").alias("n_truth"), F.aggregate("truth", F.lit(0).cast("long"), lambda s, x: s + x).alias("sum_truth"))


VEC = "n as (select vec_id as id, embedding, label, sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * x))) as norm from embeddings), p as (select a.id as query_id, b.id as id, list_dot_product(cast(a.embedding as double[]), cast(b.embedding as double[])) / (a.norm * b.norm) as score from n a join n b on a.id <> b.id), ret as (select * from (select query_id, id, row_number() over (partition by query_id order by round(score, 5) desc, id) as rank from p) where rank <= 20), tr as (select a.id as query_id, b.id as id from n a join n b on a.label = b.label and a.id <> b.id), sz as (select query_id, count(*) as size from tr group by 1), gd as (select ret.query_id, ret.id, ret.rank from ret join tr using (query_id, id))"


def _dense_eval(spark, d):
    v = vectors(spark, d)
    return text.dense_topk(v, v.select(F.col("id").alias("query_id")), 20), v.select("id", "label")


@query(f"with {VEC}, m as (select sz.query_id, size, count(gd.id) as tp, count(case when gd.rank <= 10 then 1 end) as tp10 from sz left join gd using (query_id) group by 1, 2) select query_id, cast(tp > 0 as integer) as hit, round(tp / 20.0, 6) as precision, round(tp / cast(size as double), 6) as recall, round(tp10 / 10.0, 6) as p_at_10, round(case when tp > 0 then 2 * (tp / 20.0) * (tp / cast(size as double)) / (tp / 20.0 + tp / cast(size as double)) else 0 end, 6) as f1 from m")
def case_metrics(spark, d):
    m = evaluate.case_metrics(*_dense_eval(spark, d))
    return m.select("query_id", "hit", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "p_at_10", "f1")])


@query(f"with {VEC}, k as (select *, row_number() over (partition by query_id order by rank) as nth from gd), a as (select query_id, max(1.0 / rank) as mrr, sum(nth / cast(rank as double)) as s, sum(1.0 / log2(rank + 1.0)) as dcg from k group by 1), i as (select sz.query_id, sum(1.0 / log2(i + 1.0)) as ideal from sz, range(1, 21) t(i) where i <= least(size, 20) group by 1) select sz.query_id, round(coalesce(mrr, 0), 6) as mrr, round(coalesce(s, 0) / size, 6) as ap, round(coalesce(dcg, 0) / ideal, 6) as ndcg from sz join i using (query_id) left join a using (query_id)")
def ir_metrics(spark, d):
    m = evaluate.rank_metrics(*_dense_eval(spark, d))
    return m.select("query_id", *[F.round(c, 6).alias(c) for c in ("mrr", "ap", "ndcg")])


@query("select round(avg(m), 6) as mean, count(*) as groups from (select l_orderkey, avg(l_discount) as m from lineitem group by 1)")
def two_level_mean(spark, d):
    return evaluate.two_level_mean(table(spark, d, "lineitem"), "l_orderkey", "l_discount").withColumn("mean", F.round("mean", 6))


@query("with n as (select l_orderkey, count(*) as c from lineitem group by 1) select case when c <= 2 then '1-2' when c <= 5 then '3-5' else '6+' end as stratum, count(*) as n from n group by 1")
def strata(spark, d):
    n = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("c"))
    return n.groupBy(evaluate.stratum(F.col("c")).alias("stratum")).agg(F.count("*").alias("n"))


@query("with f as (select l_orderkey as q, l_partkey as id, max(case when l_returnflag = 'A' then 1 else 0 end) as a, max(case when l_returnflag = 'N' then 1 else 0 end) as n, max(case when l_returnflag = 'R' then 1 else 0 end) as r from lineitem group by 1, 2) select concat_ws('+', case when a = 1 then 'A' end, case when n = 1 then 'N' end, case when r = 1 then 'R' end) as pattern, count(*) as n from f group by 1")
def contribution_patterns(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("id"), F.col("l_returnflag").alias("signal"))
    return evaluate.contribution_patterns(li.select("query_id", "id"), li)


@query("with t as (select distinct l_orderkey as q, l_partkey as id from lineitem), a as (select distinct l_orderkey as q, l_partkey as id from lineitem where l_returnflag = 'R'), b as (select distinct l_orderkey as q, l_partkey as id from lineitem where l_linestatus = 'F') select case when a.id is not null then 'in_context' when b.id is not null then 'disclosed' else 'invisible' end as state, count(*) as n from t left join a using (q, id) left join b using (q, id) group by 1")
def honesty_audit(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("id"), "l_returnflag", "l_linestatus")
    return evaluate.disclosure(li, li.where("l_returnflag = 'R'"), li.where("l_linestatus = 'F'"))


@query("with r as (select distinct o_orderpriority as provider, o_custkey as task from orders) select task from r group by 1 having count(*) = (select count(distinct o_orderpriority) from orders)")
def relational_division(spark, d):
    r = table(spark, d, "orders").select(F.col("o_orderpriority").alias("provider"), F.col("o_custkey").alias("task"))
    return evaluate.common_tasks(r).select("task").distinct()


@query("select count(*) as n, round(corr(l_quantity, l_extendedprice), 6) as r from lineitem")
def pearson(spark, d):
    return stats.pearson(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice").withColumn("r", F.round("r", 6))


@query("with r as (select rank() over (order by o_totalprice) + (count(*) over (partition by o_totalprice) - 1) / 2.0 as a, rank() over (order by o_custkey) + (count(*) over (partition by o_custkey) - 1) / 2.0 as b from orders) select count(*) as n, round(corr(a, b), 6) as r from r")
def spearman(spark, d):
    return stats.spearman(table(spark, d, "orders"), "o_totalprice", "o_custkey").withColumn("r", F.round("r", 6))


@query("with d as (select avg(case when l_linestatus = 'F' then l_quantity end) - avg(case when l_linestatus = 'O' then l_quantity end) as d from lineitem group by l_suppkey), z as (select round(d, 6) as d, abs(round(d, 6)) as m from d where round(d, 6) <> 0), r as (select *, rank() over (order by m) + (count(*) over (partition by m) - 1) / 2.0 as r from z), t as (select sum(c * c * c - c) as t from (select count(*) as c from z group by m)), s as (select count(*) as n, sum(case when d > 0 then r else 0 end) as up, sum(case when d < 0 then r else 0 end) as dn from r) select n, cast(least(up, dn) as double) as w, round((least(up, dn) - n * (n + 1) / 4.0 + 0.5) / sqrt(n * (n + 1) * (2.0 * n + 1) / 24 - t / 48.0), 6) as z from s, t")
def wilcoxon(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.avg(F.when(F.col("l_linestatus") == "F", F.col("l_quantity"))).alias("x"), F.avg(F.when(F.col("l_linestatus") == "O", F.col("l_quantity"))).alias("y"))
    return stats.wilcoxon(li.select(F.round(F.col("x") - F.col("y"), 6).alias("a"), F.lit(0.0).alias("b"))).select("n", "w", F.round("z", 6).alias("z"))


@query("with t as (select p_partkey as name, (p_partkey % 97 + 1) / 100000.0 as p from part), r as (select *, row_number() over (order by p, name) - 1 as i, count(*) over () as m from t) select name, round(least(1.0, max((m - i) * p) over (order by p, name rows unbounded preceding)), 6) as adjusted from r")
def holm(spark, d):
    t = table(spark, d, "part").select(F.col("p_partkey").alias("name"), ((F.col("p_partkey") % 97 + 1) / 100000.0).alias("p"))
    return stats.holm(t).select("name", F.round("adjusted", 6).alias("adjusted"))


@query("with x as (select l_discount * 10 as p, case when l_returnflag = 'R' then 1.0 else 0.0 end as y from lineitem), b as (select least(floor(p * 5), 4) as b, count(*) as n, avg(p) as mp, avg(y) as my from x group by 1) select round((select sum(n * abs(mp - my)) / sum(n) from b), 6) as ece, round((select avg((p - y) * (p - y)) from x), 9) as brier")
def ece_brier(spark, d):
    x = table(spark, d, "lineitem").select((F.col("l_discount") * 10).alias("p"), F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("y"))
    return stats.ece_brier(x, "p", "y").select(F.round("ece", 6).alias("ece"), F.round("brier", 9).alias("brier"))


@query("select cast(least(floor(l_quantity * 2 / 20), 4) as integer) as bucket, count(*) as n, round(avg(l_discount), 6) as mean_recall from lineitem group by 1")
def calibration_buckets(spark, d):
    return stats.calibration_buckets(table(spark, d, "lineitem").select((F.col("l_quantity") * 2).alias("s"), "l_discount"), "s", "l_discount").withColumn("mean_recall", F.round("mean_recall", 6))


@query()
def rate_limiter_batch(spark, d):
    h = table(spark, d, "events").select(F.col("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us"), F.col("event_id").alias("seq"))
    return limiter.limit_batch(h.select("key", (F.col("us") / 1e6).alias("t"), "seq"), 3, 86400.0)


@query("select page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) as host from pages")
def url_hosts(spark, d):
    return table(spark, d, "pages").select("page_id", F.lower(F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1)).alias("host"))
