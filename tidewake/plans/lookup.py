"""Queries over ids, files, URLs and baselines, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewake.operators import blend, closure, edges, evaluate, history, scoring, search, select, text
from tidewake.plans.catalog import BM25, CF, FK, IDF, SIG, SYM, TOK, _signals, commit_files, fk_edges, items, query, regions, symbols, table

ITEMS = "symbols as (select item_id as id, text as code from benchmark)"


@query("""
select doc_id, split_part(id, ':', 1) as file, substr(id, instr(id, ':') + 1) as name, list_extract(string_split(substr(id, instr(id, ':') + 1), '.'), -1) as bare
from (select doc_id, source || ':' || lang || '.' || doc_id as id from documents)""")
def id_split(spark, d):
    s = table(spark, d, "documents").select("doc_id", F.concat("source", F.lit(":"), "lang", F.lit("."), F.col("doc_id").cast("string")).alias("id"))
    return s.select("doc_id", search.symbol_file("id").alias("file"), search.symbol_name("id").alias("name"), search.bare_name(search.symbol_name("id")).alias("bare"))


PATH = "pathed as (select page_id, case page_id % 6 when 0 then 'tests/' when 1 then 'src/test_' when 2 then 'a/b.spec.' when 3 then 'x/latest/' when 4 then 'mod.test.' else 'lib/' end || regexp_extract(url, '//(.*)', 1) as path from pages)"


def _paths(spark, d):
    head = F.element_at(F.array(*map(F.lit, ("tests/", "src/test_", "a/b.spec.", "x/latest/", "mod.test.", "lib/"))), (F.col("page_id") % 6 + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", F.concat(head, F.regexp_extract("url", "//(.*)", 1)).alias("path"))


@query(f"with {PATH} select page_id from pathed where not regexp_matches(path, '(^|/)tests?(/|_|$)|(^|/)test_|\\.test\\.|\\.spec\\.')")
def test_file_filter(spark, d):
    return _paths(spark, d).where(~search.is_test_file("path")).select("page_id")


@query("""
with p as (select doc_id, './' || case when doc_id % 3 = 0 then 'django/contrib/' when doc_id % 3 = 1 then 'django/' else '' end || source || '/' || lang as path from documents),
s as (select doc_id, string_split(substr(path, 3), '/') as p from p)
select doc_id, case when len(p) >= 3 and p[1] = 'django' and p[2] = 'contrib' then p[2] || '/' || p[3] when len(p) >= 2 and p[1] = 'django' then p[2] else p[1] end as subsystem from s""")
def subsystem(spark, d):
    head = F.when(F.col("doc_id") % 3 == 0, "./django/contrib/").when(F.col("doc_id") % 3 == 1, "./django/").otherwise("./")
    p = table(spark, d, "documents").select("doc_id", F.concat(head, "source", F.lit("/"), "lang").alias("path"))
    return p.select("doc_id", search.subsystem("path").alias("subsystem"))


@query("""
with h as (select page_id, case page_id % 8 when 0 then 'http://10.1.2.3/x' when 1 then 'ssh://git@host.org/r' when 2 then 'https://user:pw@host.org/r' when 3 then 'HTTPS://LocalHost:80/r' when 4 then 'git@github.com:a/b.git' when 5 then 'http://172.20.0.1/a' else url end as url from pages),
n as (select page_id, lower(trim(url)) as u from h),
m as (select page_id, u, nullif(case when regexp_extract(u, '^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1) <> '' then regexp_extract(u, '^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1) else regexp_extract(u, '^[^/@:\\s]+@([^/:\\s]+):', 1) end, '') as host from n)
select page_id, host, case when not regexp_matches(u, '^https?://') then 'scheme' when host is null then 'host' when regexp_matches(u, '^https?://[^/?#]*@') then 'credentials'
  when regexp_matches(host, '^(localhost|127\\..*|10\\..*|192\\.168\\..*|172\\.(1[6-9]|2[0-9]|3[01])\\..*)$') then 'private' end as problem from m""")
def clone_urls(spark, d):
    other = F.element_at(F.array(*map(F.lit, ("http://10.1.2.3/x", "ssh://git@host.org/r", "https://user:pw@host.org/r", "HTTPS://LocalHost:80/r", "git@github.com:a/b.git", "http://172.20.0.1/a"))), (F.least(F.col("page_id") % 8, F.lit(5)) + 1).cast("int"))
    u = table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 8 < 6, other).otherwise(F.col("url")).alias("url"))
    return u.select("page_id", search.hostname("url").alias("host"), search.clone_url_problem("url").alias("problem"))


@query("select p_partkey as id, case when p_size = 1 then 'changed' when p_retailprice % 100 >= 70 then 'impacted' else 'dependency' end as role from part")
def roles(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), search.role(F.col("p_retailprice") % 100, F.col("p_size") == 1).alias("role"))


@query("""
with m as (select p_brand || '/' || p_type as base, case when p_size <= 10 then '__m' || p_size || '__' else 'm' || p_size end as method, p_partkey as id from part),
k as (select * from m where not starts_with(method, '__')), ok as (select base, method from k group by 1, 2 having count(*) between 2 and 6)
select a.id as src, b.id as dst from k a join k b using (base, method) join ok using (base, method) where a.id <> b.id""")
def dispatch_without_dunders(spark, d):
    method = F.when(F.col("p_size") <= 10, F.concat(F.lit("__m"), "p_size", F.lit("__"))).otherwise(F.concat(F.lit("m"), "p_size"))
    return edges.sibling_override_edges(table(spark, d, "part").select(F.concat_ws("/", "p_brand", "p_type").alias("base"), method.alias("method"), F.col("p_partkey").alias("id")))


@query("""
with m as (select p_partkey as id, p_brand as cls, p_size as method from part), par as (select distinct p_brand as child, 'Brand#' || ((cast(substr(p_brand, 7) as int) + 1) % 25) as parent from part)
select distinct a.id as src, b.id as dst from m a join par on par.child = a.cls join m b on b.cls = par.parent and b.method = a.method where a.id <> b.id""")
def override_edges(spark, d):
    p = table(spark, d, "part")
    m = p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("cls"), F.col("p_size").alias("method"))
    up = F.concat(F.lit("Brand#"), ((F.substring("p_brand", 7, 9).cast("int") + 1) % 25).cast("string"))
    return edges.override_edges(m, p.select(F.col("p_brand").alias("child"), up.alias("parent")).distinct())


@query("""
with c as (select l_orderkey as src, l_suppkey as dst, l_linenumber as ord, l_partkey as p from lineitem),
r as (select src, dst, row_number() over (partition by src order by ord, p, dst) as rn from c)
select distinct src, dst from r where rn <= 3 and src <> dst""")
def decorator_edges(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("dst"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("ord"))
    return edges.decorator_edges(li, 3)


@query("""
with s as (select s_suppkey as id, s_nationkey as name from supplier), c as (select c_custkey as src, c_nationkey as name from customer)
select distinct c.src, s.id as dst from c join s using (name) where c.src <> s.id""")
def call_edges_by_name(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("name"))
    return edges.call_edges(s, table(spark, d, "customer").select(F.col("c_custkey").alias("src"), F.col("c_nationkey").alias("name")))


@query("""
with p as (select l_suppkey as a, l_partkey % 97 as b from lineitem) select a as src, b as dst from p where a <> b union select b, a from p where a <> b""")
def connect_pair(spark, d):
    return edges.connect_pairs(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 97).alias("dst")))


@query("select source as file, doc_id as id, row_number() over (partition by source order by doc_id) as lineno, count(*) over (partition by source) as n from documents")
def file_groups(spark, d):
    from pyspark.sql import Window

    return symbols(spark, d).select("file", "id", "lineno", F.count("*").over(Window.partitionBy("file")).alias("n"))


@query("select c_custkey as id from customer anti join orders on o_custkey = c_custkey")
def isolated_nodes(spark, d):
    """Ids of orders and customers are told apart: an order that has a customer's number is no edge of theirs."""
    node = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.col(c).alias("key"))
    e = table(spark, d, "orders").select(node("order", "o_orderkey").alias("src"), node("customer", "o_custkey").alias("dst"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    linked = edges.degrees(e, c.select(node("customer", "id").alias("id"))).where("indeg + outdeg > 0").select(F.col("id.key").alias("id"))
    return c.join(linked, "id", "left_anti")


@query(f"with {FK}, e as (select distinct src, dst from edges), i as (select dst, src from e) select dst as file, count(*) as n, min(src) as first from i group by 1")
def blast_by_file(spark, d):
    return evaluate.by_file(fk_edges(spark, d).distinct().select(F.col("dst").alias("file"), F.col("src").alias("id")))


@query(f"""
with recursive {FK}, b(query_id, id, hops) as (
  select s_suppkey, 's:' || s_suppkey, 0 from supplier
  union select b.query_id, e.dst, hops + 1 from b join edges e on e.src = b.id)
select query_id, id from b group by 1, 2""")
def reach_full(spark, d):
    seeds = table(spark, d, "supplier").select(F.col("s_suppkey").alias("query_id"), F.concat(F.lit("s:"), F.col("s_suppkey").cast("string")).alias("id"))
    return closure.expand_dependencies(fk_edges(spark, d), seeds).select("query_id", "id")


CYCLE = "edges as (select distinct p_size as src, cast((p_size * 7 + p_partkey % 2) % 50 + 1 as int) as dst from part)"


def cyclic_edges(spark, d):
    """Sizes of parts as nodes, two edges of each: a graph with cycles and loops."""
    p = table(spark, d, "part")
    return p.select(F.col("p_size").alias("src"), ((F.col("p_size") * 7 + F.col("p_partkey") % 2) % 50 + 1).cast("int").alias("dst")).distinct()


def _sizes(spark, d):
    return table(spark, d, "part").select(F.col("p_size").alias("id")).distinct().select(F.col("id").alias("query_id"), "id")


FORWARD = """
b(query_id, id, hops) as (
  select distinct p_size, p_size, 0 from part
  union select b.query_id, e.dst, hops + 1 from b join edges e on e.src = b.id where hops < 6),
m as (select query_id, id, min(hops) as hops from b group by 1, 2)"""


@query(f"with recursive {CYCLE}, {FORWARD} select query_id, id, round(90.0 * power(0.65, hops - 1), 6) as score from m where hops > 0")
def score_forward(spark, d):
    return scoring.forward_scores(cyclic_edges(spark, d), _sizes(spark, d)).withColumn("score", F.round("score", 6))


@query(f"""
with recursive {CYCLE}, {FORWARD},
k(query_id, id, hops) as (
  select distinct p_size, p_size, 0 from part
  union select k.query_id, e.src, hops + 1 from k join edges e on e.dst = k.id where hops < 60),
bk as (select query_id, id, min(hops) as hops from k group by 1, 2),
seeds as (select query_id, id from bk), one as (select distinct s.query_id, e.dst as id from seeds s join edges e on e.src = s.id),
two as (select distinct s.query_id, e.dst as id from one s join edges e on e.src = s.id), floors as (select * from seeds union select * from one union select * from two),
base as (select query_id, id, max(score) as score from (
  select query_id, id, case when hops = 0 then 100.0 else 90.0 * power(0.65, hops - 1) end as score from m
  union all select query_id, id, 85.0 * power(0.85, hops - 1) from bk where hops between 1 and 8) group by 1, 2),
od as (select src, count(*) as k from edges group by 1 having count(*) > 1),
sib as (
  select c.query_id, x.dst as id, least(sum(log2(1 + 60.0 / k)), 80.0) as bonus
  from (select distinct p_size as query_id from part) c join edges e on e.dst = c.query_id join od on od.src = e.src join edges x on x.src = e.src
  where x.dst <> c.query_id group by 1, 2),
scored as (select coalesce(base.query_id, sib.query_id) as query_id, coalesce(base.id, sib.id) as id, coalesce(score, 0) + coalesce(bonus, 0) as score from base full join sib on sib.query_id = base.query_id and sib.id = base.id),
al as (select coalesce(s.query_id, f.query_id) as query_id, coalesce(s.id, f.id) as id, coalesce(s.score, 30.0) as score from scored s full join floors f on f.query_id = s.query_id and f.id = s.id),
i as (select dst as id, count(*) as c from edges group by 1), o as (select src as id, count(*) as c from edges group by 1)
select al.query_id, al.id, round(score + least(15.0, 3 * log2(1.0 + coalesce(i.c, 0)) + log2(1.0 + coalesce(o.c, 0))), 6) as score
from al left join i on i.id = al.id left join o on o.id = al.id""")
def impact_scores_cyclic(spark, d):
    """Forward and backward scores, siblings and floors on a graph with cycles, each node as a query."""
    return scoring.impact_scores(cyclic_edges(spark, d), _sizes(spark, d)).withColumn("score", F.round("score", 6))


@query(f"with {FK}, e as (select distinct src, dst from edges), i as (select dst as id, count(*) as c from e group by 1), o as (select src as id, count(*) as c from e group by 1), n as (select id from i union select id from o) select id, round(least(15.0, 3 * log2(1.0 + coalesce(i.c, 0)) + log2(1.0 + coalesce(o.c, 0))), 6) as structure from n left join i using (id) left join o using (id)")
def struct_bonus(spark, d):
    e = fk_edges(spark, d).distinct()
    nodes = e.select(F.col("src").alias("id")).union(e.select("dst"))
    return scoring.structural_bonus(e, nodes).withColumn("structure", F.round("structure", 6))


@query(f"""
with recursive {CYCLE}, u as (select src, dst from edges where src <> dst union select dst, src from edges where src <> dst),
b(query_id, id, hops) as (select distinct p_size, p_size, 0 from part union select b.query_id, u.dst, hops + 1 from b join u on u.src = b.id where hops < 2)
select query_id, cast(count(distinct id) - 1 as bigint) as near from b group by 1""")
def two_hop_check(spark, d):
    return closure.within_undirected(cyclic_edges(spark, d), _sizes(spark, d), 2).groupBy("query_id").agg((F.count("*") - 1).alias("near"))


@query("""
with p as (select a.p_partkey as q, b.p_partkey as t, a.p_brand as qf, b.p_brand as tf, a.p_type as qc, b.p_type as tc from part a join part b on a.p_size = b.p_size and a.p_partkey < b.p_partkey)
select case when qf = tf and qc = tc then 'same_file_same_class' when qf = tf then 'same_file_diff_class_or_free'
  when regexp_replace(qf, '/?[^/]*$', '') = regexp_replace(tf, '/?[^/]*$', '') then 'same_package' else 'cross_package' end as relation, count(*) as n
from (select q, t, qc || '/' || qf as qf, tc || '/' || tf as tf, qc, tc from p) group by 1""")
def relation_classes(spark, d):
    from tidewake.operators import verify

    p = table(spark, d, "part").select(F.col("p_size").alias("key"), F.col("p_partkey").alias("id"), F.concat("p_type", F.lit("/"), "p_brand").alias("file"), F.col("p_type").alias("class"))
    return verify.relation_counts(p)


@query("""
with w as (select doc_id, lower(t) as t from (select doc_id, unnest(regexp_extract_all(text, '[a-zA-Z_][a-zA-Z0-9_]*')) as t from documents) where length(t) > 1)
select t as term, count(*) as n, count(distinct doc_id) as docs from w group by 1""")
def tokenize_counts(spark, d):
    w = table(spark, d, "documents").select("doc_id", F.explode(text.tokens("text")).alias("term"))
    return w.groupBy("term").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query(f"""
with {ITEMS}, {TOK}, n as (select count(*) as n from symbols), df as (select term, count(*) as df from post group by 1),
w as (select id, term, (1 + ln(tf)) * (ln((n + 1) / cast(df + 1 as double)) + 1) as w from post join df using (term), n),
u as (select id, term, w / sqrt(sum(w * w) over (partition by id)) as w from w),
s as (select a.id as query_id, b.id, round(sum(a.w * b.w), 6) as score from u a join u b using (term) where a.id <> b.id group by 1, 2)
select query_id, id, score, rank from (select *, row_number() over (partition by query_id order by score desc, id) as rank from s where score > 0) where rank <= 10""")
def tfidf_cosine_topk(spark, d):
    s = items(spark, d).select(F.col("query_id").alias("id"), F.col("text").alias("code"))
    scores = text.tfidf_cosine(s, s.select(F.col("id").alias("query_id"))).withColumn("score", F.round("score", 6))
    return text.top_k(scores, 10).select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"""
with {ITEMS}, {TOK}, {IDF},
s as (select a.id as query_id, b.id, sum(a.tf * idf * b.tf * 2.5 / (b.tf + 1.5 * (0.25 + 0.75 * len / (select avg(len) from lens)))) as score
      from post a join post b using (term) join idf using (term) join lens on lens.id = b.id where a.id <> b.id group by 1, 2)
select query_id, id, rank from (select *, row_number() over (partition by query_id order by round(score, 6) desc, id) as rank from s where score > 0) where rank <= 10""")
def bm25_baseline(spark, d):
    s = items(spark, d).select(F.col("query_id").alias("id"), F.col("text").alias("code"))
    return search.bm25_baseline(s, s.select(F.col("id").alias("query_id")), 10).select("query_id", "id", F.col("rank").cast("long").alias("rank"))


@query("""
with ch as (select lang, min(doc_id) as id from documents group by 1), f as (select distinct ch.lang as query_id, source from ch join documents on doc_id = id and documents.lang = ch.lang)
select query_id, doc_id as id from documents join f using (source) where (query_id, doc_id) not in (select (lang, id) from ch)""")
def same_file_signal(spark, d):
    s = symbols(spark, d)
    return search.same_file(s, s.groupBy(F.col("directory").alias("query_id")).agg(F.min("id").alias("id")))


@query(f"""
with {CF}, ch as (select p_size as query_id, p_partkey as file from part),
f as (select query_id, b as file, max(pairs.n / cast(tot.n as double)) as score from ch join pairs on a = ch.file join tot on tot.file = a where pairs.n >= 2 group by 1, 2),
g as (select f.* from f left join ch using (query_id, file) where ch.file is null)
select query_id, id, round(score, 6) as score from g join (select distinct l_partkey as file, l_suppkey || '@' || l_partkey as id from lineitem) using (file)""")
def cochange_symbol_scores(spark, d):
    changed = table(spark, d, "part").select(F.col("p_size").alias("query_id"), F.col("p_partkey").alias("file"))
    f = history.scores_for_files(commit_files(spark, d), changed)
    s = table(spark, d, "lineitem").select(F.concat_ws("@", "l_suppkey", "l_partkey").alias("id"), F.col("l_partkey").alias("file")).distinct()
    return search.scores_for_symbols(s, f).withColumn("score", F.round("score", 6))


@query("""
with cf as (select distinct l_orderkey as commit, l_partkey as file from lineitem), ok as (select * from cf where commit in (select commit from cf group by 1 having count(*) between 2 and 4)),
tot as (select file, count(*) as n from cf group by 1)
select a.file as a, b.file as b, count(*) as n, round(count(*) / cast(any_value(tot.n) as double), 6) as assoc from ok a join ok b on a.commit = b.commit and a.file <> b.file join tot on tot.file = a.file group by 1, 2""")
def cochange_cap(spark, d):
    """Sweeping commits, here of more than four files, make no pairs but count for their files."""
    c = commit_files(spark, d)
    n = history.pair_counts(c, 4)
    return n.join(history.association(c, 4, 1), ["a", "b"]).select("a", "b", "n", F.round("assoc", 6).alias("assoc"))


@query("""
with r as (select item_id as query_id, p_partkey as id, row_number() over (partition by item_id order by sha256('42:' || item_id || ':' || p_partkey), p_partkey) as rank from benchmark, part where item_id <> p_partkey)
select query_id, id, rank from r where rank <= 20""")
def random_baseline(spark, d):
    ids = table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    return search.random_baseline(ids, items(spark, d), 20).select("query_id", "id", F.col("rank").cast("long").alias("rank"))


@query("""
with n as (select distinct lower(t) as name from (select unnest(regexp_extract_all(text, '[a-zA-Z_][a-zA-Z0-9_]*')) as t from benchmark) where length(t) >= 9), q as (select name as query_id, name from n),
s as (select item_id, text from benchmark)
select query_id, item_id as id, row_number() over (partition by query_id order by item_id) as rank from q join s on contains(text, name || ' ')""")
def grep_baseline(spark, d):
    b = items(spark, d)
    names = b.select(F.explode(text.tokens("text")).alias("name")).where(F.length("name") >= 9).distinct().select(F.col("name").alias("query_id"), "name")
    s = b.select(F.col("query_id").cast("string").alias("id"), F.lit("f").alias("file"), F.col("query_id").alias("lineno"), F.col("text").alias("code"))
    return search.grep_baseline(s, names, " ").select("query_id", F.col("id").cast("long").alias("id"), F.col("rank").cast("long").alias("rank"))


@query(f"""
with names as (select p_partkey as pk, regexp_replace(p_name, ' ', '_') || ':' || p_type as id from part),
words as (select id, list_filter(string_split_regex(lower(regexp_replace(id, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda x: length(x) > 0) as ws from (select distinct id from names)),
symbols as (select id, array_to_string(ws, ' ') as code from words), {TOK}, {IDF},
q as (select 1 as query_id, 'smallRing ECONOMY' as t union all select 2, 'ZZ' union all select 3, 'idget:'),
qq as (select query_id, lower(x) as term, count(*) as qf from (select query_id, unnest(regexp_extract_all(lower(regexp_replace(t, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[a-zA-Z_][a-zA-Z0-9_]*')) as x from q) where length(x) > 1 group by 1, 2),
bm as (select query_id, post.id, round(sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / (select avg(len) from lens)))), 6) as score from post join qq using (term) join idf using (term) join lens on lens.id = post.id group by 1, 2),
hit as (select * from bm where score > 0 union all select query_id, id, 0.0 from q, symbols where query_id not in (select query_id from bm where score > 0) and contains(lower(id), lower(trim(t))))
select query_id, id, score, rank from (select *, row_number() over (partition by query_id order by score desc, id) as rank from hit) where rank <= 10""")
def service_search(spark, d):
    p = table(spark, d, "part")
    s = p.select(F.concat(F.regexp_replace("p_name", " ", "_"), F.lit(":"), "p_type").alias("id")).distinct()
    q = spark.createDataFrame([(1, "smallRing ECONOMY"), (2, "ZZ"), (3, "idget:")], "query_id int, text string")
    return search.service_search(s, q, 10).select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


@query("select distinct o_custkey as id from orders anti join (select c_custkey from customer where c_acctbal >= 0) on c_custkey = o_custkey anti join supplier on s_suppkey = o_custkey")
def unknown_symbols(spark, d):
    asked = table(spark, d, "orders").select(F.col("o_custkey").alias("id")).distinct()
    return search.unknown_symbols(asked, table(spark, d, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("id")), table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")))


@query("select a.o_orderkey as src, b.o_orderkey as dst from (select o_orderkey, o_custkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as pos from orders) a join (select o_orderkey, o_custkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as pos from orders) b on a.o_custkey = b.o_custkey and b.pos between a.pos + 1 and a.pos + 3")
def next_commits(spark, d):
    """A customer's next three orders after each: a window of row offsets."""
    return history.following(table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderdate").alias("t"), F.col("o_orderkey").alias("id")), 3)


@query(f"with {SIG}, r as (select query_id, id, row_number() over (partition by query_id order by score desc, id) as rank from sig union all select query_id, id, row_number() over (partition by query_id order by n desc, id) from sig) select query_id, id, min(rank) as rank from r group by 1, 2")
def oracle_union(spark, d):
    s = _signals(spark, d)
    ranks = blend.ranked(s.select("query_id", "id", "score")).select("query_id", "id", "rank").unionByName(blend.ranked(s.select("query_id", "id", F.col("n").alias("score"))).select("query_id", "id", "rank"))
    return blend.best_of(ranks).withColumn("rank", F.col("rank").cast("long"))


@query("with s as (select l_orderkey % 50 as query_id, l_orderkey as seed, l_partkey as id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as rank from lineitem) select query_id, id, round(max(1.0 / rank), 6) as score from s group by 1, 2")
def seed_merge(spark, d):
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    s = table(spark, d, "lineitem").select((F.col("l_orderkey") % 50).alias("query_id"), F.col("l_orderkey").alias("seed"), F.col("l_partkey").alias("id"), rank.alias("rank"))
    return blend.merge_seeds(s).withColumn("score", F.round("score", 6))


@query(f"""
with {SIG}, g as (select query_id, id, case when min(score) over w = max(score) over w then 0.5 else (score - min(score) over w) / nullif(max(score) over w - min(score) over w, 0) end as s from sig window w as (partition by query_id)),
l as (select query_id, id, case when min(n) over w = max(n) over w then 0.5 else (n - min(n) over w) / cast(nullif(max(n) over w - min(n) over w, 0) as double) end as s from sig window w as (partition by query_id)),
v as (select * from (values ('graph+bm25', 0.6, 0.4), ('graph+file', 0.7, 0.0), ('graph+bm25+file', 0.5, 0.35)) t(variant, wg, wb))
select variant, query_id, id, round(wg * g.s + wb * l.s, 9) as score from g join l using (query_id, id), v""")
def blend_variants(spark, d):
    s = _signals(spark, d)
    signals = {"graph": blend.normalise(s.select("query_id", "id", "score")), "bm25": blend.normalise(s.select("query_id", "id", F.col("n").cast("double").alias("score")))}
    return blend.variants(signals, {"graph+bm25": {"graph": 0.6, "bm25": 0.4}, "graph+file": {"graph": 0.7, "file": 0.3}, "graph+bm25+file": {"graph": 0.5, "bm25": 0.35, "file": 0.15}}).withColumn("score", F.round("score", 9))


@query("""
with t as (select unnest(range(0, 21)) as t), g as (select a.t as a, b.t as b, c.t as c, 20 - a.t - b.t - c.t as e from t a, t b, t c where a.t + b.t + c.t <= 20)
select round(a * 0.05, 2) as graph, round(b * 0.05, 2) as bm25, round(c * 0.05, 2) as samefile, round(e * 0.05, 2) as dense from g""")
def weight_grid(spark, d):
    return blend.simplex_grid(spark, ["graph", "bm25", "samefile", "dense"], 20).select(*[F.round(c, 2).alias(c) for c in ("graph", "bm25", "samefile", "dense")])


@query(f"""
with {SIG}, c as (select query_id, least(1.0, count(*) / 100.0) as r from sig group by 1)
select query_id, round(0.3 * r, 6) as graph, round(0.5 * (0.7 + 0.3 * (1 - r)) / 0.7, 6) as bm25, round(0.2 * (0.7 + 0.3 * (1 - r)) / 0.7, 6) as samefile from c""")
def adaptive_redistribution(spark, d):
    n = _signals(spark, d).groupBy("query_id").agg(F.count("*").alias("n"))
    w = blend.redistribute(n, {"graph": 0.3, "bm25": 0.5, "samefile": 0.2}, 100)
    return w.select("query_id", *[F.round(c, 6).alias(c) for c in ("graph", "bm25", "samefile")])


@query(f"""
with {SIG}, r as (select query_id, id, score, row_number() over (partition by query_id order by score desc, id) as rank, max(score) over (partition by query_id) as peak,
  coalesce(sum(score) over (partition by query_id order by score desc, id rows between unbounded preceding and 1 preceding), 0) / sum(score) over (partition by query_id) as mass, lead(score) over (partition by query_id order by score desc, id) as nx from sig),
k as (select query_id, arg_max(rank, case when nx is not null and rank < 50 then score / nx end) as keep from (select * from r order by rank) group by 1),
p as (select 'topk_' || k as policy, query_id, id, rank from r, (values (10), (20), (30), (50)) t(k) where rank <= k
  union all select 'rel_' || a, query_id, id, rank from r, (values (0.05), (0.1), (0.2), (0.3), (0.5)) t(a) where score >= a * peak
  union all select 'gap50', r.query_id, id, rank from r join (select query_id, min(rank) as keep from (select query_id, rank, rank() over (partition by query_id order by score / nx desc) as o from r where nx is not null and rank < 50) where o = 1 group by 1) g using (query_id) where rank <= keep
  union all select 'mass_' || b, query_id, id, rank from r, (values (0.5), (0.7), (0.9)) t(b) where mass < b)
select case when policy like 'rel%' then regexp_replace(policy, '([0-9])0$', '\\1') else policy end as policy, count(*) as n, cast(sum(rank) as bigint) as ranks from p group by 1""".replace("k as (select query_id, arg_max(rank, case when nx is not null and rank < 50 then score / nx end) as keep from (select * from r order by rank) group by 1),\n", ""))
def cutoff_policies(spark, d):
    p = select.cutoff_policies(_signals(spark, d).select("query_id", "id", "score"))
    return p.groupBy("policy").agg(F.count("*").alias("n"), F.sum("rank").alias("ranks"))


@query(f"with {SIG}, r as (select query_id, id, row_number() over (partition by query_id order by score desc, id) as rank from sig) select query_id, id, rank from r where rank <= 400")
def top_items(spark, d):
    return text.top_k(_signals(spark, d).select("query_id", "id", "score"), 400).select("query_id", "id", F.col("rank").cast("long").alias("rank"))


SELECT = f"""
{SIG}, ch as (select query_id, min(id) as id from sig group by 1),
c as (select query_id, id, case when n > 1 then score else 0 end as score, id % 40 + 1 as cost, (query_id, id) in (select (query_id, id) from ch) as forced from sig)"""


def _candidates(spark, d):
    s = _signals(spark, d).select("query_id", "id", F.when(F.col("n") > 1, F.col("score")).otherwise(0.0).alias("score"), (F.col("id") % 40 + 1).alias("cost"))
    return s, s.groupBy("query_id").agg(F.min("id").alias("id"))


@query(f"""
with recursive {SELECT}, o as (select *, row_number() over (partition by query_id order by forced desc, score desc, id) as rn from c),
f(query_id, rn, id, spent, k, role) as (
  select query_id, rn, id, cast(cost as bigint), 0, 'changed' from o where rn = 1
  union all select o.query_id, o.rn, o.id, case when k < 12 and o.cost <= 37 and spent + o.cost <= 150 then spent + o.cost else spent end,
    case when k < 12 and o.cost <= 37 and spent + o.cost <= 150 then k + 1 else k end, case when k < 12 and o.cost <= 37 and spent + o.cost <= 150 then 'related' else 'dropped' end
  from f join o on o.query_id = f.query_id and o.rn = f.rn + 1)
select query_id, id, role from f""")
def select_context(spark, d):
    return select.select_context(*_candidates(spark, d), 150, 12)


@query(f"""
with {SELECT}, r as (select *, row_number() over (partition by query_id order by score desc, id) as rn, lead(score) over (partition by query_id order by score desc, id) as nx, count(*) over (partition by query_id) as n from c where not forced and score > 0),
g as (select query_id, rn as keep from (select query_id, rn, row_number() over (partition by query_id order by score / nx desc, rn) as o from r where nx is not null and rn < 50) where o = 1),
k as (select r.query_id, id from r left join g using (query_id) where rn <= case when n < 3 then n else keep end)
select query_id, id, case when forced then 'changed' when (query_id, id) in (select (query_id, id) from k) then 'related' else 'dropped' end as role from c""")
def select_context_gap(spark, d):
    return select.select_context(*_candidates(spark, d), None, None, True)


@query(f"with {SELECT}, r as (select query_id, id, row_number() over (partition by query_id order by score desc, id) as rank from c where not forced) select query_id, id, 'related' as role from r where rank <= 5 union all select query_id, id, 'changed' from ch")
def topk_cut(spark, d):
    return select.select_context(*_candidates(spark, d), None, 5).where("role <> 'dropped'")


@query(f"""
with {SELECT}, s as (select query_id, id, score from c where score > 0), extra as (select query_id, id from ch union all select query_id, query_id from ch),
o as (select query_id, id, 0 as o, score from s union all select distinct query_id, id, 1, 0 from extra e where (query_id, id) not in (select (query_id, id) from s))
select query_id, id, row_number() over (partition by query_id order by o, score desc, id) as pos from o""")
def all_relevant(spark, d):
    c, changed = _candidates(spark, d)
    return select.all_relevant(c.where("score > 0").select("query_id", "id", "score"), changed.unionByName(changed.select("query_id", F.col("query_id").alias("id"))))


@query("""
with r as (select o_custkey as key, o_orderkey as id, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from orders) select key, id from r where rn <= 5""")
def cache_retention(spark, d):
    return select.newest(table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at")), 5)


@query(f"""
with {SELECT}, o as (select query_id, id, cost, score, sum(cost) over (partition by query_id order by forced, score, id desc) as upto, sum(cost) over (partition by query_id) as total, forced from c)
select query_id, id from o where not (not forced and upto - cost < total - 100)""")
def render_trim(spark, d):
    """What is left when the lowest scores go until the rest fits."""
    c, changed = _candidates(spark, d)
    return select.trim(c, changed, 100)
