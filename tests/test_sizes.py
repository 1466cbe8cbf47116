"""Results that larger or odder tables showed to be wrong or out of reach."""

import duckdb
import pytest

from tidewake.plans import catalog, checks, lookup  # noqa: F401


@pytest.fixture
def tables(spark, tmp_path):
    """Write tables(name=(rows, schema)); the folder."""

    def write(**given):
        for name, (rows, schema) in given.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def sql(name, d, *names):
    c = duckdb.connect()
    for t in names:
        c.execute(f"create view {t} as select * from '{d}/{t}.parquet/*.parquet'")
    return c.execute(catalog.ORACLES[name]).fetchall()


def same(got, want):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


def test_order_with_a_customers_number_is_no_edge_of_theirs(spark, tables):
    d = tables(customer=([(1,), (2,), (3,), (3,), (None,)], "c_custkey long"), orders=([(1, 2), (3, 2), (9, None)], "o_orderkey long, o_custkey long"))
    got = lookup.isolated_nodes(spark, d).collect()
    same(got, sql("isolated_nodes", d, "customer", "orders"))
    assert {r.id for r in got} == {1, 3, None}


def test_relations_are_counted_without_pairs(spark, tables):
    odd = [(1, i, t, b) for i, (t, b) in enumerate([("a/x", "p"), ("a/x", "p"), ("a/x", "q"), ("b", "p"), (None, "p"), ("b", None), ("a/x", "p")])]
    d = tables(part=([*odd, (1, 0, "a/x", "p"), (2, 9, "a/x", "p"), (2, None, "a/x", "p"), (None, 8, "b", "p"), (None, 7, "b", "p")], "p_size int, p_partkey long, p_type string, p_brand string"))
    same(lookup.relation_classes(spark, d).collect(), sql("relation_classes", d, "part"))
    n = 200_000  # two thousand million pairs of each of ten sizes
    spark.range(n).selectExpr("cast(id % 10 as int) as p_size", "id as p_partkey", "'t' as p_type", "cast(id % 3 as string) as p_brand").write.mode("overwrite").parquet(f"{d}/part.parquet")
    got = {r.relation: r.n for r in lookup.relation_classes(spark, d).collect()}
    assert sum(got.values()) == 10 * (n // 10) * (n // 10 - 1) // 2
    assert "Join" not in spark._jvm.PythonSQLUtils.explainString(lookup.relation_classes(spark, d)._jdf.queryExecution(), "simple").replace("NestedLoopJoin", "")


def test_random_baseline_ranks_what_all_draws_rank(spark, monkeypatch):
    from tidewake.operators import search

    ids, q = spark.range(3000).select("id"), spark.range(5).selectExpr("id as query_id")
    want = {tuple(r) for r in duckdb.sql("select q, i, row_number() over (partition by q order by sha256('42:' || q || ':' || i), i) as rank from range(5) a(q), range(3000) b(i) where q <> i qualify rank <= 20").fetchall()}
    monkeypatch.setattr(search, "cut", kept := Kept(search.cut))
    assert {tuple(r) for r in search.random_baseline(ids, q, 20).collect()} == want
    assert max(kept.counts) < 5 * 400  # not every draw is ranked
    # without slack under the bound queries are ranked again with all draws
    monkeypatch.setattr(search, "format", lambda x, f: "00000001", raising=False)
    assert {tuple(r) for r in search.random_baseline(ids, q, 20).collect()} == want


class Kept:
    """Counts the rows of what is written on the way."""

    def __init__(self, cut):
        self.cut, self.counts = cut, []

    def __call__(self, df):
        self.counts.append((df := self.cut(df)).count())
        return df


def test_control_by_key_is_that_of_its_pairs(spark):
    from pyspark.sql import functions as F

    from tidewake.operators import verify

    rows = lambda n, k, m: spark.createDataFrame([(i % k, (i * 7) % m) for i in range(n)], "query_id long, id long")
    got, truth, cases = rows(60, 5, 23), rows(20, 5, 23), spark.createDataFrame([(i, i * 2) for i in range(5)], "query_id long, pos long")
    changes = spark.createDataFrame([(i, i * 5 % 31) for i in range(40)], "pos long, id long")
    ids, key = spark.range(20).union(spark.range(3)), lambda c: c % 3
    pairs = cases.crossJoin(ids).where("id % 3 = query_id % 3")
    a, b = (verify.future_validity(got, truth, cases, changes, c, 9).collect() for c in (pairs, (cases, ids, key)))
    assert a == b


def test_pairs_of_several_keys_come_once(spark):
    from tidewake.operators import edges

    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x"), (2, "x"), (3, None), (4, "y"), (7, "z")], "src long, key string")
    b = spark.createDataFrame([(1, "x"), (5, "x"), (5, "y"), (6, "y"), (8, None), (9, "w")], "dst long, key string")
    got = [tuple(r) for r in edges.keyed_pairs(a, b).collect()]
    assert sorted(got) == [(1, 5), (1, 6), (2, 1), (2, 5), (4, 5), (4, 6)]


def test_truth_by_label_is_that_of_its_pairs(spark):
    from tidewake.operators import evaluate

    v = spark.createDataFrame([(i, i * i % 5) for i in range(30)] + [(30, None), (31, 9)], "id long, label long")
    r = spark.createDataFrame([(q, (q * 3 + i * 7) % 33, i + 1) for q in range(32) for i in range(6)], "query_id long, id long, rank int")
    pairs = v.selectExpr("id as query_id", "label").join(v, "label").where("id <> query_id").select("query_id", "id")
    for f in (evaluate.case_metrics, evaluate.rank_metrics):
        same(f(r, v).collect(), f(r, pairs).collect())
    two = v.unionByName(spark.createDataFrame([(3, 1)], "id long, label long"))  # an id of two labels
    pairs = two.selectExpr("id as query_id", "label").join(two, "label").where("id <> query_id").select("query_id", "id")
    same(evaluate.case_metrics(r, two).collect(), evaluate.case_metrics(r, pairs).collect())


def test_dense_search_holds_a_tile_of_scores(spark, monkeypatch):
    import numpy as np

    from tidewake.operators import text

    rng = np.random.default_rng(3)
    m = rng.integers(-3, 4, (90, 4)).astype(float)  # many ties
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "id long, embedding array<double>").repartition(3)
    q = v.selectExpr("id as query_id")
    want = sorted(text.dense_topk(v, q, 5).select("query_id", "id", "rank").collect())
    monkeypatch.setattr(text, "QUERY_TILE", 7)
    assert sorted(text.dense_topk(v, q, 5).select("query_id", "id", "rank").collect()) == want
    n = np.linalg.norm(m, axis=1, keepdims=True)
    u = np.divide(m, n, out=np.zeros_like(m), where=n > 0)
    s = np.floor(u @ u.T * 1e5 + 0.5) / 1e5
    assert want == sorted((i, j, k + 1) for i in range(90) for k, j in enumerate(sorted((j for j in range(90) if j != i), key=lambda j: (-s[i, j], j))[:5]))


def test_pair_counts_by_arrays(spark):
    from tidewake.operators import history

    rows = [(c, (c * 5 + i * i) % 11) for c in range(40) for i in range(1 + c % 6)] + [(100, i) for i in range(30)] + [(1, 5), (1, 5), (3, None), (4, None)]
    c = spark.createDataFrame(rows, "commit long, file long")
    want = {}
    for k in {r[0] for r in rows}:
        files = {f for x, f in rows if x == k}
        if 2 <= len(files) <= 25:
            for a in files - {None}:
                for b in files - {None, a}:
                    want[a, b] = want.get((a, b), 0) + 1
    assert {(r.a, r.b): r.n for r in history.pair_counts(c).collect()} == want
    only = spark.createDataFrame([(1,), (5,), (5,)], "file long")
    assert {(r.a, r.b): r.n for r in history.pair_counts(c, least=2, only=only).collect()} == {k: n for k, n in want.items() if k[0] in (1, 5) and n >= 2}
    changed = spark.createDataFrame([(0, 1), (0, 5), (1, 7)], "query_id long, file long")
    same(history.scores_for_files(c, changed, some=True).collect(), history.scores_for_files(c, changed).collect())
    few = spark.conf.get("spark.sql.shuffle.partitions")
    assert history.file_counts(c, 10 * 250_000).rdd.getNumPartitions() > int(few)


def test_hybrid_by_files_is_that_of_its_pairs(spark, monkeypatch):
    from tidewake.operators import blend

    monkeypatch.setattr(blend, "BLOCK", 3)
    g = spark.createDataFrame([(q, q * 3 + i * 2, float(i + q)) for q in range(6) for i in range(5)], "query_id long, id long, score double")
    x = spark.createDataFrame([(q, q * 2 + i, float(i)) for q in range(1, 8) for i in range(4)], "query_id long, id long, score double")
    h = spark.createDataFrame([(2, 30, 0.5), (3, 4, 0.25)], "query_id long, id long, score double")
    ch = spark.createDataFrame([(q, q * 3) for q in range(5)], "query_id long, id long")
    q, ids = [(i, f"f{i % 3}") for i in range(9)] + [(20, None)], [(i, f"f{i % 4}") for i in range(40)] + [(50, None)]
    for more_q, more_ids in (([], []), ([(1, "f0"), (2, "f2")], [(5, "f2"), (7, "f3"), (None, "f1")])):  # also of several files, and twice
        qs, ms = spark.createDataFrame(q + more_q, "query_id long, file string"), spark.createDataFrame(ids + more_ids, "id long, file string")
        pairs = qs.join(ms, "file").select("query_id", "id")
        for past, changed in ((None, None), (h, ch)):
            a, b = (sorted((r.query_id, -1 if r.id is None else r.id, round(r.score, 9)) for r in blend.hybrid(g, x, f, None, past, changed).collect()) for f in ((qs, ms), pairs))
            assert a == b


def test_keys_are_compared_in_parts_by_rows(spark, monkeypatch):
    from tidewake.operators import evaluate, verify

    r, t, o = [(1, 1), (1, 2), (1, 2), (2, None), (None, 5), (3, 7)], [(1, 2), (1, 3), (2, None), (None, 5), (4, 1)], [(1, 3), (4, 1), (2, None)]
    c = duckdb.connect()
    for name, rows in (("r", r), ("t", t), ("o", o)):
        c.execute(f"create table {name} as select distinct * from (values {', '.join(str(x) for x in rows)}) v(q, id)".replace("None", "null"))
    df = lambda rows: spark.createDataFrame(rows, "query_id long, id long")
    parts = []
    for m in (evaluate, verify):
        keep = m.spread
        monkeypatch.setattr(m, "spread", lambda d, n, *k, keep=keep: parts.append(n) or keep(d, n, *k, each=1))
    want = c.execute("with j as (select coalesce(r.q, t.q) as q, r.q is not null or r.id is not null as a, t.q is not null or t.id is not null as b from r full join t on r.q = t.q and r.id = t.id) select q, count_if(a and b), count_if(not b), count_if(not a) from j group by 1").fetchall()
    same(verify.confusion(df(r), df(t)).collect(), want)
    want = c.execute("select case when r.id is not null then 'in_context' when o.id is not null then 'disclosed' else 'invisible' end, count(*) from t left join r using (q, id) left join o using (q, id) group by 1").fetchall()
    same(evaluate.disclosure(df(t), df(r), df(o)).collect(), want)
    assert parts == [len(r) + len(t), len(r) + len(t) + len(o)]


def test_sibling_bonus_is_that_of_its_pairs(spark, monkeypatch):
    import math

    from tidewake.operators import scoring

    e = {(f"p{i % 13}", f"s{(i * i + i // 7) % 11}") for i in range(90)} | {("hub", f"s{i}") for i in range(11)} | {("one", "s1"), ("p1", None), (None, "s2"), (None, "s3")}
    ch = [(q, f"s{q}") for q in range(6)] + [(1, "s7"), (1, "s7"), (None, "s4"), (8, "absent")]
    edges, changed = spark.createDataFrame([*e, *e], "src string, dst string"), spark.createDataFrame(ch, "query_id long, id string")
    want = {}
    for q, o in set(ch):
        for caller in {a for a, b in e if b == o and a}:
            callees = [b for a, b in e if a == caller]
            for x in callees if len(callees) > 1 else []:
                if x and x != o and (q is None or (q, x) not in ch):
                    want[q, x] = want.get((q, x), 0) + math.log2(1 + 60 / len(callees))
    want = {k: round(min(v, 80.0), 6) for k, v in want.items()}
    assert {(r.query_id, r.id): round(r.bonus, 6) for r in scoring.sibling_bonus(edges, changed).collect()} == want
    plan = spark._jvm.PythonSQLUtils.explainString(scoring.sibling_bonus(edges, changed)._jdf.queryExecution(), "simple")
    made = plan.index("Generate explode(nrs")
    assert "Exchange hashpartitioning" not in plan[:made]  # pairs are summed where they are made
    monkeypatch.setattr(scoring, "LIST", 2)
    monkeypatch.setattr(scoring, "TASK_PAIRS", 5)  # queries of more than 20 pairs are summed in several tasks
    monkeypatch.setattr(scoring, "BROADCAST_ROWS", 3)
    assert {(r.query_id, r.id): round(r.bonus, 6) for r in scoring.sibling_bonus(edges, changed).collect()} == want


def test_components_draw_edges_anew(spark, monkeypatch):
    import random

    from tidewake.operators import closure

    rng = random.Random(5)
    e = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i * 7 % 30) for i in range(30)] + [(200, 200), (None, 3)] + [(300 + i, 400) for i in range(50)]
    parent = {x: x for p in e for x in p if None not in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in e:
        if a is not None and a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    df = spark.createDataFrame([*e, *e], "src long, dst long")
    monkeypatch.setattr(closure, "cut", kept := Kept(closure.cut))
    got = {r.id: r.label for r in closure.min_label_components(df).collect()}
    assert got == {x: root(x) for x in parent if any(x in p and p[0] != p[1] and None not in p for p in e)}
    assert kept.counts.count(len({tuple(sorted(p)) for p in e if None not in p and p[0] != p[1]})) == 1  # all edges once
    assert closure.min_label_components(df.limit(0)).count() == 0


def test_reach_follows_an_edge_once_for_many_queries(spark):
    from tidewake.operators import closure

    e = spark.createDataFrame([(i, (i * 3 + j) % 97) for i in range(97) for j in (1, 2)], "src long, dst long").distinct()
    s = spark.createDataFrame([(q, q * 5 % 97) for q in range(130)] + [(3, 50), (3, 50)], "query_id long, id long")
    for depth in (0, 2, 3):
        same(closure.reach(e, s, depth).collect(), closure.min_hops(e, s, depth).select("query_id", "id").collect())


def test_bm25_adds_up_scores_where_texts_are(spark, monkeypatch):
    import math
    import re
    from collections import Counter

    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from tidewake.operators import text

    words = ["Ab", "ab_1", "x", "9zz", "the", "THE", "Kelvin", "q2-q3", "_u", "rare", "café"]
    docs = [(i, " ".join(words[(i * j + j * j) % 11] for j in range(i % 9))) for i in range(70)] + [(70, None), (3, "rare ab"), (3, "the"), (None, "the rare"), (None, "ab")]
    asked = [(q, " ".join(words[(q + j) % 11] for j in range(1 + q))) for q in range(6)] + [(None, "the ab the"), (9, "absent"), (9, "")]
    find = lambda t: [x.lower() for x in re.findall("[a-zA-Z_][a-zA-Z0-9_]*", t or "") if len(x) > 1]
    tf = {i: Counter(x for j, t in docs if i == j for x in find(t)) for i, _ in docs}
    df, n = Counter(x for c in tf.values() for x in c), len(docs)
    raw = {x: math.log(n - d + 0.5) - math.log(d + 0.5) for x, d in df.items()}
    mean = sum(raw.values()) / len(raw) * 0.25
    idf = {x: (mean if mean > 0 else 0.25) if r < 0 else r for x, r in raw.items()}
    avg = sum(c.total() for i, c in tf.items() if i is not None) / n
    want = {}
    for q in {q for q, _ in asked}:
        for i, c in tf.items():
            s = sum(m * idf[x] * c[x] * 2.5 / (c[x] + 1.5 * (0.25 + 0.75 * c.total() / avg)) for x, m in Counter(x for p, t in asked if p == q for x in find(t)).items() if c[x])
            if s > 0 and i is not None:
                want[q, i] = round(s, 9)
    s, q = spark.createDataFrame(docs, "id long, code string").repartition(3), spark.createDataFrame(asked, "query_id long, text string")
    got = lambda k=None: {(r.query_id, r.id): round(r.score, 9) for r in text.bm25(s, q, k).collect()}
    assert got() == want
    for name, most in (("TERMS", 2), ("ASKED_ROWS", 3), ("SCORE_PARTS", 5)):
        monkeypatch.setattr(text, name, most)
    assert got() == want
    few = got(2)
    assert few.items() <= want.items()
    rounded = {k: round(v, 6) for k, v in want.items()}
    best = {q: sorted((v for (p, _), v in rounded.items() if p == q), reverse=True)[:2] for q, _ in want}
    assert all(k in few for k, v in rounded.items() if v >= best[k[0]][-1])
    assert text.bm25(s, q.limit(0), 2).count() == text.bm25(s.limit(0), q).count() == 0
    one = spark.range(50).select("id", F.concat(F.lit("the rare "), F.col("id").cast("string")).alias("code"), F.row_number().over(Window.orderBy("id")).alias("lineno"))
    plan = spark._jvm.PythonSQLUtils.explainString(text.bm25(one, q, 2)._jdf.queryExecution(), "simple")
    assert "Exchange" not in plan and "Window" not in plan  # neither texts nor terms are shuffled for the scores


def test_sufficiency_is_marked_by_id(spark, tables, monkeypatch):
    from tidewake.operators import verify

    li = [(1 + (i * 7) % 6, (i * i) % 13, float(10 + i % 41)) for i in range(120)] + [(None, 3, 60.0), (9, 4, 70.0), (2, None, 80.0)]
    d = tables(
        lineitem=(li, "l_suppkey long, l_partkey long, l_quantity double"), customer=([(i, i % 4) for i in range(30)] + [(40, None)], "c_custkey long, c_nationkey int"),
        supplier=([(i, float(i % 3 - 1)) for i in (0, 1, 2, 3, 4, 5, 6, 8)], "s_suppkey long, s_acctbal double"), part=([(i, 30 + i) for i in range(13)], "p_partkey long, p_size int"),
    )
    parts, keep = [], verify.spread
    monkeypatch.setattr(verify, "spread", lambda df, n, *k: parts.append((n, k)) or keep(df, n, *k, each=20))
    for name in ("sufficiency_score", "sufficiency_findings"):
        f = getattr(checks, name)(spark, d)
        want = sql(name, d, "lineitem", "customer", "supplier", "part")
        c = duckdb.connect()
        for t in ("lineitem", "customer", "supplier", "part"):
            c.execute(f"create view {t} as select * from '{d}/{t}.parquet/*.parquet'")
        names = [x[0] for x in c.execute(catalog.ORACLES[name]).description]
        same(f.select(*names).collect(), want)
    assert {k for _, k in parts} == {("id",), ("of",), ("query_id",)} and len({n for n, _ in parts}) == 1  # split by rows
    # several changed ids, one of them reached twice, repeated rows and a query without a number
    df = lambda rows, kind: spark.createDataFrame(rows, kind)
    e = df([("a", "x"), ("a", "x"), ("b", "x"), ("b", "a"), ("y", "b"), ("a", None), ("z", "z")], "src string, dst string")
    ids, ch = df([("x",), ("x",), ("a",), ("y",)], "id string"), df([(1, "a"), (1, "b"), (1, "b"), (2, "z"), (None, "a"), (3, None)], "query_id long, id string")
    scores, sel = df([(1, "x", 60.0), (1, "y", 20.0), (2, "y", 50.0), (2, "a", 90.0), (None, "x", 99.0)], "query_id long, id string, score double"), df([(1, "x"), (2, "a"), (2, "a")], "query_id long, id string")
    got = {r.query_id: (r.direct_closure, r.high_score_retention, r.local_graph_confidence, r.n_missing_direct, r.n_dropped_high, r.n_local_edges) for r in verify.sufficiency(e, ids, scores, ch, sel).collect()}
    none = (1.0, 1.0, 1.0, 0, 0, 0)
    assert got == {1: (0.5, 1.0, 0.75, 1, 0, 4), 2: (1.0, 0.5, 0.0, 0, 1, 1), 3: none, None: none}


def test_cochange_scores_are_made_apart_from_counts(spark, monkeypatch):
    from tidewake.operators import history

    rows = [(c, (c * 5 + i * i) % 11) for c in range(60) for i in range(1 + c % 6)] + [(1, 5), (3, None), (None, 4)]
    ch = [(q, (q * 3 + j) % 12) for q in range(5) for j in range(3)] + [(2, 6), (2, None), (None, 3), (7, 99)]
    c, changed = spark.createDataFrame(rows, "commit long, file long"), spark.createDataFrame(ch, "query_id long, file long")
    ab = {(r.a, r.b): r.n for r in history.pair_counts(c, least=2).collect()}
    total = {f: len({str(k) for k, x in rows if x == f}) for _, f in rows}
    want = {}
    for q, f in ch:
        for (a, b), n in ab.items():
            if a == f and (q is None or (q, b) not in ch):
                want[q, b] = max(want.get((q, b), 0), n / total[a])
    parts, keep = [], history.spread
    monkeypatch.setattr(history, "spread", lambda df, n, *k: parts.append((n, k)) or keep(df, n, *k, each=7))
    got = history.scores_for_files(c, changed)
    assert {(r.query_id, r.file): r.score for r in got.collect()} == want
    assert parts[-4][0] == parts[-3][0] == history.association(c).count() + len(ch)  # joined in parts by their rows
    plan = spark._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "simple")
    assert "collect_list" not in plan  # no task counts pairs and joins them
