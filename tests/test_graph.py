import pytest

from tidewake.operators import closure, scoring, select


@pytest.fixture(scope="module")
def frame(spark):
    return lambda rows, cols: spark.createDataFrame(rows, cols)


def ids(df):
    return {r.id for r in df.select("id").collect()}


def test_closures(frame):
    chain = frame([("a", "b"), ("b", "c")], "src string, dst string")
    assert ids(closure.blast_radius(chain, frame([(1, "c")], "query_id int, id string"))) == {"a", "b"}
    cycle = frame([("a", "b"), ("b", "a")], "src string, dst string")
    assert "b" in ids(closure.blast_radius(cycle, frame([(1, "a")], "query_id int, id string")))
    fan = frame([("a", "b"), ("a", "c"), ("b", "d")], "src string, dst string")
    seed = frame([(1, "a")], "query_id int, id string")
    assert ids(closure.expand_dependencies(fan, seed)) == {"a", "b", "c", "d"}
    assert ids(closure.expand_dependencies(fan, seed, 1)) == {"a", "b", "c"}
    assert ids(closure.blast_radius(fan, seed)) == set()


def test_components(frame):
    e = frame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7)], "src long, dst long")
    got = {r.id: r.label for r in closure.min_label_components(e).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and got[101] == 100


def test_scores(frame):
    e = frame([("a", "b")], "src string, dst string")
    s = lambda x: {r.id: r.score for r in scoring.impact_scores(e, frame([(1, x)], "query_id int, id string")).collect()}
    assert s("a") == {"a": 101.0, "b": 93.0}
    assert s("b") == {"a": 86.0, "b": 103.0}
    assert scoring.reach_of(90, 0.65) == 6 and scoring.reach_of(85, 0.85) == 8


@pytest.mark.parametrize(("scores", "keep"), [([100, 90, 10, 8], 2), ([100, 40, 4, 0.1], 3), ([50], 1), ([50, 1], 2), ([100, 10, 1], 1)])
def test_gap_cut(frame, scores, keep):
    df = frame([(1, i, float(x)) for i, x in enumerate(scores)], "query_id int, id int, score double")
    assert select.gap_cut(df).first().keep == keep


def test_selection_keeps_changed_and_budget(frame):
    c = frame([(1, f"s{i}", 100.0 - i, 10 + i) for i in range(10)], "query_id int, id string, score double, cost long")
    changed = frame([(1, "s9")], "query_id int, id string")
    got = {r.id: r.role for r in select.select_context(c, changed, 60, top_k=3).collect()}
    assert got == {"s9": "changed", "s0": "related", "s1": "related", "s2": "related"} | {f"s{i}": "dropped" for i in range(3, 9)}
    assert {r.id: r.role for r in select.select_context(c, changed, 45).collect()} == {"s9": "changed", "s0": "related", "s1": "related"} | {f"s{i}": "dropped" for i in range(2, 9)}
