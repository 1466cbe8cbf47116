import glob
import os

import duckdb
import pytest

from tidewake.plans import catalog

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{D}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, D).toPandas(), duck.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    k = sorted(got.columns)
    rows = lambda x: x[k].astype(str).sort_values(k).to_numpy().tolist()
    assert rows(got) == rows(want)


def test_limiter_equals_loop(spark):
    from tidewake.streaming.limiter import limit_batch

    h = [(k, float(t), i) for i, (k, t) in enumerate([(1, 0), (1, 1), (1, 2), (1, 9), (1, 10), (1, 11.5), (2, 3), (1, 20)])]
    got = {r.seq: r.allowed for r in limit_batch(spark.createDataFrame(h, "key int, t double, seq long"), 2, 10.0).collect()}
    log, want = {}, {}
    for k, t, i in h:
        live = [x for x in log.get(k, []) if t - x < 10]
        want[i] = len(live) < 2
        log[k] = [*live, t] if want[i] else live
    assert got == want
