import os
from collections import Counter

import pyarrow.parquet as pq
import pytest

from tidewake.plans import catalog

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


def test_components_over_all_foreign_keys(spark):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for name, a, p, b, q in (("lineitem", "l_partkey", "p", "l_suppkey", "s"), ("supplier", "s_suppkey", "s", "s_nationkey", "n"), ("customer", "c_custkey", "c", "c_nationkey", "n"), ("nation", "n_nationkey", "n", "n_regionkey", "r")):
        t = pq.read_table(f"{D}/{name}.parquet", columns=[a, b]).to_pydict()
        for x, y in zip(t[a], t[b], strict=True):
            parent[root(f"{p}:{x}")] = root(f"{q}:{y}")
    sizes = Counter(root(x) for x in list(parent))
    least = {r: min(x for x in parent if root(x) == r) for r in sizes}
    got = {r.component: r.n for r in catalog.QUERIES["weak_components"](spark, D).collect()}
    assert got == {least[r]: n for r, n in sizes.items()}
    assert any(x[0] == "p" for x in parent)


def test_snapshots_hold_every_key(spark):
    ids = lambda name, c: set(pq.read_table(f"{D}/{name}.parquet", columns=[c]).column(c).to_pylist())
    got = {r.id for r in catalog.QUERIES["snapshot_diff"](spark, D).collect()}
    assert got >= ids("customer", "c_custkey") ^ ids("supplier", "s_suppkey")
