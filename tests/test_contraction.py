"""Components by contraction: what the rounds write in all, odd shapes, and many graphs at once."""

import random

import duckdb

from quillon.operators import components as C
from quillon.operators import graph as G
from quillon.plans import ORACLES
from quillon.plans.graphs import connectivity


def test_all_rounds_together_cost_a_multiple_of_the_first(spark, monkeypatch):
    rows = []

    def counted(df, stored=C.stored):
        out = stored(df)
        rows.append(out[0].count())
        return out

    monkeypatch.setattr(C, "stored", counted)
    n = 20_000
    found = C.components(spark.range(n).selectExpr("id AS src", "id + 1 AS dst"))
    assert found.agg({"component": "max"}).first()[0] == 0 and found.count() == n + 1
    assert sum(rows) < 6 * n


def test_shapes_against_a_walk(spark):
    rng = random.Random(3)
    edges = [(0, k) for k in range(1, 400)] + [(1000 + k, 1000 + (k * 7) % 50) for k in range(50)] + [(rng.randrange(2000, 3000), rng.randrange(2000, 3000)) for _ in range(700)]
    edges += [(4000, 4000), (4001, 4001), (4001, 4002), (4002, 4001), (None, 5), (5, None)]
    least = {}
    for _ in range(60):
        for a, b in edges:
            if a is not None and b is not None:
                least[a] = least[b] = min(least.get(a, a), least.get(b, b))
    found = C.components(spark.createDataFrame(edges, "src long, dst long"))
    assert sorted(map(tuple, found.collect())) == sorted(least.items())


def test_graphs_at_once(spark):
    edges = spark.createDataFrame([("a", 1, 2), ("a", 2, 3), ("b", 1, 2), ("b", 3, 4), ("c", 9, 9)], "graph string, src long, dst long")
    assert set(map(tuple, G.connected_graphs(edges, "graph").collect())) == {("a", True), ("b", False), ("c", True)}


def test_connectivity_of_no_customers_is_that_of_the_sql(spark, tmp_path):
    spark.createDataFrame([], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    sql = duckdb.connect()
    sql.execute("CREATE TABLE customer (c_custkey BIGINT)")
    assert list(map(tuple, connectivity(spark, str(tmp_path)).collect())) == sql.execute(ORACLES["connectivity"]).fetchall() == []
