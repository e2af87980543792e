"""Every query against its SQL in another engine."""

import pytest
from oracle import differences

from quillon.plans import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert differences(QUERIES[name](spark, sf_dir), ORACLES[name], sf_dir) == []


def test_batches_equal_a_recursive_halving(spark, sf_dir):
    rows = QUERIES["batch_by_budget"](spark, sf_dir).collect()
    budget = max(r.tokens for r in rows) + 50
    by_conv: dict = {}
    for r in rows:
        by_conv.setdefault(r.conv_id, []).append(r)

    def halve(items, path=""):
        if sum(i.tokens for i in items) + 50 <= budget:
            return {(i.turn, i.role): path for i in items}
        half = -(-len(items) // 2)
        return halve(items[:half], path + "L") | halve(items[half:], path + "R")

    for items in by_conv.values():
        items.sort(key=lambda r: (r.turn, r.role))
        assert {(r.turn, r.role): r.batch for r in items} == halve(items)


def test_entry_and_optional_queries(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(QUERIES) <= set(e.queries())
