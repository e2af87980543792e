import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import graph as G
from quillon.operators import slicing
from quillon.operators.components import components
from quillon.operators.evaluation import confusion, merged_labels, require_complete
from quillon.operators.ordering import batched_by_budget, first_wins, ordered_distinct


def pairs(df):
    return {tuple(r) for r in df.collect()}


def edges_of(spark, *e):
    return spark.createDataFrame(list(e), "src long, dst long")


def test_components_of_random_graphs(spark):
    rng = random.Random(3)
    e = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    label = {n: n for p in e for n in p}
    changed = True
    while changed:
        changed = False
        for a, b in e:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    assert pairs(components(edges_of(spark, *e))) == set(label.items())
    assert pairs(components(edges_of(spark, *[(k, k + 1) for k in range(200)]))) == {(k, 0) for k in range(201)}


def test_components_without_edges(spark):
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0
    assert G.is_connected(spark.createDataFrame([], "src long, dst long")).first().connected


def test_khop_expands_once_more_than_k(spark):
    chain = edges_of(spark, (1, 2), (2, 3), (3, 4), (4, 5))
    start = spark.createDataFrame([(1,)], "node long")
    assert pairs(G.khop(chain, start, 1).select("node")) == {(1,), (2,), (3,)}
    assert pairs(G.reached(chain, spark.createDataFrame([(5,)], "node long"), backward=True)) == {(5, 0), (4, 1), (3, 2), (2, 3), (1, 4)}
    assert pairs(G.induced(chain, spark.createDataFrame([(1,), (2,), (4,)], "node long"))) == {(1, 2)}


def test_bridges_skip_what_is_not_kept(spark):
    e = edges_of(spark, (1, 2), (2, 3), (3, 2), (2, 4), (4, 5), (1, 5))
    assert pairs(G.bridged(e, spark.createDataFrame([(1,), (4,), (5,)], "node long"))) == {(1, 4), (4, 5), (1, 5)}


def nodes_of(spark, *ids, control=()):
    return spark.createDataFrame([(k, f"n{k}", k in control) for k in ids], "node long, text string, control boolean")


def test_contraction_of_a_diamond(spark):
    merged, between = G.contracted(nodes_of(spark, 1, 2, 3, 4, 5, 6), edges_of(spark, (1, 2), (2, 3), (2, 4), (3, 5), (4, 5), (5, 6)))
    assert pairs(merged.select("head", "text")) == {(1, "n1\nn2"), (3, "n3"), (4, "n4"), (5, "n5\nn6")}
    assert pairs(between) == {(1, 3), (1, 4), (3, 5), (4, 5)}


def test_contraction_stops_at_control_and_cuts_whole_cycles(spark):
    merged, _ = G.contracted(nodes_of(spark, 1, 2, 3, control=(2,)), edges_of(spark, (1, 2), (2, 3)))
    assert pairs(merged.select("head", "text")) == {(1, "n1\nn2"), (3, "n3")}
    merged, between = G.contracted(nodes_of(spark, 7, 8, 9), edges_of(spark, (8, 9), (9, 7), (7, 8)))
    assert pairs(merged.select("head", "text")) == {(7, "n7\nn8\nn9")}
    assert pairs(between) == {(7, 7)}
    assert G.is_control(F.lit("a")) is not None


def test_isolated_nodes(spark):
    one = spark.createDataFrame([(1,)], "node long")
    none = spark.createDataFrame([], "src long, dst long")
    assert G.connected_to_edges(one, none).count() == 1
    assert pairs(G.connected_to_edges(spark.createDataFrame([(1,), (2,), (3,)], "node long"), edges_of(spark, (1, 2)))) == {(1,), (2,)}


def test_pruning_keeps_calls_of_the_searched_one(spark):
    third, searched = spark.createDataFrame([(2,)], "node long"), spark.createDataFrame([(3,)], "node long")
    assert pairs(G.pruned(edges_of(spark, (1, 2), (2, 3), (2, 4)), third, searched)) == {(1, 2), (2, 3)}
    assert G.pruned(edges_of(spark, (1, 2)), third, searched).count() == 0


def test_first_wins_and_ordered_distinct(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, "z"), ("a", 1, "y")], "k string, o int, v string")
    assert pairs(first_wins(df, ["k"], ["o"])) == {("a", 1, "y"), ("b", 5, "z")}
    assert [r.k for r in ordered_distinct(df, "k", ["o"], 1).collect()] == ["a"]
    with pytest.raises(ValueError):
        ordered_distinct(df, "k", ["o"], 0)


def test_a_single_large_item_is_an_error(spark):
    with pytest.raises(ValueError, match="one item"):
        batched_by_budget(spark.createDataFrame([(1, 1, 9)], "g int, o int, s int"), ["g"], ["o"], "s", 5)


def test_confusion_without_rows_and_with_missing(spark):
    empty = spark.createDataFrame([], "sha256 string, label int")
    r = confusion(empty, spark.createDataFrame([], "sha256 string, prediction int"), "sha256").first()
    assert (r.total_expected, r.f1, r.fpr) == (0, 0.0, 0.0)
    split = spark.createDataFrame([("a", 1), ("b", 0)], "sha256 string, label int")
    report = confusion(split, spark.createDataFrame([("a", 1), ("c", 1)], "sha256 string, prediction int"), "sha256")
    assert (report.first().missing, report.first().precision) == (1, 1.0)
    with pytest.raises(Exception, match="without a prediction: 1"):
        require_complete(report).collect()
    assert merged_labels(split, spark.createDataFrame([("a", 0)], "sha256 string, label int")).where("conflict").count() == 1


def program(spark, units, refs, cfg):
    unit = spark.createDataFrame([(1, u, k, kind, inv) for k, (u, kind, inv) in enumerate(units)], "method_id long, unit_id long, ordinal int, kind string, invoked string")
    ref = spark.createDataFrame([(u, role, k, v, local, base) for k, (u, role, v, local, base) in enumerate(refs)], "unit_id long, role string, ordinal int, value string, is_local boolean, base string")
    flow = spark.createDataFrame([(1, a, b, k) for k, (a, b) in enumerate(cfg)], "method_id long, src long, dst long, ordinal int")
    return unit, ref, flow


def test_slice_of_a_straight_line(spark):
    # 1: r1 := @parameter0   2: r2 = r1 + i3   3: if r9   4: r5 = 0   5: call(r2, i4)
    unit, ref, flow = program(
        spark,
        [(1, "identity", None), (2, "assign", None), (3, "if", None), (4, "assign", None), (5, "invoke", "<A: f()>")],
        [
            (1, "def", "r1", True, None), (1, "use", "@parameter0: int", False, None), (2, "def", "r2", True, None), (2, "use", "r1", True, None), (2, "use", "i3", True, None),
            (3, "use", "r9", True, None), (4, "def", "r5", True, None), (5, "use", "r2", True, None), (5, "use", "i4", True, None), (5, "arg", "r2", True, None), (5, "arg", "i4", True, None),
        ],
        [(1, 2), (2, 3), (3, 4), (4, 5)],
    )
    got = slicing.sliced(slicing.packed_methods(unit, ref, flow), slicing.callsites(unit, spark.createDataFrame([("<A: f()>",)], "signature string"))).first()
    relations = {(r.kind, tuple(r.variables)) for r in got.relations}
    assert relations == {("Direct", ("r2",)), ("Direct", ("i4",)), ("Parallel", ("i4", "r2")), ("Conditional", ("r9",)), ("Transitive", ("r1",)), ("Transitive", ("i3",)), ("Derived", ("r2", "r1")), ("Derived", ("r2", "i3")), ("Parallel", ("i3", "r1"))}
    assert set(got.slice) == {1, 2, 3, 5}
    assert got.open  # i3, i4 and r9 are live at the head


def test_containment_and_length_bounds():
    m = slicing.Method([{"unit_id": 1, "ordinal": 0, "kind": "assign"}], [{"unit_id": 1, "role": "def", "ordinal": 0, "value": "r10", "is_local": True, "base": None}], [])
    assert m.touches(1, {"r1"})  # by containment
    assert slicing.is_eligible("$r10") and not slicing.is_eligible("$r100") and slicing.is_eligible("parameter12") and not slicing.is_eligible("r1x")


def test_backward_walk_through_callers(spark):
    """f calls the searched method; g calls f; h calls g: one hop reaches g, two reach h."""
    unit = spark.createDataFrame([(1, 11, 0, "invoke", "<A: s()>"), (2, 21, 0, "invoke", "<A: f()>"), (3, 31, 0, "invoke", "<A: g()>")], "method_id long, unit_id long, ordinal int, kind string, invoked string")
    ref = spark.createDataFrame([], "unit_id long, role string, ordinal int, value string, is_local boolean, base string")
    flow = spark.createDataFrame([], "method_id long, src long, dst long, ordinal int")
    method = spark.createDataFrame([(1, "<A: f()>", 0, True), (2, "<A: g()>", 0, True), (3, "<A: h()>", 0, True)], "method_id long, signature string, n_params int, has_body boolean")
    calls = spark.createDataFrame([(2, 1), (3, 2)], "src long, dst long")
    roots = spark.createDataFrame([(0, 1, "<A: s()>")], "instance int, method_id long, signature string")
    packed = slicing.packed_methods(unit, ref, flow)
    for hops, reached in ((0, {1}), (1, {1, 2}), (2, {1, 2, 3})):
        slices, edges = slicing.backward(packed, unit, method, calls, roots, hops)
        assert {r.method_id for r in slices.collect()} == reached
    assert pairs(edges.select("src", "dst")) == {("A: g", "A: f"), ("A: h", "A: g")}


def test_rounds_that_run_out_are_an_error(spark):
    chain = edges_of(spark, *[(k, k + 1) for k in range(9)])
    start = spark.createDataFrame([(0,)], "node long")
    with pytest.raises(RuntimeError, match="within 3 rounds"):
        G.reached(chain, start, rounds=3)
    with pytest.raises(RuntimeError, match="within 3 rounds"):
        G.bridged(chain, spark.createDataFrame([(0,), (9,)], "node long"), rounds=3)
    assert pairs(G.reached(chain, start, hops=3)) == {(k, k) for k in range(4)}
