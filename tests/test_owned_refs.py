"""References that name their method are packed without a join."""

from quillon.operators import slicing


def test_references_with_a_method_need_no_join(spark):
    unit = spark.createDataFrame([(1, 10, 0, "assign"), (1, 11, 1, "invoke")], "method_id long, unit_id long, ordinal int, kind string")
    ref = spark.createDataFrame([(1, 10, "def", 0, "r1", True, None), (1, 11, "use", 0, "r1", True, None)], "method_id long, unit_id long, role string, ordinal int, value string, is_local boolean, base string")
    flow = spark.createDataFrame([(1, 10, 11, 0)], "method_id long, src long, dst long, ordinal int")
    packed = slicing.packed_methods(unit, ref, flow)
    assert packed._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2
    target = spark.createDataFrame([(1, 11)], "method_id long, target long")
    got = [slicing.sliced(p, target).select("relations", "slice", "graph", "error").first() for p in (packed, slicing.packed_methods(unit, ref.drop("method_id"), flow))]
    assert got[0] == got[1] and got[0].slice == [10, 11] and got[0].error is None
