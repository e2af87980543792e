"""The program is laid out once: rounds of the walk shuffle their frontier and no program table."""

from test_slicing import frames, program

from quillon.operators import slicing


def test_rounds_do_not_shuffle_the_program(spark):
    t = frames(spark, program(spark))
    before = {x.name for x in spark.catalog.listTables()}
    stored = slicing.stored_program(slicing.packed_methods(t["unit"], t["ref"], t["cfg"]), t["unit"], t["method"], t["calls"])
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frontier = spark.createDataFrame([(1, "<os.Sms: void send(int)>"), (2, "<os.Sms: void send(int)>"), (4, "<os.Sms: void send(int)>")], "method_id long, searched string")
        sites = slicing.call_sites(stored, frontier)
        plan = sites._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "units" not in plan
        assert {(r.method_id, r.target, r.at) for r in sites.collect()} == {(1, 14, 4), (2, 21, 1), (2, 22, 2)}
        up = frontier.join(stored.callers, "method_id")
        assert up._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        assert [(r.method_id, r.caller) for r in up.collect()] == [(1, 3)]
        sliced = slicing.sliced(stored.methods.select("method_id", "units", "refs", "cfg"), sites.select("method_id", "target"))
        assert sliced._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        stored.gone()
    assert {x.name for x in spark.catalog.listTables()} == before
