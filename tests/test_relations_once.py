"""What relations are read from is evaluated once."""

from pyspark.sql import functions as F

from quillon.functions import relations as R


def test_answers_are_parsed_once(spark):
    rows = spark.createDataFrame([('[{"type":"Parallel","variables":["r2","r1"]},{"type":"Direct","variable":"r1"}]',), (None,)], "t string")
    read = rows.select(R.model_set_strict(F.from_json("t", f"array<{R.MODEL_ITEM}>")).alias("s"))
    assert {None if r.s is None else tuple((x.kind, *x.variables) for x in r.s) for r in read.collect()} == {None, (("Direct", "r1"), ("Parallel", "r1", "r2"))}
    assert read._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
