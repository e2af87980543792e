"""Recorded answers meet their rows by fingerprint alone."""

from pyspark.sql import functions as F

from quillon.operators.verdict import Recorded, Settings, answered, prompt_key


def test_prompts_are_neither_grouped_nor_joined(spark):
    asked = spark.createDataFrame([(1, "a"), (2, "b" * 40), (3, None), (4, "c"), (5, "d"), (6, "a")], "id long, prompt string")
    answers = spark.createDataFrame([("a", "yes"), ("b" * 40, "no"), ("d", "")], "p string, answer string").select(prompt_key(F.col("p")).alias("fingerprint"), "answer")
    got = answered(asked, "prompt", "said", Recorded(answers), Settings(budget=5))
    rows = {r.id: (r.said, r.said_error, r.said_usage and tuple(r.said_usage)) for r in got.collect()}
    assert rows == {1: ("yes", None, (1, 1)), 2: (None, "prompt exceeds the budget", None), 3: (None, None, None), 4: (None, "no recorded answer", None), 5: (None, "empty answer", None), 6: ("yes", None, (1, 1))}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("Aggregate") == 1
