"""Prompts reach a model in Arrow batches, of which a few are answered at a time."""

import sys

from pyspark import cloudpickle

from quillon.operators import verdict

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the model runs in tasks


class Echo:
    def complete(self, prompt, json_mode):
        return prompt[:3]


def test_answers_go_back_a_few_at_a_time(spark):
    prompts = spark.createDataFrame([(k, f"{k:03d} asks") for k in range(300)], "id long, prompt string").coalesce(1)
    got = verdict.answered(prompts, "prompt", "said", Echo, verdict.Settings(concurrency=1, timeout=None))
    assert all(r.said == f"{r.id:03d}" and r.said_error is None for r in got.collect())
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan
    assert verdict.AT_A_TIME <= 64
