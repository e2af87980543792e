"""The interval between requests holds over all tasks."""

import random
import sys
import time

import pytest
from pyspark import cloudpickle

from quillon.operators.verdict import Pace, Settings, answered

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the model below runs in tasks


class Clock:
    """Answers with the time at which it was asked, after a random wait."""

    def complete(self, prompt, json_mode):
        began = time.time()
        time.sleep(random.random() * 0.3)
        return repr(began)


def test_starts_of_five_tasks_keep_the_interval(spark):
    df = spark.createDataFrame([(f"p{k}",) for k in range(24)], "p string")
    settings = Settings(interval=0.15, concurrency=5)
    rows = answered(df, "p", "a", Clock, settings).collect()
    starts = sorted(float(r.a) for r in rows)
    assert len(starts) == 24 and all(r.a_error is None for r in rows)
    assert min(b - a for a, b in zip(starts, starts[1:])) > 0.15 * 0.7  # a woken thread may be some milliseconds late


def test_slots_of_tasks_are_apart_and_each_is_used_once():
    paces = [Pace(0.5, task, 3) for task in range(3)]
    used = []
    for p in paces:
        for now in (10.0, 10.0, 10.1, 14.2, 14.2):
            p.last = p.next_slot(now)
            assert p.last * 0.5 >= now
            used.append(p.last)
    assert len(set(used)) == len(used)


def test_an_interval_needs_a_number_of_tasks():
    with pytest.raises(ValueError, match="number of tasks"):
        Settings(interval=1.0, concurrency=None)
