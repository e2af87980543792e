"""Hard negatives against brute force, over odd rows, ties and several blocks of anchors."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import negatives as N

SCHEMA = "vec_id long, embedding array<float>, label int, q string, Score string"


def brute(rows):
    """``rows`` of (vec_id, vector, label): the contract in plain Python."""
    usable = set()
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        usable.add((i, tuple(math.floor(256 * float(np.float32(x))) for x in v), (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for i, v, label in sorted(usable):
        if i % 100:
            continue
        scored = {(-sum(a * b for a, b in zip(v, w)), j, m == label) for j, w, m in usable if j != i}
        for p, j, _ in sorted(s for s in scored if s[2])[:5]:
            fits = sorted(s for s in scored if not s[2] and 80 * -p <= 100 * -s[0] <= 100 * -p)[:5]
            out += [(i, j, k + 1, n, -p, -s) for k, (s, n, _) in enumerate(fits)]
    return sorted(out)


def mined(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(parts)
    return sorted(tuple(r) for r in N.mined(spark, df).collect())


def made(seed, n, width, spread):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(width)] for _ in range(4)]
    return [(i, [c + spread * r.gauss(0, 1) for c in r.choice(centres)], r.randrange(10)) for i in range(n)]


@pytest.mark.parametrize("width,spread", [(5, 0.3), (24, 1.0), (1, 0.1)])
def test_as_brute_force(spark, width, spread):
    rows = made(width, 700, width, spread)
    found = mined(spark, rows)
    assert found == brute(rows) and (found or width == 1)


def test_several_blocks_and_small_steps(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_NUMBERS", 24)
    monkeypatch.setattr(N, "PAIRS", 64)
    monkeypatch.setattr(N, "PENDING", 8)
    monkeypatch.setattr(N, "FIT_NUMBERS", 40)
    rows = made(3, 500, 8, 0.5)
    assert mined(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = made(5, 300, 6, 0.4)
    nan, inf = float("nan"), float("inf")
    rows += [(None, [1.0] * 6, 1), (400, None, 1), (401, [1.0] * 6, None), (402, [nan] + [1.0] * 5, 1), (403, [1.0] * 5 + [inf], 2), (404, [None] + [1.0] * 5, 3)]
    rows += rows[:20] + rows[100:101] * 3  # repeated rows, an anchor among them
    assert mined(spark, rows) == brute(rows)


def test_ties_and_one_hot_vector(spark):
    rows = [(i, [1.0, 0.5, 0.25], i % 3) for i in range(450)] + [(i, [0.9, 0.5, 0.25], 4) for i in range(450, 600)]
    assert mined(spark, rows) == brute(rows)


def test_zero_and_negative_scores_and_few_rows(spark):
    rows = [(0, [0.0, 0.0], 0), (1, [0.0, 0.0], 1), (2, [-1.0, 0.0], 1), (3, [3.0, 1.0], 2), (100, [1.0, 0.0], 1), (101, [-5.0, 0.0], 3)]
    assert mined(spark, rows) == brute(rows) != []


def test_vectors_of_other_lengths_count_as_padded(spark):
    rows = [(i, [1.0 + i % 5, 2.0, 0.5 * (i % 3)][: 2 + i % 2], i % 4) for i in range(210)]
    padded = [(i, (v + [0.0])[:3], m) for i, v, m in rows]
    assert mined(spark, rows) == brute(padded)


def test_large_numbers_stay_exact(spark):
    rows = [(i, [2.0**21 - i % 7, 2.0**20 + i % 11], i % 3) for i in range(205)] + [(999, [1e30, 0.0], 1)]
    assert mined(spark, rows) == brute(rows[:-1]) != []


def test_none_and_no_anchors(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []
    assert mined(spark, [(0, [], 0), (14, [], 1), (3, [], 1), (4, [], 5)]) == brute([(0, [], 0), (14, [], 1), (3, [], 1), (4, [], 5)])


def test_pairs_are_dropped_early_and_none_is_lost():
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(400, 32)) * np.linspace(40, 1, 32)).astype(np.int64)
    cuts = N.cuts_of(32)
    rotation = N.axes(x, 32)
    assert np.allclose(rotation @ rotation.T, np.eye(32))
    a, b = N.Rotated(x[:50], rotation, cuts), N.Rotated(x, rotation, cuts)
    scores = x[:50] @ x.T
    least = np.sort(scores, 1)[:, -6]
    most = np.sort(scores, 1)[:, -3]
    i, j, s = N.survivors(a, b, least, most, cuts)
    assert set(zip(i.tolist(), j.tolist(), s.tolist())) == {(p, q, int(scores[p, q])) for p, q in zip(*np.nonzero((scores >= least[:, None]) & (scores <= most[:, None])))}
    first = a.along[:, : cuts[0]] @ b.along[:, : cuts[0]].T + np.multiply.outer(a.rest[0], b.rest[0])
    assert (first < least[:, None]).mean() > 0.3  # after an eighth of the components


def test_query_is_the_operator_over_the_whole_table(spark, sf_dir):
    from quillon.llm.queries import op12_hard_negatives

    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [tuple(r) for r in t.select("vec_id", "embedding", F.col("label").cast("int")).collect()]
    assert sorted(tuple(r) for r in op12_hard_negatives(spark, sf_dir).collect()) == brute(rows)
