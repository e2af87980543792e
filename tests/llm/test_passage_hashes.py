"""Segments whose hashes collide keep their bytes."""

import hashlib
import random

import numpy as np
import pytest
from test_corpus import brute_passages

from quillon.llm import passages


def _documents(seed: int) -> list[tuple[int, str]]:
    """Random texts, of which some share passages of 30 to 90 bytes, changed in one byte or not."""
    pick = random.Random(seed)
    letters = "abcdefghij "
    shared = ["".join(pick.choices(letters, k=pick.randint(30, 90))) for _ in range(12)]
    rows = []
    for doc in range(60):
        parts = []
        for _ in range(pick.randint(1, 4)):
            passage = pick.choice(shared)
            if pick.random() < 0.5:
                at = pick.randrange(len(passage))
                passage = passage[:at] + pick.choice("XYZ") + passage[at + 1 :]
            parts += ["".join(pick.choices(letters, k=pick.randint(0, 120))), passage]
        rows.append((doc, "".join(parts)))
    return rows


def _hashes(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return {r.doc_id: hashlib.sha256(bytes(r.kept)).hexdigest() for r in passages.kept_bytes(frame).collect()}


@pytest.mark.parametrize("weak", ["_first_hash", "_second_hash"])
def test_one_hash_that_always_collides_removes_nothing_more(spark, monkeypatch, weak):
    kind = np.uint64 if weak == "_first_hash" else np.int64
    monkeypatch.setattr(passages, weak, lambda total, up, start, stop: np.zeros(len(start), dtype=kind))
    rows = _documents(7)
    want = {d: w[3] for d, w in brute_passages(rows).items()}
    assert len(set(want.values())) > 40
    assert _hashes(spark, rows) == want


def test_the_bases_do_not_change_the_result(spark):
    rows = _documents(11)
    want = {d: w[3] for d, w in brute_passages(rows).items()}
    assert _hashes(spark, rows) == want and _hashes(spark, rows) == want


def test_without_either_hash_bytes_would_go(spark, monkeypatch):
    """So the first test reaches segments that one hash alone tells apart."""
    monkeypatch.setattr(passages, "_first_hash", lambda total, up, start, stop: np.zeros(len(start), dtype=np.uint64))
    monkeypatch.setattr(passages, "_second_hash", lambda total, up, start, stop: np.zeros(len(start), dtype=np.int64))
    rows = _documents(7)
    assert _hashes(spark, rows) != {d: w[3] for d, w in brute_passages(rows).items()}
