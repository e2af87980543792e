"""Suffix arrays of texts with long runs, and segments whose hashes collide."""

import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import passages
from quillon.llm.suffix import suffix_array


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(1, 12)), max_size=14))
def test_texts_of_runs(runs):
    raw = b"".join(bytes([symbol]) * n for symbol, n in runs)
    assert suffix_array(np.frombuffer(raw, dtype=np.uint8)).tolist() == sorted(range(len(raw)), key=lambda k: raw[k:])


@pytest.mark.parametrize("raw", [b"a" * (1 << 20), b"ab" * (1 << 19), (b"a" * 300_000 + b"b") * 3, (b" " * 199 + b"x") * 5000])
def test_a_shard_of_runs_takes_no_longer_than_others(raw):
    began = time.perf_counter()
    order = suffix_array(np.frombuffer(raw, dtype=np.uint8))
    assert time.perf_counter() - began < 10
    assert (np.sort(order) == np.arange(len(raw))).all()
    some = order[:: len(raw) // 200].tolist()
    assert all(raw[a:] < raw[b:] for a, b in zip(some, some[1:], strict=False))


def test_segments_of_one_hash_are_equal_only_with_their_minimizer_and_length():
    rows = [(7, 1, 0, 3, 10, 60), (8, 1, 0, 4, 10, 60), (7, 1, 0, 5, 0, 60), (7, 1, 0, 6, 0, 61), (8, 1, 0, 9, 2, 60)]
    places = np.array(rows, dtype=passages._PLACE)
    kept, gone = passages.firsts_of(places)
    assert sorted(kept["doc"].tolist()) == [3, 4, 6] and sorted(gone["doc"].tolist()) == [5, 9]


def test_dedup_of_runs_against_brute_force(spark):
    from test_corpus import brute_passages

    import hashlib

    rows = [(1, "a" * 3000), (2, "b" + "a" * 2000 + "b"), (3, " " * 500 + "x" + " " * 700), (4, "y" + " " * 900), (5, "ab" * 400), (6, "ba" * 300)]
    want = brute_passages(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for r in passages.kept_bytes(frame).collect():
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == want[r.doc_id][3]
