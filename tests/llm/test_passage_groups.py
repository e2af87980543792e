"""Minimizers of very many segments, texts that a document repeats, and what is sent between partitions."""

import hashlib
import random

import numpy as np
import pytest
from test_corpus import brute_passages

from quillon.llm import passages, suffix

BASES = (passages.Powers(0x9E3779B97F4A7C15), passages.Powers(0xD1B54A32D192ED05))


def _common_grams(n: int) -> list[tuple[int, str]]:
    """Texts with some long strings in common, of which few also share what stands around them."""
    pick = random.Random(4)
    letters = "abcdefghij "
    common = ["".join(pick.choices(letters, k=pick.randint(26, 34))) for _ in range(3)]
    sides = ["".join(pick.choices(letters, k=20)) for _ in range(3)]
    rows = []
    for doc in range(n):
        parts = []
        for gram in common:
            a, b = ("".join(pick.choices(letters, k=40)) if pick.random() < 0.8 else pick.choice(sides) for _ in range(2))
            parts += [a, gram, b]
        rows.append((doc, "".join(parts)))
    return rows


@pytest.mark.parametrize("hot", [2, 12, 60])
def test_groups_that_are_split_against_brute_force(spark, hot):
    rows = _common_grams(150) + [(200, None), (201, ""), (202, "a" * 400), (203, "b" + "a" * 300)]
    rows += [rows[3], (204, rows[5][1] * 3)]
    want = brute_passages(rows)
    got = {r.doc_id: hashlib.sha256(bytes(r.kept)).hexdigest() for r in passages.kept_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), hot=hot).collect()}
    assert got == {d: w[3] for d, w in want.items()}
    assert sum(w[1] > 0 for w in want.values()) > 40


def _hot(n: int) -> np.ndarray:
    """Wanted segments of a group with unlike surroundings, but for two that agree behind the minimizer."""
    pick = random.Random(5)
    while True:  # until a string's hash is low enough to be the minimizer of most texts
        gram = bytes(pick.choices(b"abcdefghijklmn", k=24))
        one = passages.segments([bytes(pick.choices(b"opqrstuvw", k=26)) + gram + bytes(pick.choices(b"opqrstuvw", k=26)) for _ in range(20)], np.arange(20), 50, *BASES)
        if np.unique(one["group"], return_counts=True)[1].max() == 20:
            break
    texts = [bytes(pick.choices(b"opqrstuvw", k=26)) + gram + bytes(pick.choices(b"opqrstuvw", k=26)) for _ in range(n)]
    texts[1] = texts[1][:50] + texts[0][50:]
    of = passages.segments(texts, np.arange(n), 50, *BASES)
    groups, counts = np.unique(of["group"], return_counts=True)
    of = of[of["group"] == groups[counts.argmax()]]
    of["bytes"] &= passages._SIZE
    return of


def test_of_a_large_group_goes_only_what_may_match():
    of = _hot(3000)
    assert len(of) > 2000
    whole = passages.filed(of, 50, hot=5000)
    assert len(whole) == len(of) and not whole["same"].any()
    split = passages.filed(of, 50, hot=100)
    assert 0 < len(split) <= 8 and not split["same"].any()


def test_windows_on_both_sides_cover_a_segment():
    of = _hot(300)
    of = np.concatenate((of, of))  # so all may match on both sides
    of["doc"][len(of) // 2 :] += 1000
    split = passages.filed(of, 50, hot=10)
    for doc in range(0, 300, 50):
        mine, all_ = split[split["doc"] == doc], of[of["doc"] == doc]
        windows = {k for r in mine for k in range(r["start"], r["start"] + r["bytes"] - 49)}
        assert windows == {k for r in all_ for k in range(r["start"], r["start"] + r["bytes"] - 49)}


def test_a_text_that_a_document_repeats_is_sorted_once(monkeypatch):
    sorted_ = []
    monkeypatch.setattr(passages, "suffix_array", lambda text: sorted_.append(len(text)) or suffix.suffix_array(text))
    pick = random.Random(6)
    a = bytes(pick.choices(b"abcdefgh ", k=70))
    b = a[:60] + bytes(pick.choices(b"XYZ", k=10))
    texts = [a] * 500 + [b] * 300 + [a]
    docs = np.array([1] * 500 + [2] * 300 + [3])
    starts = np.arange(len(texts)) * 100
    gone = passages.shard_spans(texts, docs, starts, 50)
    assert sorted_ == [len(a) + len(b) + 1]
    assert sorted((d, s) for d, s, n in gone[["doc", "start", "bytes"]].tolist() if n == 50) == sorted((2, int(s) + k) for s in starts[500:800] for k in range(11))
    assert [(d, s) for d, s, n in gone[["doc", "start", "bytes"]].tolist() if n == 70] == [(3, 80000)]


def test_equal_windows_of_a_batch_go_on_once():
    import pyarrow as pa

    text = "".join(random.Random(7).choices("abcdefgh ", k=80)).encode()
    wanted = np.zeros(1, dtype=passages._PLACE)
    wanted["same"], wanted["bytes"] = 1, 80
    batch = pa.RecordBatch.from_pylist([{"doc": d, "text": text, "wanted": wanted.tobytes()} for d in range(400)])
    (sent,) = passages._fetcher(50, 4)(iter([batch]))
    assert sent.num_rows == 31 + 1
    spans = np.frombuffer(sent.filter(sent["key"].is_null())["text"][0].as_py(), dtype=passages._PLACE)
    assert spans["doc"].tolist() == list(range(1, 400)) and (spans["bytes"] == 80).all()


def test_doubling_and_induction_agree():
    pick = random.Random(8)
    deep = 0
    for k in range(400):
        raw = bytes(pick.choices(b"ab\xff", k=pick.randint(2, 90))) * (1 if k % 2 else pick.randint(1, 40))
        text = np.frombuffer(raw, dtype=np.uint8)
        order = suffix._by_induction(text).tolist()
        assert order == sorted(range(len(raw)), key=lambda i: raw[i:])
        doubled = suffix._doubled(text)
        deep += doubled is None
        assert doubled is None or doubled.tolist() == order
    assert 0 < deep < 300


def test_blocks_give_back_what_was_put_in():
    rng = np.random.default_rng(9)
    places = np.zeros(5000, dtype=passages._PLACE)
    for name in ("group", "same", "around"):
        places[name] = rng.integers(0, 1 << 63, len(places), dtype=np.uint64) * np.uint64(2)
    places["doc"], places["start"], places["bytes"] = rng.integers(-(1 << 62), 1 << 62, 5000), rng.integers(0, 900, 5000), 63
    (back, _, wanted) = passages._gathered([passages._blocks(37, places=places, wanted=places[:10])])
    order = ["doc", "start", "group"]
    assert (np.sort(back, order=order) == np.sort(places, order=order)).all()
    assert (np.sort(wanted, order=order) == np.sort(places[:10], order=order)).all()
