"""A benchmark in several blocks, items longer than a block, and windows of equal hashes."""

import random

import numpy as np
import pytest

from quillon.llm import decontam


def brute(rows, items, width=10):
    """Of each text: words, hit words, items whose windows occur."""
    known = {}
    for name, text in items:
        w = decontam.words((text or "").encode())
        n = min(width, len(w))
        for k in range(len(w) - n + 1) if n else ():
            known.setdefault(tuple(w[k : k + n]), set()).add(name)
    out = []
    for d, text in rows:
        w = decontam.words((text or "").encode())
        hit, names = set(), set()
        for n in {len(k) for k in known}:
            for k in range(len(w) - n + 1):
                if (of := known.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    names |= of
        out.append((d, len(w), len(hit), tuple(sorted(n for n in names if n is not None))))
    return sorted(out)


def texts():
    rng = random.Random(8)
    words = [f"w{k}" for k in range(60)]
    items = [(str(k), " ".join(rng.choice(words) for _ in range(rng.choice((3, 9, 10, 30, 90))))) for k in range(30)]
    items += [(None, " ".join(words[:12])), ("5", items[4][1])]
    rows = []
    for d in range(80):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randrange(40)))]
        for _ in range(rng.randrange(3)):
            of = rng.choice(items)[1].split()
            at = rng.randrange(len(of))
            parts += [" ".join(of[at : at + rng.randrange(1, 40)]), rng.choice(("x", "."))]
        rows.append((d, " ".join(parts)))
    return [*rows, (90, None), (91, ""), (92, " ".join(words[:12]))], items


@pytest.mark.parametrize("block_words", [20, 45, 200, 1_000_000])
def test_blocks_against_brute_force(spark, block_words):
    rows, items = texts()
    docs = spark.createDataFrame([(*r, "a") for r in rows], "doc_id long, text string, hits string").repartition(3)
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    out = decontam.hits(docs, benchmark, block_words=block_words)
    assert out.columns == [*docs.columns, "_hits"]
    got = [(r.doc_id, r["_hits"].n_words, sum(s.end - s.start for s in r["_hits"].spans), tuple(sorted(r["_hits"]["items"]))) for r in out.collect()]
    assert sorted(got) == brute(rows, items)


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(decontam, "_hash", lambda w, n: np.zeros(len(w), dtype=np.uint64))
    rows, items = texts()
    known = decontam.WindowSet([(n, t.encode()) for n, t in items])
    found = known.scan([decontam.words((t or "").encode()) for _, t in rows])
    got = [(d, sum(b - a for a, b in decontam.merged(spans)), tuple(sorted(n for n in names if n is not None))) for (d, _), (spans, names) in zip(rows, found, strict=True)]
    assert got == [(d, hit, names) for d, _, hit, names in brute(rows, items)]
