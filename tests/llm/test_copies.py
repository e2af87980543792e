"""The near-copy stage of the pipeline against brute-force Jaccard indexes."""

import random

import corpus_pipeline


def brute_kept(rows, width=5):
    """Ids that are the least of their component of pairs at an index of 0.8 or more."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({b" ".join(w[k : k + width]) for k in range(max(1, len(w) - width + 1))})
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return [rows[r][0] for r in sorted(set(root))]


def near_copies():
    """Texts with 0 to 14 words changed, so that indexes lie on both sides of 0.8 and chains occur."""
    rng = random.Random(3)
    rows = []
    for _ in range(25):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice((20, 120, 300)))]
        for _ in range(12):
            words = list(base)
            for _ in range(rng.randrange(15) * len(base) // 300):
                words[rng.randrange(len(words))] = f"v{rng.randrange(3000)}"
            rows.append(" ".join(words))
    rng.shuffle(rows)
    return list(enumerate([*rows, "", None, "one two", "ONE  two"]))


def test_near_dedup_against_brute_force(spark):
    rows = near_copies()
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, frame, "").collect()) == brute_kept(rows)


def test_near_dedup_of_given_documents(spark, docs):
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == brute_kept(rows)


def test_near_dedup_of_odd_rows(spark, odd, none):
    kept = corpus_pipeline.near_dedup(spark, odd, "")
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == [1, 1, 3, 6, 7]
    assert corpus_pipeline.near_dedup(spark, none, "").count() == 0
