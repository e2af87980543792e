"""The steps of line dedup: texts are split once for all their lines, counters fit the map of generated code, settled classes alone are joined."""

import numpy as np
from pyspark.sql import functions as F

from quillon.llm import lines as L

ROWS = [(None, "The cat\nthe  CAT\n\na b c d"), (1, "Été été\nb a"), (2, None), (3, "")]


def test_counters_hold_every_token_of_every_line(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    before = spark.conf.get(L._MAP_BITS[0], None)
    classes = L.rarity(docs, buckets=1 << 12)
    assert spark.conf.get(L._MAP_BITS[0], None) == before
    assert 1 << int(L._MAP_BITS[1]) >= 2 * L.BUCKETS

    def of(token):
        return classes[spark.range(1).select(F.xxhash64(F.lit(token))).first()[0] & ((1 << 12) - 1)]

    twice = 6  # floor(6 * log2(2))
    assert [int(of(t)) for t in ("the", "cat", "été", "a", "b", "c")] == [twice] * 5 + [0]
    assert np.count_nonzero(classes) <= 6  # five tokens and the empty one


def test_bitmaps_and_digests_do_not_depend_on_the_order_of_tokens(spark):
    words = [f"w{k}" for k in range(L.WIDE + 5)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "  ".join(reversed(words)).upper())], "doc_id long, text string")
    a, b = L._described(docs, "doc_id", "text", L.rarity(docs), L.SIMILAR).orderBy("doc").collect()
    assert a[2:] == b[2:] and a.n == L.WIDE + 5 and a.half not in (None, 0, a.bits)
    hashes = [r.h for r in spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w").alias("h")).collect()]
    bits = half = 0
    for h in hashes:
        bits ^= 1 << (h & 63)
        half ^= (h >> 6 & 1) << (h & 63)
    assert (a.bits % (1 << 64), a.half % (1 << 64)) == (bits, half)


def test_positions_and_lengths_allow_all_similar_sets():
    """What a pair needs is in a set's reach, just as by the number of tokens that are left."""
    for num, den in ((4, 5), (1, 2), (9, 10), (1, 1)):
        for n in range(1, 41):
            for i in range(n - -(-n * num // den) + 1):
                reach = ((num + den) * (n - i) - num * n) // num
                assert reach >= 0
                for m in range(1, 90):
                    assert (reach >= m) == ((num + den) * (n - i) >= num * (n + m))


def test_a_text_is_split_once_for_all_its_lines(spark):
    docs = spark.createDataFrame([(1, "a b\nc d\ne f")], "doc_id long, text string")
    pairs = spark.createDataFrame([(1, 2, 1, 0), (1, 1, 1, 0)], "x_doc long, x_line int, y_doc long, y_line int")
    plans = []
    durable, L.durable = L.durable, lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or durable(df)
    try:
        found = {(r.line_no, tuple(r.tokens)) for r in L._tokens(pairs, docs, "doc_id", "text").collect()}
    finally:
        L.durable = durable
    assert found == {(0, ("a", "b")), (1, ("c", "d")), (2, ("e", "f"))}
    assert "Generate posexplode(split(text" in plans[-1]


def test_only_settled_classes_are_open_no_more(spark):
    rows = [(None, 0, 5), (None, 1, 5), *((k, 0, 5) for k in range(300))]
    firsts = spark.createDataFrame(rows, "doc long, line_no int, n int")
    done = spark.createDataFrame([(None, 1), (7, 0)], "doc long, line_no int")
    got = L._marked(firsts, done)
    assert {(r.doc, r.line_no) for r in got.where("open = 0").collect()} == {(None, 1), (7, 0)}
    assert got.count() == len(rows) and got.where("open = 1").count() == len(rows) - 2
