"""Rows that a join cannot need are left out before it; what the sieve lets through decides nothing."""

from test_corpus import brute_lines

from quillon.llm import lines as L


def test_sieve_holds_all_wanted_rows(spark):
    wanted = [(k, f"d{k}" if k else None) for k in range(0, 4000, 40)]
    may_hold = L._sieve(spark.createDataFrame(wanted, "n int, doc string"))
    rows = spark.createDataFrame([(k, f"d{k}" if k else None) for k in range(4000)], "n int, doc string")
    passed = {r.n for r in rows.where(may_hold(rows.n, rows.doc)).collect()}
    assert passed >= {n for n, _ in wanted} and len(passed) < 200
    assert rows.where(L._sieve(spark.createDataFrame([], "n int"))(rows.n)).isEmpty()


def test_only_documents_of_pairs_are_fetched(spark):
    docs = spark.createDataFrame([(None, "x y\nz"), *((k, f"a b c\nd {k}") for k in range(500))], "doc_id long, text string")
    pairs = spark.createDataFrame([(None, 0, 7, 1), (7, 1, 9, 0)], "x_doc long, x_line int, y_doc long, y_line int")
    found = L._tokens(pairs, docs, "doc_id", "text")
    assert {(r.doc, r.line_no, tuple(r.tokens)) for r in found.collect()} == {(None, 0, ("x", "y")), (7, 1, ("d", "7")), (9, 0, ("a", "b", "c"))}


def test_full_sieve_changes_no_result(spark, monkeypatch):
    """A table of one word lets almost all rows through."""
    near = lambda group, k: " ".join([*(f"g{group}w{i}" for i in range(18)), f"u{group}x{k}"])
    rows = [(100 * g + k, near(g, k) + "\nsame line\n" + near(g, k % 3)) for g in range(4) for k in range(24)]
    monkeypatch.setattr(L, "MANY", 4)
    monkeypatch.setattr(L._sieve, "__defaults__", (64,))
    got = {}
    for r in L.removed_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_tokens=1).collect():
        got.setdefault(r.doc, set()).add(r.line_no)
    assert {d: sorted(got.get(d, ())) for d, _ in rows} == brute_lines(rows, 1)
