"""Small groups of near copies are left to the join, large ones are settled first; both lose the lines that any pair loses."""

from quillon.llm import lines as L


def test_small_and_large_groups(spark, monkeypatch):
    near = lambda group, k: " ".join([*(f"g{group}w{i}" for i in range(18)), f"u{group}x{k}"])  # 18 of 20 tokens alike
    rows = [(100 * size + k, near(size, k)) for size in (2, L.MANY - 1, 3 * L.MANY) for k in range(size)]
    settled = []

    def seen(firsts, similar, settling=L._settling):
        out = settling(firsts, similar)
        settled.extend(r.x_doc // 100 for r in out.collect())
        return out

    monkeypatch.setattr(L, "_settling", seen)
    gone = {r.doc for r in L.removed_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_tokens=1).collect()}
    assert gone == {d for d, _ in rows if d % 100}
    assert set(settled) == {3 * L.MANY}
