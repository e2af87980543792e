"""op10 on lines of one or two tokens, which take part like any other."""

from test_corpus import brute_lines

from quillon.llm.queries import QUERIES


def test_line_dedup_query_removes_short_lines(spark, tmp_path):
    rows = [
        (1, "Les.\n这是一行没有空格的中文\na\tb\tc\n\n \nx y\none two three\na b c d"),
        (2, "les.\n这是一行没有空格的中文\na\tb\tc\n\n \ny  X\nx\nx z\none two\none two three four\na b c d e"),
        (3, None),
        (4, "x\nLes. Les.\nLes\nd c b a f\na b c\na b"),
    ]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: [int(k) for k in r.removed.split(",") if k] for r in QUERIES["op10_line_dedup"](spark, str(tmp_path)).collect()}
    assert got == brute_lines(rows, 1)
    assert got[2][:3] == [0, 1, 2] and got[4][:2] == [0, 1]


def test_line_dedup_query_against_all_lines(spark, sf_dir, docs):
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = {r.doc_id: [int(k) for k in r.removed.split(",") if k] for r in QUERIES["op10_line_dedup"](spark, sf_dir).collect()}
    assert got == brute_lines(rows, 1)
