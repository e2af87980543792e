"""Columns of the input that are named as the results: they pass through, and the result gets another name."""

import pytest
from pyspark.sql import functions as F

from quillon.llm import language, licenses, lines, passages, quality, secrets, simhash

RESULTS = {
    "verdict": quality.judged,
    "licenses": licenses.license_matches,
    "secrets": secrets.secret_spans,
    "removed": lambda docs: lines.deduplicated(docs, min_tokens=1),
    "spans": passages.with_spans,
    "fingerprint": simhash.fingerprints,
    "language": lambda docs: language.predicted(docs, language.learn(docs.select("doc_id", "text", F.lit("x").alias("lang")))),
}


@pytest.mark.parametrize("name", sorted(RESULTS))
def test_a_column_of_the_result_s_name_passes_through(odd, none, name):
    out = RESULTS[name](odd)
    assert out.columns == [*odd.columns, f"_{name}"]
    assert out.count() == odd.count() and {r[0] for r in out.select(name).collect()} == {f"{name}!"}
    assert name == "spans" or out.where(F.col(f"_{name}").isNotNull()).count() > 0  # spans are null where nothing goes
    assert RESULTS[name](none).count() == 0


def test_kept_bytes_beside_a_column_of_its_name(spark):
    docs = spark.createDataFrame([(1, "x" * 60, "a", "b"), (2, "x" * 60 + "y", "a", "b")], "doc_id long, text string, kept string, spans string")
    out = passages.kept_bytes(docs)
    assert out.columns == [*docs.columns, "_kept"]
    assert {r.doc_id: bytes(r["_kept"]) for r in out.collect()} == {1: b"x" * 60, 2: b"y"}


def test_many_languages(spark):
    """More languages than a byte counts."""
    rows = [(k, " ".join(f"{a}{chr(97 + k % 26)}{chr(97 + k // 26)}" for a in ("abc", "de", "xyz")), f"l{k:03}") for k in range(150)]
    model = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = language.predicted(spark.createDataFrame([r[1:] for r in rows[120:]], "text string, lang string"), model).collect()
    assert sum(r.lang == r.language.lang for r in got) >= 0.9 * len(got)


def test_rows_without_an_id_are_not_held_out(spark):
    got = spark.createDataFrame([(None,), (1,), (2,)], "doc_id long").select(language.held_out(F.col("doc_id")).alias("h")).collect()
    assert got[0].h is False and all(isinstance(r.h, bool) for r in got)


def test_kept_lines_are_counted_from_what_goes(spark, tmp_path):
    from quillon.llm.queries import QUERIES

    spark.createDataFrame([(1, "a b c"), (2, "a b c"), (3, None), (4, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: (r.n_kept, r.n_removed) for r in QUERIES["op10_line_dedup"](spark, str(tmp_path)).collect()} == {1: (1, 0), 2: (0, 1), 3: (0, 0), 4: (1, 0)}
