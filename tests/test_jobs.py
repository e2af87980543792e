"""The jobs over whole tables and over odd rows, run again, over growing input, and after a run that broke off."""

import json
import subprocess
import sys
from pathlib import Path

import pytest
from oracle import differences, rows
from pyspark.sql import functions as F

from jobs import common, session_ledger, verdict_report
from jobs.queries import ORACLES, QUERIES

ROOT = Path(__file__).parents[1]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert differences(QUERIES[name](spark, sf_dir), ORACLES[name], sf_dir) == []


def test_jobs_import_nothing_of_the_llm_side():
    code = "import sys, jobs.queries; print([m for m in sys.modules if 'llm' in m or 'corpus_pipeline' in m])"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120).stdout.strip() == "[]"


def test_configuration(tmp_path):
    path = tmp_path / "c.json"
    path.write_text('{"min_hits": 3}')
    assert common.configured("verdict_report", str(path))["min_hits"] == 3 and common.configured("verdict_report")["min_hits"] == 1
    path.write_text('{"min_hit": 3}')
    with pytest.raises(ValueError, match="unknown settings"):
        common.configured("verdict_report", str(path))


def snapshot(spark, path):
    df = spark.read.parquet(path)
    return rows(df.columns, df.collect())


def test_verdicts_of_odd_documents(spark, tmp_path):
    docs = [(1, "an IDIOT. scum", "en", "a"), (2, None, "en", "a"), (3, " ", None, None), (4, "x" * 400, "", "b"), (5, "fine", "de", "a"), (5, "fine", "de", "a"), (6, "moron", "de", "a"), (7, "fine", "de", "a"), (None, "clown", "de", "a")]
    labels = [(1, 1), (2, 0), (3, 1), (4, 0), (5, 0), (6, 0), (6, 1), (7, None), (9, 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "d"))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "l"))
    config = common.configured("verdict_report") | {"max_tokens": 100}
    out = str(tmp_path / "out")
    seen = []
    for _ in range(2):
        verdict_report.run(spark, str(tmp_path / "d"), str(tmp_path / "l"), out, config)
        seen.append((snapshot(spark, f"{out}/verdicts"), snapshot(spark, f"{out}/scorecards")))
    assert seen[0] == seen[1]
    got = {r.doc_id: (r.lang, r.label, r.prediction, r.hits, r.status) for r in spark.read.parquet(f"{out}/verdicts").collect()}
    assert got == {
        1: ("en", 1, 1, 2, "scored"),
        2: ("en", 0, None, 0, "no text"),
        3: ("unknown", 1, None, 0, "no text"),
        4: ("unknown", 0, None, 0, "over budget"),
        5: ("de", 0, 0, 0, "scored"),
        6: ("de", 1, 1, 1, "conflict"),
        7: ("de", None, 0, 0, "unlabelled"),
        None: ("de", None, 1, 1, "unlabelled"),
    }
    cards = {(r.lang, r.source): (r.total_expected, r.missing, r.true_positive, r.true_negative) for r in spark.read.parquet(f"{out}/scorecards").collect()}
    assert cards == {("en", "a"): (2, 1, 1, 0), ("unknown", ""): (1, 1, 0, 0), ("unknown", "b"): (1, 1, 0, 0), ("de", "a"): (1, 0, 0, 1)}


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "d"))
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "l"))
    spark.createDataFrame([], TURNS).write.parquet(str(tmp_path / "c"))
    verdict_report.run(spark, str(tmp_path / "d"), str(tmp_path / "l"), str(tmp_path / "out"))
    assert session_ledger.run(spark, str(tmp_path / "c"), str(tmp_path / "out2"), str(tmp_path / "cp")) == 0
    assert spark.read.schema(session_ledger.SESSIONS).parquet(str(tmp_path / "out2" / "sessions")).count() == 0


TURNS = "conv_id long, turn long, role string, text string"
FIRST = [(1, 0, "user", "hello"), (1, 1, "assistant", "you idiot"), (2, 0, "user", "again"), (2500, 0, "user", None), (None, 0, "user", "nobody's")]
SECOND = [(1, 1, "assistant", "sent again, with other words"), (1, 2, "user", "hello"), (2500, 1, "assistant", "w " * 4000), (7000, 0, "system", "new")]


def arrive(spark, folder, k, turns):
    spark.createDataFrame(turns, TURNS).coalesce(1).write.mode("append").parquet(str(folder))


def by_session(spark, out):
    return {r.conv_id: r for r in spark.read.parquet(f"{out}/sessions").collect()}


def test_sessions_grow_with_their_input(spark, tmp_path):
    src, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    arrive(spark, src, 0, FIRST)
    assert session_ledger.run(spark, str(src), out, cp) == len(FIRST)
    before = by_session(spark, out)
    assert set(before) == {1, 2, 2500} and before[1].prediction == "MALWARE" and before[1].turns == 2 and not before[2500].over_budget
    kept = {p: p.stat().st_mtime_ns for p in (tmp_path / "out" / "ledger").rglob("*.parquet")}
    arrive(spark, src, 1, SECOND)
    assert session_ledger.run(spark, str(src), out, cp) == len(SECOND)  # what is new, and no more
    assert all(p.stat().st_mtime_ns == t for p, t in kept.items())
    after = by_session(spark, out)
    assert set(after) == {1, 2, 2500, 7000}
    assert (after[1].turns, after[1].flagged_turns, after[1].repeated, after[1].last_turn) == (3, 1, 1, 2)  # the turn that came again counts as it first came
    assert after[2500].over_budget and after[7000].input_tokens == 1 and after[2] == before[2]
    assert session_ledger.run(spark, str(src), out, cp) == 0
    assert by_session(spark, out) == after


def test_a_batch_that_broke_off_is_done_again(spark, tmp_path):
    src, out, cp = tmp_path / "in", str(tmp_path / "out"), tmp_path / "cp"
    arrive(spark, src, 0, FIRST)
    session_ledger.run(spark, str(src), out, str(cp))
    arrive(spark, src, 1, SECOND)
    session_ledger.run(spark, str(src), out, str(cp))
    whole, ledger = by_session(spark, out), snapshot(spark, f"{out}/ledger")
    for f in (cp / "commits").glob("*1*"):
        f.unlink()  # as if the run had ended before the batch was marked as done
    assert session_ledger.run(spark, str(src), out, str(cp)) == len(SECOND)
    assert by_session(spark, out) == whole and snapshot(spark, f"{out}/ledger") == ledger


def test_small_batches_give_the_same_sessions(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/conversations.parquet").repartition(5).write.parquet(str(tmp_path / "in"))
    config = common.configured("session_ledger")
    session_ledger.run(spark, str(tmp_path / "in"), str(tmp_path / "a"), str(tmp_path / "cpa"), config)
    session_ledger.run(spark, str(tmp_path / "in"), str(tmp_path / "b"), str(tmp_path / "cpb"), config | {"max_files_per_batch": 2, "bucket_span": 10})
    one, other = (spark.read.parquet(str(tmp_path / x / "sessions")).drop("bucket") for x in "ab")
    assert one.exceptAll(other).isEmpty() and other.exceptAll(one).isEmpty() and one.count() > 0


def test_command_lines(spark, sf_dir, tmp_path):
    small = tmp_path / "c.json"
    small.write_text(json.dumps({"terms": ["idiot"]}))
    conv = f"{sf_dir}/conversations.parque[t]"
    runs = [
        ["jobs.verdict_report", "--documents", f"{sf_dir}/documents.parquet", "--labels", f"{sf_dir}/labels.parquet", "--output", str(tmp_path / "v"), "--config", str(small)],
        ["jobs.session_ledger", "--conversations", conv, "--output", str(tmp_path / "s"), "--checkpoint", str(tmp_path / "cp"), "--config", str(small)],
    ]
    for r in runs:
        done = subprocess.run([sys.executable, "-m", *r], cwd=ROOT, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0 and "wrote" in done.stderr, done.stderr[-2000:]
    assert spark.read.parquet(str(tmp_path / "v" / "verdicts")).where(F.col("hits") > 0).count() > 0
    assert spark.read.parquet(str(tmp_path / "s" / "sessions")).count() > 0
