import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quillon.operators.evaluation import confusion
from quillon.operators.verdict import RuleModel, Settings, TransientError, answered, applications_tier, flat, functions_tier, interfaces_tier, validated_final, with_cache
from quillon.sources import artefacts, predictions, sinks, splits
from quillon.streaming.incremental import append_available, arriving_predictions

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the models below run in tasks
A, B = "a" * 64, "B" * 64


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_split(spark, tmp_path):
    path = write(tmp_path / "s.csv", f"﻿sha256, label ,family,date,vt\n{A},1.0, fam, 2022-01-01 00:00:00,3\n{B},0.0\n")
    rows = {r.sha256: r for r in splits.read_split(spark, path).collect()}
    assert rows[A.upper()].label == 1 and rows[A.upper()].family == "fam" and rows[A.upper()].date == "2022-01-01 00:00:00"
    assert rows[B].label == 0 and rows[B].family == ""


@pytest.mark.parametrize("row", ["abc,1", f"{B},0.5", f"{B},", f"{B},nan", f"{A},1", f"{B},1,x,y"])
def test_invalid_splits(spark, tmp_path, row):
    with pytest.raises(ValueError):
        splits.read_split(spark, write(tmp_path / "s.csv", f"sha256,label,family\n{A},1,f\n{row}\n"))


def test_missing_column_and_conflict(spark, tmp_path):
    with pytest.raises(ValueError, match="lacks the columns"):
        splits.read_split(spark, write(tmp_path / "s.csv", "sha256,family\n"))
    one, two = write(tmp_path / "train.csv", f"sha256,label\n{A},1\n"), write(tmp_path / "test_1.csv", f"sha256,label\n{A},0\n")
    assert [p.rsplit("/", 1)[1] for p in splits.existing(spark, str(tmp_path))] == ["train.csv", "test_1.csv"]
    with pytest.raises(ValueError, match="conflicting"):
        splits.read_labels(spark, [one, two])


def test_catalog_and_list(spark, tmp_path):
    path = write(tmp_path / "m.csv", "API,Index,Permissions\na.B.f,0,\"['Permission:X']\"\na.B.g,1,[]\n")
    assert {(r.api_index, r.signature, tuple(r.permissions)) for r in splits.read_catalog(spark, path).collect()} == {(0, "a.B.f", ("X",)), (1, "a.B.g", ())}
    with pytest.raises(ValueError, match="repeated"):
        splits.read_catalog(spark, write(tmp_path / "m2.csv", "API,Index,Permissions\na,0,\nb,0,\n"))
    assert {tuple(r) for r in splits.read_api_list(spark, write(tmp_path / "l.txt", "La/b/C;->f\nLd/E;->g\n")).collect()} == {(0, "a.b.C", "f"), (1, "d.E", "g")}
    with pytest.raises(ValueError):
        splits.read_api_list(spark, write(tmp_path / "l2.txt", "La/b/C;->f\nbad\n"))


@pytest.fixture
def tree(tmp_path):
    at = tmp_path / "out" / A / "0" / "0"
    write(at / "CallGraph" / "g.dot", "f---1 -> g---2")
    write(at / "SliceGraph" / "f.dot", "x = exec---7")
    write(at / "SliceGraph" / "h__callsite_0.dot", "y---8")
    write(at / "cfg" / "f.dot", "hidden")
    write(at / "cfg" / "h.dot", "hidden as well")
    write(at / "cfg" / "k.dot", "fallback")
    write(at / "Relation" / "f.txt", "[Direct] r1\n")
    write(tmp_path / "out" / A / "0" / "1" / "CallGraph" / "g.dot", "without slices")
    return str(tmp_path / "out")


def test_contexts_and_inspection(spark, tree):
    catalog = spark.createDataFrame([(0, "a.B.f", [])], "api_index int, signature string, permissions array<string>")
    found = artefacts.contexts(artefacts.read_artefacts(spark, tree), catalog)
    rows = {r.name: r for r in found.collect()}
    assert set(rows) == {"f.dot", "h__callsite_0.dot", "k.dot"}
    assert rows["f.dot"].graph == "x = exec" and rows["f.dot"].relations == "[Direct] r1\n" and rows["k.dot"].relations is None and rows["k.dot"].call_graph == "f -> g"
    assert tuple(artefacts.inspection(found).first()) == (1, 1, 3, 1)
    with pytest.raises(Exception, match="catalogue lacks"):
        artefacts.contexts(artefacts.read_artefacts(spark, tree), catalog.where("false")).collect()


def test_results_logs_and_resuming(spark, tmp_path):
    write(tmp_path / "r" / f"{A.upper()}.json", json.dumps({"prediction": "malware", "sha256": A}))
    write(tmp_path / "r" / ".cache" / "x.json", "{}")
    assert [tuple(r) for r in predictions.read_results(spark, str(tmp_path / "r")).collect()] == [(A.upper(), 1)]
    write(tmp_path / "r" / f"{B}.json", json.dumps({"prediction": "odd"}))
    with pytest.raises(ValueError, match="invalid prediction"):
        predictions.read_results(spark, str(tmp_path / "r"))
    write(tmp_path / "l" / f"{A}.log", "Final Prediction: BENIGN\n... Final Prediction: **MALWARE**\n")
    write(tmp_path / "l" / f"{B}.log", "nothing")
    logs = predictions.read_logs(spark, str(tmp_path / "l"))
    assert [tuple(r) for r in logs.collect()] == [(A.upper(), 1)]
    split = spark.createDataFrame([(A.upper(), 1), (B, 0)], "sha256 string, label int")
    assert confusion(split, logs, "sha256").first().missing == 1
    done = spark.createDataFrame([(B, "m")], "sha256 string, model string")
    assert [r.sha256 for r in predictions.to_do(split, done, {"model": "m"}).collect()] == [A.upper()]
    with pytest.raises(ValueError, match="another configuration"):
        predictions.to_do(split, done, {"model": "n"})


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("n", 1, "old"), ("n", 2, "new")], "name string, written int, text string")
    assert sinks.graph_files(rows, ["name"], "written").first().text == "old"
    rel = spark.createDataFrame([("n", 1, ("Direct", ["a"])), ("n", 2, ("Direct", ["c"])), ("n", 2, ("Direct", ["b"]))], "name string, written int, relation struct<kind:string,variables:array<string>>")
    assert sinks.relation_files(rel, ["name"], "written").first().text == "[Direct] b\n[Direct] c"
    assert '"a" -> "b";' in sinks.dot_text(spark.createDataFrame([("g", "a", "b")], "g string, src string, dst string"), ["g"]).first().text
    results = spark.createDataFrame([(A, 1), (B, 0)], "sha256 string, prediction int")
    for _ in range(2):
        sinks.write_results(results, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_stream_goes_on_where_it_ended(spark, tmp_path):
    def line(k, p):
        return json.dumps({"sha256": k, "prediction": p}) + "\n"

    src, out, at = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "at")
    write(src / "1.json", line(A, "MALWARE") + line("bad", "BENIGN"))
    append_available(arriving_predictions(spark, str(src)), out, at).awaitTermination()
    write(src / "2.json", line(B, "benign"))
    append_available(arriving_predictions(spark, str(src)), out, at).awaitTermination()
    assert {tuple(r) for r in spark.read.parquet(out).collect()} == {(A.upper(), 1), (B, 0)}


class Scripted:
    """Answers by what the prompt asks for."""

    def complete(self, prompt, json_mode):
        if "fail" in prompt:
            raise RuntimeError("no")
        if "empty" in prompt:
            return ""
        if not json_mode:
            return "revised" if "TASK: revise" in prompt else "short"
        if "TASK: function" not in prompt:
            return RuleModel().complete(prompt, json_mode)
        if "cutoff" in prompt:
            return '{"functionPurpose": "x"'
        found = [{"type": "Direct", "variable": "r1" if "good" in prompt else "r9"}] + ([{"type": "Direct", "variable": "1"}] if "odd" in prompt else [])
        return "```json\n" + json.dumps({"function_purpose": "p", "controlFlowAnalysis": "c", "relationships": found[0] if "single" in prompt else found}) + "\n```"


def test_functions_tier_routes(spark):
    known = [("Direct", ["r1"])]
    rows = [("good", known), ("bad", known), ("good odd", known), ("good single", known), ("good none", None), ("cutoff", known), ("cutoff none", None), ("fail", known), ("empty", known), ("bad too", [])]
    slices = spark.createDataFrame([(g, "sig", e) for g, e in rows], "graph string, signature string, expected array<struct<kind:string,variables:array<string>>>")
    got = {r.graph: r for r in functions_tier(slices, Scripted).collect()}
    assert {g: r.status for g, r in got.items() if r.error is None} == {"good": "passed", "bad": "revised", "good odd": "revised", "good single": "passed", "good none": "unavailable", "cutoff": "revised", "cutoff none": "unavailable", "bad too": "revised"}
    assert got["bad"].summary == "revised" and got["bad"].metrics.drc == 0.0 and got["cutoff none"].summary == "short"
    assert got["fail"].error == "RuntimeError: no" and got["empty"].error == "empty answer"
    off = functions_tier(slices.where("graph = 'good'"), Scripted, Settings(mode="no-verification")).first()
    assert (off.status, off.summary) == ("disabled", "short")


def test_cache_and_tiers_to_the_verdict(spark):
    slices = spark.createDataFrame([(A, 0, k, f"good {k} exec", "sig", [("Direct", ["r1"])]) for k in range(6)], "sha256 string, api_index int, ordinal int, graph string, signature string, expected array<struct<kind:string,variables:array<string>>>")
    first = with_cache(slices, None, lambda s: functions_tier(s, Scripted)).cache()
    again = with_cache(slices, first, lambda s: functions_tier(s, Scripted))
    assert again.where("cached").count() == 6 and first.where("cached").count() == 0
    interfaces = interfaces_tier(first, RuleModel, Settings(budget=50), overhead=10)
    assert interfaces.first().batches > 1 and "== Batch 1 ==" in interfaces.first().analysis
    final = applications_tier(interfaces_tier(first, RuleModel), RuleModel).first()
    assert final.prediction in ("MALWARE", "BENIGN") and final.error is None
    assert flat(slices.select("sha256", "api_index", "signature", "graph"), RuleModel).first().prediction == "MALWARE"


def test_budget_retry_and_settings(spark):
    class Shaky:
        n = 0

        def complete(self, prompt, json_mode):
            Shaky.n += 1
            if Shaky.n < 3:
                raise TransientError("later")
            return "yes"

    df = spark.createDataFrame([("p",), ("x" * 400,), (None,)], "p string").coalesce(1)
    got = {r.p and r.p[:1]: (r.a, r.a_error) for r in answered(df, "p", "a", Shaky, Settings(budget=50, least_wait=0, most_wait=0)).collect()}
    assert got == {"p": ("yes", None), "x": (None, "prompt exceeds the budget"), None: (None, None)}
    for wrong in ({"threshold": 2}, {"mode": "x"}, {"attempts": 0}):
        with pytest.raises(ValueError):
            Settings(**wrong)


@pytest.mark.parametrize(
    ("change", "error"),
    [({}, None), ({"prediction": "?"}, "invalid prediction"), ({"key_findings": ["a"]}, "two or three"), ({"key_findings": list("abcd")}, "two or three"), ({"key_findings": ["a", " "]}, "two or three"), ({"conclusion": " "}, "missing")],
)
def test_final_answer(spark, change, error):
    answer = {"prediction": "benign", "malware_type": "t", "application_purpose": "p", "key_findings": ["a", "b"], "conclusion": "c"} | change
    r = validated_final(spark.createDataFrame([(json.dumps(answer),)], "a string"), "a").first()
    assert (r.error is None) == (error is None) and (error or "") in (r.error or "")
    if error is None:
        assert r.prediction == "BENIGN" and r.malware_type is None


def test_targets(spark):
    keys = spark.createDataFrame([(B, 2), (A, 1), (B, 3)], "sha256 string, ordinal int")
    assert [r.sha256 for r in splits.targets(keys).collect()] == [A.upper(), B]
    with pytest.raises(Exception, match="invalid hash"):
        splits.targets(spark.createDataFrame([("x", 1)], "sha256 string, ordinal int")).collect()
    files = spark.createDataFrame([(A, "/low"), (A.upper(), "/up")], "stem string, path string")
    assert splits.found_children(splits.targets(keys), files).where(F.col("sha256") == A.upper()).first().path == "/up"
