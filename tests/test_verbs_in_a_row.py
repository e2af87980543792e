"""From program tables to slices, verdicts and scores, with broken applications among good ones."""

import json

import pytest
from test_slicing import CALLS, frames, program
from test_sources import write

from quillon import cli
from quillon.operators.ordering import batched_by_budget

GOOD, HARMLESS, BAD_RELATION, UNKNOWN, OVERSIZE, NO_SLICES = (c * 64 for c in "ABCDEF")


@pytest.fixture(scope="module")
def sliced_tree(spark, tmp_path_factory):
    """The exported files of six programs, three of them broken by hand."""
    at = tmp_path_factory.mktemp("verbs")
    programs = [program(spark, sha, 100 * k) for k, sha in enumerate((GOOD, HARMLESS, BAD_RELATION, UNKNOWN, OVERSIZE))]
    programs.append({**program(spark, NO_SLICES, 900), "calls": ([], CALLS)})
    for n, df in frames(spark, *programs).items():
        df.write.parquet(str(at / "program" / n))
    listed = write(at / "apis.txt", "Los/Sms;->send\n")
    assert cli.main(["slice", "--program", str(at / "program"), "--output", str(at / "out"), "--api-list", listed, "--export", str(at / "tree")]) == 0
    tree = at / "tree"
    for f in tree.rglob(".*.crc"):
        f.unlink()  # the files are changed by hand
    for f in (tree / HARMLESS).rglob("*.dot"):
        f.write_text(f.read_text().replace("send", "show"))
    next((tree / BAD_RELATION).rglob("Relation/*.txt")).write_text("[Direct] r1\n[Nonsense r2\n")
    (tree / UNKNOWN / "0").rename(tree / UNKNOWN / "77")
    graph = next((tree / OVERSIZE).rglob("CallGraph/*.dot"))
    graph.write_text(graph.read_text() + "// " + "x" * 9000)
    write(at / "m.csv", "API,Index,Permissions\nos.Sms.send,0,\"['Permission:SEND']\"\n")
    write(at / "split.csv", "sha256,label\n" + "".join(f"{k},{int(k != HARMLESS)}\n" for k in (GOOD, HARMLESS, BAD_RELATION, UNKNOWN, OVERSIZE)))
    return at


FAILING = {
    "full": {BAD_RELATION: "malformed relation at line 2", UNKNOWN: "the catalogue lacks interface 77", OVERSIZE: "one function alone exceeds the budget"},
    "no-verification": {UNKNOWN: "the catalogue lacks interface 77", OVERSIZE: "one function alone exceeds the budget"},
    "flat": {UNKNOWN: "the catalogue lacks interface 77", OVERSIZE: "prompt exceeds the budget"},
}


class Watchful:
    """Flags what sends."""

    def complete(self, prompt, json_mode):
        if "TASK: interface" in prompt or not json_mode:
            return "it sends messages" if "send(" in prompt or "it sends" in prompt else "harmless"
        if "TASK: function" in prompt:
            return json.dumps({"functionPurpose": "it sends messages" if "send(" in prompt.split("CODE:")[1] else "harmless", "controlFlowAnalysis": "plain", "relationships": [{"type": "Direct", "variable": "r2"}]})
        hit = "it sends" in prompt or "send(" in prompt
        return json.dumps({"prediction": "MALWARE" if hit else "BENIGN", "malware_type": "sender" if hit else None, "application_purpose": "a", "key_findings": ["x", "y"], "conclusion": "c"})


@pytest.mark.parametrize("mode", ["full", "no-verification", "flat"])
def test_failures_stay_with_their_application_and_results_are_scored(spark, sliced_tree, tmp_path, capsys, mode):
    at, out = sliced_tree, tmp_path / "res"
    judge = ["analyze", "--graphs", str(at / "tree"), "--catalog", str(at / "m.csv"), "--output", str(out), "--mode", mode, "--budget", "2000", "--splits", str(at / "split.csv"), "--model", "test_verbs_in_a_row:Watchful"]
    assert cli.main(judge) == 1
    failed = {r.sha256: r.error for r in spark.read.json(f"{out}/failures").collect()}
    assert failed == FAILING[mode]
    rows = {r.sha256: r for r in spark.read.json(f"{out}/results").collect()}
    assert set(rows) == {GOOD, HARMLESS, BAD_RELATION} - set(failed)
    assert rows[GOOD].prediction == "MALWARE" and rows[HARMLESS].prediction == "BENIGN" and rows[GOOD].true_label == 1
    capsys.readouterr()
    score = ["evaluate", "--split", str(at / "split.csv"), "--results", f"{out}/results"]
    assert cli.main(score) == 2  # some have no prediction
    assert cli.main([*score, "--allow-missing", "--json"]) == 0
    report = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert (report["missing"], report["true_positive"], report["true_negative"], report["f1"]) == (len(failed), 4 - len(failed), 1, 1.0)
    if mode == "flat":  # a second run has only the failed ones to do, and keeps the others' results
        assert cli.main(judge) == 1
    assert {r.sha256: r.prediction for r in spark.read.json(f"{out}/results").collect()} == {k: r.prediction for k, r in rows.items()}


def test_inputs_that_are_not_there_are_status_2(spark, tmp_path, capsys):
    split = write(tmp_path / "s.csv", f"sha256,label\n{GOOD},1\n")
    assert cli.main(["evaluate", "--split", split, "--results", str(tmp_path / "none")]) == 2
    assert cli.main(["inspect", "--graphs", str(tmp_path / "none"), "--catalog", split]) == 2
    assert capsys.readouterr().err.count("error: ") == 2


def test_an_oversize_item_is_marked_and_the_rest_is_batched(spark):
    rows = spark.createDataFrame([(g, o, s) for g, sizes in enumerate(([9], [2, 2, 9, 2], [1, 1, 1])) for o, s in enumerate(sizes)], "g int, o int, s int")
    got = {(r.g, r.o): (r.batch, r.big) for r in batched_by_budget(rows, ["g"], ["o"], "s", 5, oversize="big").collect()}
    assert {k for k, (_, big) in got.items() if big} == {(0, 0), (1, 2)}
    assert got[1, 0][0] == got[1, 1][0] and len({got[2, o][0] for o in range(3)}) == 1 and len(got) == 8
