"""Slices from interface lists to verdicts, and the walk through callers against a plain one."""

import json
import random
import sys
import time

import pytest
from test_sources import A, B, write

from pyspark import cloudpickle
from pyspark.sql import functions as F

from quillon import cli
from quillon.operators import contexts, slicing
from quillon.operators.blocks import basic_blocks
from quillon.sources import artefacts

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the slow walk below runs in tasks
METHOD = "method_id long, sha256 string, class string, name string, signature string, n_params int, has_body boolean"
UNIT = "method_id long, unit_id long, ordinal int, kind string, invoked string, text string"
REF = "unit_id long, role string, ordinal int, value string, is_local boolean, base string"
CFG = "method_id long, src long, dst long, ordinal int"
CALLS = "src long, dst long, ordinal int"


def program(spark, sha=A, base=0):
    """``f`` and ``g`` call the listed send(int); h calls f; k names send but calls another overload; e has no body."""
    m = [(1, "f", 1, True), (2, "g", 0, True), (3, "h", 0, True), (4, "k", 0, True), (5, "e", 0, False)]
    method = [(base + i, sha, "app.C", n, f"<app.C: void {n}({'int' if p else ''})>", p, b) for i, n, p, b in m]
    method += [(base + 8, sha, "os.Sms", "send", "<os.Sms: void send(int)>", 1, False), (base + 9, sha, "os.Sms", "send", "<os.Sms: void send()>", 0, False)]
    send, other = "<os.Sms: void send(int)>", "<os.Sms: void send()>"
    unit = [
        (1, 10, 0, "identity", None, "r1 := @parameter0: int"), (1, 11, 1, "assign", None, "r2 = r1 + 1"), (1, 12, 2, "if", None, "if r3 goto next"), (1, 13, 3, "assign", None, "r5 = 0"),
        (1, 14, 4, "invoke", send, "send(r2)"), (1, 15, 5, "return", None, "return"),
        (2, 20, 0, "assign", None, "r1 = 7"), (2, 21, 1, "invoke", send, "send(r1)"), (2, 22, 2, "invoke", send, "send(r1)"),
        (3, 30, 0, "assign", None, "r4 = 3"), (3, 31, 1, "invoke", "<app.C: void f(int)>", "f(r4)"),
        (4, 40, 0, "invoke", other, "send()"),
    ]
    ref = [
        (10, "def", 0, "r1", True, None), (10, "use", 0, "@parameter0: int", False, None), (11, "def", 0, "r2", True, None), (11, "use", 0, "r1", True, None), (12, "use", 0, "r3", True, None), (13, "def", 0, "r5", True, None),
        (14, "use", 0, "r2", True, None), (14, "arg", 0, "r2", True, None), (20, "def", 0, "r1", True, None), (21, "use", 0, "r1", True, None), (21, "arg", 0, "r1", True, None), (22, "use", 0, "r1", True, None), (22, "arg", 0, "r1", True, None),
        (30, "def", 0, "r4", True, None), (31, "use", 0, "r4", True, None), (31, "arg", 0, "r4", True, None),
    ]
    cfg = [(1, 10, 11, 0), (1, 11, 12, 0), (1, 12, 13, 0), (1, 12, 14, 1), (1, 13, 14, 0), (1, 14, 15, 0), (2, 20, 21, 0), (2, 21, 22, 0), (3, 30, 31, 0)]
    calls = [(1, 8, 0), (2, 8, 1), (4, 9, 2), (5, 8, 3), (3, 1, 4)]
    b = base * 100
    return {
        "method": (method, METHOD),
        "unit": ([(base + m_, b + u, *rest) for m_, u, *rest in unit], UNIT),
        "ref": ([(b + u, *rest) for u, *rest in ref], REF),
        "cfg": ([(base + m_, b + x, b + y, o) for m_, x, y, o in cfg], CFG),
        "calls": ([(base + x, base + y, o) for x, y, o in calls], CALLS),
    }


def frames(spark, *programs):
    return {n: spark.createDataFrame([r for p in programs for r in p[n][0]], programs[0][n][1]) for n in programs[0]}


def test_instances_of_an_interface(spark):
    t = frames(spark, program(spark))
    features = spark.createDataFrame([(3, "os.Sms", "send"), (4, "os.Sms", "nothing")], "api_index int, class string, name string")
    roots = slicing.interface_roots(features, t["method"], t["unit"], t["calls"])
    # the first overload by call order is searched; k calls another one, e has no body
    assert {tuple(r) for r in roots.select("api_index", "instance", "method_id", "signature").collect()} == {(3, 0, 1, "<os.Sms: void send(int)>"), (3, 1, 2, "<os.Sms: void send(int)>")}


def test_files_of_contexts(spark):
    t = frames(spark, program(spark), {**program(spark, "c" * 64, 100), "calls": ([], CALLS)})
    features = spark.createDataFrame([(3, "os.Sms", "send")], "api_index int, class string, name string")
    made = contexts.contexts(t["method"], t["unit"], t["ref"], t["cfg"], t["calls"], features, hops=1)
    assert {(r.sha256, r.status, r.slice_count, r.error) for r in made.report.collect()} == {(A, "ok", 2, None), ("c" * 64, "zero-slice", 0, None)}
    files = {(r.instance, r.kind, r.name): r.content for r in made.files.collect()}
    f, g, h = "app.C: void f", "app.C: void g", "app.C: void h"
    assert {(k, n) for i, k, n in files if i == "0"} == {("CallGraph", "send.dot"), *(("code", f"{m}.jimple") for m in (f, h)), *(("cfg", f"{m}.dot") for m in (f, h)), *(("SliceGraph", f"{m}.dot") for m in (f, h)), *(("Relation", f"{m}.txt") for m in (f, h))}
    assert {n for i, k, n in files if i == "1" and k == "SliceGraph"} == {f"{g}__callsite_0.dot", f"{g}__callsite_1.dot"}
    assert files["0", "CallGraph", "send.dot"] == f'digraph subgraph_ {{\n    "{f}";\n    "{h}";\n    "{h}" -> "{f}";\n}}\n'
    assert files["0", "Relation", f"{f}.txt"] == "[Conditional] r3\n[Derived] r2 <- r1\n[Direct] r2\n[Transitive] r1\n"
    assert files["0", "code", f"{f}.jimple"].split("\n")[1] == "r2 = r1 + 1"
    # r5 = 0 is not in the slice: the branch leads over it; the chain before the branch is one node
    graph = files["0", "SliceGraph", f"{f}.dot"]
    assert '"r1 := @parameter0: int---10\\nr2 = r1 + 1---11\\nif r3 goto next---12"' in graph and "r5" not in graph and graph.count("->") == 1
    cfg = files["0", "cfg", f"{f}.dot"]
    assert '"r5 = 0---1"' in cfg and cfg.count("->") == 3
    assert files["1", "SliceGraph", f"{g}__callsite_0.dot"].count("->") == 0  # two units in a chain, merged


def test_a_malformed_method_fails_its_sample_only(spark):
    good, bad = program(spark), program(spark, "c" * 64, 100)
    bad["cfg"][0].append((101, 99999, 10014, 0))  # an edge from a unit that is not there
    t = frames(spark, good, bad)
    features = spark.createDataFrame([(3, "os.Sms", "send")], "api_index int, class string, name string")
    made = contexts.contexts(t["method"], t["unit"], t["ref"], t["cfg"], t["calls"], features)
    assert {(r.sha256, r.status) for r in made.report.collect()} == {(A, "ok"), ("c" * 64, "error")}
    assert {r.sha256 for r in made.files.select("sha256").distinct().collect()} == {A}


def test_a_method_that_takes_too_long_has_an_error(spark):
    t = frames(spark, program(spark))
    packed = slicing.packed_methods(t["unit"], t["ref"], t["cfg"])
    targets = slicing.callsites(t["unit"], spark.createDataFrame([("<os.Sms: void send(int)>",)], "signature string"))
    assert {r.error.split(":")[0] for r in slicing.sliced(packed, targets, timeout=1e-12).collect()} == {"TimeoutError"}


def test_blocks(spark):
    unit = [(m, u, u) for m in (1, 2) for u in range(1, 7)] + [(3, 1, 0), (3, 9, 1)]
    flow = [(m, a, b) for m in (1, 2) for a, b in [(1, 2), (2, 3), (2, 5), (3, 4), (4, 6), (5, 6)]] + [(2, 6, 1), (2, 1, 99), (3, 1, 9), (3, 1, 9)]
    placed, edges = basic_blocks(spark.createDataFrame(unit, "method_id long, unit_id long, ordinal int"), spark.createDataFrame(flow, "method_id long, src long, dst long"))
    blocks = {}
    for r in placed.orderBy("method_id", "block", "at").collect():
        blocks.setdefault(r.method_id, {}).setdefault(r.block, []).append(r.unit_id)
    assert blocks[1] == {0: [1, 2], 1: [3, 4], 2: [5], 3: [6]}
    assert blocks[2] == {0: [1], 1: [2], 2: [3, 4], 3: [5], 4: [6]}  # an edge out of the method parts units 1 and 2
    assert blocks[3] == {0: [1], 1: [9]}  # two edges between them
    got = {(r.method_id, r.src, r.dst) for r in edges.collect()}
    assert got == {(1, 0, 1), (1, 0, 2), (1, 1, 3), (1, 2, 3), (2, 0, 1), (2, 1, 2), (2, 1, 3), (2, 2, 4), (2, 3, 4), (2, 4, 0), (3, 0, 1)}


def slow_flowing(self, target, plain=slicing.Method.flowing):
    if target > 10_000:  # of the second sample
        time.sleep(0.6)
    return plain(self, target)


def test_a_slow_sample_ends_and_the_others_go_on(spark, monkeypatch):
    monkeypatch.setattr(slicing.Method, "flowing", slow_flowing)
    t = frames(spark, program(spark), program(spark, "c" * 64, 100))
    features = spark.createDataFrame([(3, "os.Sms", "send")], "api_index int, class string, name string")
    made = contexts.contexts(t["method"], t["unit"], t["ref"], t["cfg"], t["calls"], features, timeout=1.0)
    report = {r.sha256: (r.status, r.slice_count, r.error) for r in made.report.collect()}
    assert report == {A: ("ok", 2, None), "c" * 64: ("error", None, "the time of the sample is over")}
    assert {r.sha256 for r in made.files.select("sha256").distinct().collect()} == {A}


def test_a_block_that_nothing_reaches_is_drawn(spark):
    p = program(spark)
    p["unit"][0].append((1, 16, 6, "return", None, "return late"))
    t = frames(spark, p)
    features = spark.createDataFrame([(3, "os.Sms", "send")], "api_index int, class string, name string")
    made = contexts.contexts(t["method"], t["unit"], t["ref"], t["cfg"], t["calls"], features)
    (r,) = made.files.where("kind = 'cfg' AND instance = '0' AND name LIKE '%void f%'").collect()
    assert '"return late---3"' in r.content and r.content.count("->") == 3


def walked(methods, calls, sites, root, hops):
    """Rounds over sets, in plain Python: the methods of the graph, and its edges."""
    nodes, edges, frontier = set(), set(), {(root, None)}
    left = hops
    while frontier:
        entered = {m for m, callee in frontier if callee is None or (m, callee) in sites}
        edges |= {(m, c) for m, c in frontier if c is not None and m in entered}
        nodes |= entered
        left -= 1
        up = {(s, d) for s, d in calls if d in entered and s in methods} if left >= 0 else set()
        edges |= {(s, d) for s, d in up if s in nodes}
        frontier = {(s, d) for s, d in up if s not in nodes}
    return nodes, edges


@pytest.mark.parametrize("seed", [1, 2])
def test_walk_through_callers_of_random_programs(spark, seed):
    rng = random.Random(seed)
    n = 24
    bodies = {m for m in range(n) if rng.random() < 0.85}
    calls = {(rng.randrange(n), rng.randrange(n)) for _ in range(60)}
    sites = {c for c in calls if rng.random() < 0.8}
    method = spark.createDataFrame([(m, f"<A: void m{m}()>", 0, m in bodies) for m in range(n)], "method_id long, signature string, n_params int, has_body boolean")
    unit = [(s, s * 1000 + d, d, "invoke", f"<A: void m{d}()>", "") for s, d in sites] + [(m, m * 1000 + 999, 999, "invoke", "<A: api()>", "") for m in bodies]
    none = spark.createDataFrame([], REF), spark.createDataFrame([], CFG)
    unit = spark.createDataFrame(unit, UNIT)
    roots = spark.createDataFrame([(m, m, "<A: api()>") for m in bodies], "instance long, method_id long, signature string")
    slices, edges = slicing.backward(slicing.packed_methods(unit, *none), unit, method, spark.createDataFrame(list(calls), "src long, dst long"), roots, hops=3)
    got_nodes, got_edges = {}, {}
    for r in slices.collect():
        got_nodes.setdefault(r.instance, set()).add(r.method_id)
    for r in edges.collect():
        got_edges.setdefault(r.instance, set()).add((int(r.src.split("m")[-1]), int(r.dst.split("m")[-1])))
    for root in bodies:
        nodes, drawn = walked(bodies, calls, sites, root, 3)
        assert got_nodes[root] == nodes and got_edges.get(root, set()) == drawn


def test_from_a_list_of_interfaces_to_verdicts(spark, tmp_path, capsys):
    at = tmp_path / "program"
    for n, df in frames(spark, program(spark), {**program(spark, B, 100), "calls": ([], CALLS)}).items():
        df.write.parquet(str(at / n))
    listed = write(tmp_path / "apis.txt", "Lapp/Unused;->x\nos/Sms;->send\n")
    out = str(tmp_path / "out")
    run = ["slice", "--program", str(at), "--output", out, "--api-list", listed]
    assert cli.main([*run, "--export", str(tmp_path / "tree")]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1]) == {"ok": 1, "zero-slice": 1}
    table = artefacts.read_artefacts(spark, f"{out}/artefacts")
    tree = artefacts.read_artefacts(spark, str(tmp_path / "tree"))
    assert {(r.sha256, r.kind, r.content) for r in table.collect()} == {(r.sha256, r.kind, r.content) for r in tree.collect()} and table.count() == tree.count()
    assert cli.main(run) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1]) == {"skipped": 1, "zero-slice": 1}
    assert {r.status for r in spark.read.json(f"{out}/slicing-report").collect()} == {"skipped", "zero-slice"}

    catalog = write(tmp_path / "m.csv", "API,Index,Permissions\nos.Sms.send,1,\"['Permission:SEND']\"\n")
    judge = ["analyze", "--graphs", f"{out}/artefacts", "--catalog", catalog, "--output", str(tmp_path / "res"), "--model", "test_slicing:Seeing"]
    assert cli.main(judge) == 0
    (row,) = spark.read.json(f"{tmp_path}/res/results").collect()
    assert row.prediction == "MALWARE" and row.verification_counts.revised > 0 and row.cache_hits == 0 and row.token_usage.total_tokens > 0 and row.started_at
    assert cli.main(judge) == 0  # has a result of this configuration
    assert cli.main([*judge, "--threshold", "0.9", "--refuse-others"]) == 2
    assert cli.main([*judge, "--sha256", A, B]) == 1  # no contexts for the second
    assert [r.sha256 for r in spark.read.json(f"{tmp_path}/res/failures").collect()] == [B]
    assert cli.main([*judge, "--model", "no.such:thing"]) == 2


class Seeing:
    """Flags an application whose interface prompts show call graph, permission and summaries."""

    def complete(self, prompt, json_mode):
        if "TASK: interface" in prompt:
            seen = all(x in prompt for x in ("PERMISSIONS: SEND", "CALL GRAPH:\ndigraph", '"app.C: void h" -> "app.C: void f"', "app.C: void f.dot"))
            return "all seen" if seen else "not all"
        if not json_mode:
            return "plain"
        if "TASK: function" in prompt:
            return json.dumps({"functionPurpose": "p", "controlFlowAnalysis": "c", "relationships": []})
        label = "MALWARE" if "all seen" in prompt else "BENIGN"
        return json.dumps({"prediction": label, "malware_type": None, "application_purpose": "a", "key_findings": ["x", "y"], "conclusion": "c"})


def test_split_order_limits_targets(spark, tmp_path):
    from quillon.sources import splits

    keys = [f"{k:064X}" for k in (5, 3, 9, 1)]
    path = write(tmp_path / "s.csv", "sha256,label\n" + "".join(f"{k},0\n" for k in keys))
    rows = splits.read_split(spark, path, ordinal="place")
    assert [r.sha256 for r in splits.targets(rows.withColumnRenamed("place", "ordinal"), limit=3).collect()] == keys[:3]


def test_the_branching_program_has_joins_and_loops_around_searched_calls(spark, sf_dir):
    from quillon.plans.programs import _branching

    unit, _, flow = _branching(spark, sf_dir)
    assert flow.where("dst <= src").count() > 100
    assert flow.groupBy("dst").count().where("count > 1").count() > 100
    calls = unit.where("kind = 'invoke'").select(F.col("unit_id").alias("src"))
    assert flow.join(calls, "src").count() > 100  # calls with units behind them
    assert flow.groupBy("method_id", "ordinal").count().where("count > 1").isEmpty()
