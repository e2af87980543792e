"""Neighbourhoods of many keys against one graph at a time, and as files of the command line."""

import json
import random

import pytest
from test_slicing import frames, program
from test_sources import A, B, write

from quillon import cli
from quillon.operators import neighbourhoods as N


def plain(edges, root, third, k):
    """One graph in plain Python: edges, or none where the graph is lost or falls apart."""
    seen, frontier = {root}, {root}
    for _ in range(k + 1):
        frontier = {b for e in edges for a, b in (e, e[::-1]) if a in frontier} - seen
        seen |= frontier
    kept = {(a, b) for a, b in edges if a in seen and b in seen and (a not in third or b == root)}
    ends = {x for e in kept for x in e}
    if root not in ends:
        return set()
    reach, todo = {root}, [root]
    while todo:
        at = todo.pop()
        for a, b in kept:
            for x, y in ((a, b), (b, a)):
                if x == at and y not in reach:
                    reach.add(y)
                    todo.append(y)
    return kept if reach == ends else set()


@pytest.mark.parametrize("seed,k", [(1, 0), (2, 1), (3, 2)])
def test_random_graphs(spark, seed, k):
    rng = random.Random(seed)
    graphs = {g: {(rng.randrange(14), rng.randrange(14)) for _ in range(18)} for g in "abcd"}
    third = {g: {n for n in range(14) if rng.random() < 0.3} for g in graphs}
    roots = [(g, i, rng.randrange(14)) for g in graphs for i in range(6)]
    edges = spark.createDataFrame([(g, *e) for g, es in graphs.items() for e in es], "sha256 string, src long, dst long")
    starts = spark.createDataFrame(roots, "sha256 string, api_index int, node long")
    flagged = spark.createDataFrame([(g, n) for g, ns in third.items() for n in ns], "sha256 string, node long")
    got = {tuple(r) for r in N.neighbourhoods(edges, starts, flagged, k).collect()}
    want = {(g, i, a, b) for g, i, root in roots for a, b in plain(graphs[g], root, third[g], k)}
    assert got == want and want


def test_no_graphs(spark):
    edges = spark.createDataFrame([], "sha256 string, src long, dst long")
    roots = spark.createDataFrame([("a", 0, 1)], "sha256 string, api_index int, node long")
    assert N.neighbourhoods(edges, roots, roots.select("sha256", "node").limit(0), 1).count() == 0


def test_files_from_the_command_line(spark, tmp_path, capsys):
    for n, df in frames(spark, program(spark), {**program(spark, B, 100), "calls": ([], program(spark)["calls"][1])}).items():
        if n == "method":  # h is a third party's: what it calls goes
            df = df.selectExpr("*", "name <> 'h' AS is_application")
        df.write.parquet(str(tmp_path / "program" / n))
    listed = write(tmp_path / "apis.txt", "Lapp/Unused;->x\nos/Sms;->send\n")
    run = ["slice", "--program", str(tmp_path / "program"), "--output", str(tmp_path / "out"), "--api-list", listed, "--neighbourhoods"]
    for _ in range(2):
        assert cli.main(run) == 0
        assert json.loads(capsys.readouterr().out.splitlines()[-1]) == {"ok": 1, "zero-slice": 1}
    files = {r.path: r.content for r in spark.read.parquet(f"{tmp_path}/out/neighbourhoods").collect()}
    graph = files[f"{A.upper()}/1/Subgraph/send.dot"]
    send = "<os.Sms: void send(int)>"
    assert [f'"<app.C: void {m}>" -> "{send}"' in graph for m in ("f(int)", "g()", "e()", "h()")] == [True, True, True, False]
    bodies = {p.rsplit("/", 1)[1] for p in files if "/Subgraph/functions/" in p}
    assert bodies == {"app.C: void f.jimple", "app.C: void g.jimple"}  # e has no body
    assert cli.main([x for x in run if x not in ("--api-list", listed)]) == 2
