import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.functions import relations as R
from quillon.functions import scalars as S


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    ("line", "expected"),
    [
        ("[Direct] $r1", ("Direct", ["$r1"])),
        ("  [TRANSITIVE]  r3 ", ("Transitive", ["r3"])),
        ("[Inheritance] r5 <- r6", ("Derived", ["r5", "r6"])),
        ("[Parallel] r3 and r1 and r1 and $r2 work together", ("Parallel", ["$r2", "r1", "r3"])),
        ("[Parallel] a and b", ("Parallel", ["a", "b"])),
        ("[Direct] $r7[$i0]", ("Direct", ["$r7[$i0]"])),
        ("[Direct] $r2[0]", ("Direct", ["$r2[0]"])),
        ("[Parallel] r1 and r1 work together", None),
        ("[Derived] r1", None),
        ("[Odd] r1", None),
        ("[Direct] <C: int f>", None),
        ("no relation", None),
    ],
)
def test_parsed_line(spark, line, expected):
    r = one(spark, line, R.parsed_line)
    assert (None if r is None else (r.kind, r.variables)) == expected


def test_static_set_is_strict_and_skips_blank_lines(spark):
    assert [tuple(x.variables) for x in one(spark, "[Direct] a\n\n[Direct] a\n[Derived] b <- a", R.static_set)] == [("b", "a"), ("a",)]
    assert one(spark, "", R.static_set) == []
    with pytest.raises(Exception, match="malformed relation at line 2"):
        one(spark, "[Direct] a\n[Bad] b", R.static_set)


names = st.from_regex(r"\A\$?[a-z][0-9]{1,2}\Z")
some_relations = st.lists(
    st.one_of(
        st.tuples(st.sampled_from(["Direct", "Transitive", "Conditional"]), st.lists(names, min_size=1, max_size=1)),
        st.tuples(st.just("Derived"), st.lists(names, min_size=2, max_size=2)),
        st.tuples(st.just("Parallel"), st.lists(names, min_size=2, max_size=4, unique=True).map(sorted)),
    ),
    min_size=1,
    max_size=12,
)


@settings(max_examples=10, deadline=None)
@given(some_relations)
def test_format_and_parse_are_inverse(spark, given_):
    df = spark.createDataFrame([([{"kind": k, "variables": v} for k, v in given_],)], f"r array<{R.RELATION}>")
    back = df.select(R.static_set(R.file_text(F.col("r"))).alias("b")).first().b
    assert {(x.kind, tuple(x.variables)) for x in back} == {(k, tuple(v)) for k, v in given_}


@pytest.mark.parametrize(
    ("selected", "expected", "metrics"),
    [([], [], (0, 1, 1, 1)), ([], ["a"], (0, 0, 0, 0)), (["a"], [], (0, 0, 1, 0)), (["a", "b"], ["a"], (1, 0.5, 1, 2 / 3)), (["a"], ["a", "b"], (1, 1, 0.5, 2 / 3))],
)
def test_coverage_edges(spark, selected, expected, metrics):
    m = spark.createDataFrame([(selected, expected)], "s array<string>, e array<string>").select(R.coverage(F.col("s"), F.col("e")).alias("m")).first().m
    assert (m.matches, m.drc, m.recall, m.f1) == pytest.approx(metrics)


def test_model_items(spark):
    items = '[{"type":"direct","variable":"r1"},{"type":"Parallel","variables":["b","a"]},{"type":"Parallel","left":"a","right":"a"},{"type":"Derived","target":"a"},{"type":"Direct","variable":"1.5"}]'
    df = spark.createDataFrame([(items,)], "v string").select(F.from_json("v", f"array<{R.MODEL_ITEM}>").alias("i"))
    r = df.select(R.model_set(F.col("i")).alias("good"), R.model_invalid(F.col("i")).alias("bad")).first()
    assert [(x.kind, x.variables) for x in r.good] == [("Direct", ["r1"]), ("Parallel", ["a", "b"])]
    assert [x["index"] for x in r.bad] == [2, 3, 4]


def test_relation_json(spark):
    df = spark.createDataFrame([([{"kind": "Derived", "variables": ["a", "b"]}, {"kind": "Direct", "variables": ["c"]}],)], f"r array<{R.RELATION}>")
    assert df.select(F.transform("r", R.as_json).alias("j")).first().j == ['{"type":"Derived","target":"a","source":"b"}', '{"type":"Direct","variable":"c"}']


@pytest.mark.parametrize(
    ("cell", "expected"),
    [("", []), ("[]", []), ("['Permission:X', \"Y\", ' ']", ["X", "Y"]), ("'X'", ["X"]), ("plain text", ["plain text"]), ("[broken", ["[broken"]), (None, []), ("('A',)", ["A"])],
)
def test_permission_list(spark, cell, expected):
    assert one(spark, cell, S.permission_list) == expected


def test_scalars(spark):
    assert one(spark, "", S.token_estimate) == 1
    assert one(spark, "äbc", S.token_estimate) == 2
    assert one(spark, " x---12 y---3 ", S.without_node_suffix) == "x y"
    assert one(spark, "<a.B: void f(int)>", S.signature_key) == "a.B: void f"
    assert one(spark, "x\n 12 \n-7\nend", S.last_integer) == -7
    assert one(spark, "none", S.last_integer) is None
    assert one(spark, '```json\n{"a": 1}\n```', S.unfenced) == '{"a": 1}'
    assert one(spark, "ab" * 32, S.sha_key) == "AB" * 32
    assert one(spark, "ab", S.sha_key) is None
    assert [one(spark, v, S.binary_label) for v in ("1.0", "0", "0.5", "", "nan", None)] == [1, 0, None, None, None, None]
    assert one(spark, "/a/b.c/d.e.dot", S.stem) == "d.e"


def test_strict_model_set_and_what_is_wrong(spark):
    items = '[{"type":"direct","variable":"r1"},{"type":"odd","variable":"r1"},{"type":"Parallel","left":"a","right":"a"},{"type":"Derived","target":"a"}]'
    df = spark.createDataFrame([(items,)], "v string").select(F.from_json("v", f"array<{R.MODEL_ITEM}>").alias("i"))
    bad = df.select(R.model_invalid(F.col("i")).alias("b")).first().b
    assert [(x["index"], x.error) for x in bad] == [(1, "unknown kind odd"), (2, "two or more different variables are needed"), (3, "a target and a source are needed")]
    with pytest.raises(Exception, match="malformed relationship 1: unknown kind odd"):
        df.select(R.model_set_strict(F.col("i"))).collect()
    good = df.select(R.model_set_strict(F.slice("i", 1, 1)).alias("g")).first().g
    assert [(x.kind, x.variables) for x in good] == [("Direct", ["r1"])]


def test_outer_white_space_of_graph_text_goes(spark):
    assert one(spark, "\n\t a---1\n -> b---2 \n\t", S.without_node_suffix) == "a\n -> b"
