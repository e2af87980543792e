"""Artefact trees as a data source: what is written is read back, folders are pruned, tasks write the files."""

import pytest

from quillon.sources import artefacts
from quillon.sources.tree import read_tree, write_tree

KEYS = [f"{k:064X}" for k in range(6)]
FILES = "sha256 string, path string, kind string, content string"


def rows_for(key):
    at = f"{key}/3/0"
    return [
        (key, f"{at}/CallGraph/send.dot", "CallGraph", f"graph of {key}"),
        (key, f"{at}/SliceGraph/a.C: void f.dot", "SliceGraph", "zwölf \U0001f600\nlines"),
        (key, f"{at}/Relation/a.C: void f.txt", "Relation", "[Direct] r1\n"),
        (key, f"{at}/code/a.C: void f.jimple", "code", ""),
        (key, f"{key}/77x/1/cfg/g.dot", "cfg", "no number"),
    ]


@pytest.fixture
def root(spark, tmp_path):
    files = spark.createDataFrame([r for k in KEYS for r in rows_for(k)], FILES).repartition(4)
    at = str(tmp_path / "tree")
    write_tree(files, at)
    return at


def test_round_trip(spark, root):
    got = {(r.sha256, r.api_index, r.instance, r.kind, r.name, r.stem, r.content) for r in read_tree(spark, root).collect()}
    want = set()
    for k in KEYS:
        for _, path, kind, content in rows_for(k):
            _, index, instance, _, name = path.replace(":", "_").split("/")
            want.add((k, int(index) if index.isdigit() else None, instance, kind, name, name.rsplit(".", 1)[0], content))
    assert got == want


def test_other_files_are_left_out_and_bytes_replaced(spark, root, tmp_path):
    at = tmp_path / "tree"
    (at / KEYS[0] / "3" / "0" / "notes.txt").write_text("x")
    (at / "readme").mkdir()
    (at / ("ab" * 32)).mkdir()  # a hash in lower case, without files
    (at / KEYS[2] / "3" / "0" / "CallGraph" / "bad.dot").write_bytes(b"a\xffb")
    rows = read_tree(spark, root)
    assert rows.count() == 5 * len(KEYS) + 1
    assert rows.where("name = 'bad.dot'").first().content == "a�b"


def test_folders_of_others_are_left_out(spark, root, tmp_path):
    some = artefacts.read_artefacts(spark, root, [KEYS[0].lower(), KEYS[3]]).where("kind = 'CallGraph'")
    assert some.rdd.getNumPartitions() == 2 and {r.sha256 for r in some.collect()} == {KEYS[0], KEYS[3]}
    assert read_tree(spark, root, ["none"]).count() == 0 and read_tree(spark, root).rdd.getNumPartitions() == len(KEYS)


def test_graphs_are_written_once_and_relations_anew(spark, root):
    again = [(k, p, kind, f"new {c}") for k, p, kind, c in rows_for(KEYS[0])]
    write_tree(spark.createDataFrame(again, FILES), root)
    got = {r.kind: r.content for r in read_tree(spark, root).where(f"sha256 = '{KEYS[0]}'").collect()}
    assert got["CallGraph"] == f"graph of {KEYS[0]}" and got["Relation"] == "new [Direct] r1\n" and got["code"] == "new "


def test_paths_out_of_the_tree_and_missing_columns_are_refused(spark, tmp_path):
    bad = spark.createDataFrame([("x", "../../x", "code", "c")], FILES)
    with pytest.raises(Exception, match="leads out of the tree"):
        write_tree(bad, str(tmp_path / "t"))
