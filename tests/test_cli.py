import json

import pytest
from test_sources import A, B, tree, write  # noqa: F401  tree is a fixture

from quillon import cli


def test_verbs(spark, tree, tmp_path, capsys):  # noqa: F811
    catalog = write(tmp_path / "m.csv", "API,Index,Permissions\na.B.f,0,[]\n")
    assert cli.main(["inspect", "--graphs", tree, "--catalog", catalog]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["slices"] == 3
    out = str(tmp_path / "res")
    for mode in ("full", "flat", "no-verification"):
        assert cli.main(["analyze", "--graphs", tree, "--catalog", catalog, "--output", out, "--mode", mode]) == 0
        (row,) = spark.read.json(f"{out}/results").collect()
        assert row.prediction in ("MALWARE", "BENIGN") and row.sha256 == A.upper() and row["mode"] == mode
    split = write(tmp_path / "s.csv", f"sha256,label\n{A},1\n{B},0\n")
    write(tmp_path / "l" / f"{A}.log", "Final Prediction: MALWARE")
    assert cli.main(["evaluate", "--split", split, "--logs", str(tmp_path / "l"), "--allow-missing"]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["true_positive"] == 1
    assert cli.main(["evaluate", "--split", write(tmp_path / "bad.csv", "sha256,label\nx,1\n"), "--logs", str(tmp_path / "l")]) == 2
    assert cli.main(["doctor"]) == 0


def test_splits_of_a_folder(spark, tmp_path):
    write(tmp_path / "test_1.csv", f"sha256,label\n{B},0\n")
    write(tmp_path / "train.csv", f"sha256,label\n{A},1\n")
    write(tmp_path / "other.txt", f"sha256,label\n{'c' * 64},1\n")
    write(tmp_path / "test_ood_2.txt", "not a split")

    def arguments(*more):
        return cli.parser().parse_args(["analyze", "--graphs", "g", "--catalog", "c", "--output", "o", *more])

    folder = ["--split-folder", str(tmp_path)]
    assert [p.rsplit("/", 1)[1] for p in cli._labelled(spark, arguments(*folder))] == ["train.csv", "test_1.csv"]
    a = arguments(*folder, "--split-names", "other.txt", "none.txt")
    a.splits = cli._labelled(spark, a)
    a.split_folder = None
    there = spark.createDataFrame([(A.upper(),)], "sha256 string")
    assert [r.sha256 for r in cli._chosen(spark, a, there).collect()] == [A.upper(), B.upper(), "C" * 64]
    with pytest.raises(ValueError, match="not both"):
        cli._labelled(spark, arguments(*folder, "--splits", "x.csv"))
    with pytest.raises(ValueError, match="no splits"):
        cli._labelled(spark, arguments("--split-folder", str(tmp_path / "empty")))
