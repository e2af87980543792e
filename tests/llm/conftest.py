import pytest

#: Null and empty texts, white space, ties, repeated rows, a long text, and columns named as the operators' own.
LONG = " ".join(f"word{k * 7919 % 10007} of{k % 13}" for k in range(30_000))
ODD = [
    (1, "one two three four five six seven eight nine ten", "a"),
    (1, "one two three four five six seven eight nine ten", "a"),
    (2, "one two three four five six seven eight nine ten", None),
    (3, None, "b"),
    (4, "", "b"),
    (5, " \n\t \n", "b"),
    (6, LONG, "c"),
    (7, "\n".join(["the same line of words again"] * 3) + "\n\n" + "été ÉTÉ straße \U0001f600 x", "c"),
    (8, "one two three four five six seven eight nine ten", "a"),
    (None, "a text without an id but with words enough", "a"),
]
CLASH = ["verdict", "hits", "removed", "fingerprint", "doc", "spans", "first", "component_id", "licenses", "secrets", "language", "Main"]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd documents with clashing columns."""
    rows = [(*r, *[f"{c}!" for c in CLASH]) for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in CLASH)).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
