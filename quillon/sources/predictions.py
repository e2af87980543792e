"""Stored verdicts and slicing reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.durable import exists
from quillon.functions.scalars import HASH, last_match, stem

#: How logs state a verdict (a fixed value).
LEGACY = r"(?i)Final Prediction:\s*(?:\*\*)?(MALWARE|BENIGN)(?:\*\*)?"


def read_results(spark: SparkSession, folder: str, strict: bool = True) -> DataFrame:
    """``sha256, prediction`` (0 or 1) of the results of a folder.

    A folder that ``analyze`` writes is partitioned by application, and the partition
    says whose result it is. Other folders hold a JSON file an application, named by
    its hash; folders below them are not read.
    """
    root = folder.rstrip("/")
    if exists(spark, f"{root}/sha256=*"):
        named = spark.read.schema("prediction string, sha256 string").json(root).withColumn("stem", F.upper("sha256"))
    else:
        raw = spark.read.option("multiLine", True).schema("prediction string, sha256 string").json(f"{root}/*.json")
        named = raw.select("*", F.upper(stem(F.col("_metadata.file_name"))).alias("stem"))
    key, said = F.upper(F.coalesce("sha256", "stem")), F.upper(F.coalesce("prediction", F.lit("")))
    checked = named.select(
        key.alias("sha256"),
        F.when(said == "MALWARE", 1).when(said == "BENIGN", 0).alias("prediction"),
        F.when(~said.isin("MALWARE", "BENIGN"), "invalid prediction").when(~key.rlike(HASH), "invalid hash").when(key != F.col("stem"), "hash is not the file's name").alias("problem"),
    )
    if strict and (bad := checked.where("problem IS NOT NULL").head(3)):
        raise ValueError(f"{folder}: {[(b['sha256'], b['problem']) for b in bad]}")
    if strict and (again := checked.groupBy("sha256").count().where("count > 1").head(3)):
        raise ValueError(f"{folder}: {[(b['sha256'], 'repeated hash') for b in again]}")
    return checked.where("problem IS NULL").drop("problem")


def read_logs(spark: SparkSession, folder: str) -> DataFrame:
    """``sha256, prediction`` of text logs: the last verdict counts, logs without one are left out."""
    raw = spark.read.text(f"{folder.rstrip('/')}/*.log", wholetext=True).select("value", F.upper(stem(F.col("_metadata.file_name"))).alias("sha256"))
    return raw.withColumn("said", F.upper(last_match(F.col("value"), LEGACY))).where("said IS NOT NULL").select("sha256", (F.col("said") == "MALWARE").cast("int").alias("prediction"))


def to_do(keys: DataFrame, done: DataFrame, config: dict[str, object] | None = None, overwrite: bool = False) -> DataFrame:
    """Keys without a result; a result of another configuration is an error unless it is overwritten."""
    if overwrite:
        return keys
    if config:
        same = None
        for name, value in config.items():
            equal = F.col(name).eqNullSafe(F.lit(value))
            same = equal if same is None else same & equal
        if bad := done.join(keys, "sha256", "left_semi").where(~same).head(3):
            raise ValueError(f"results of another configuration: {[b['sha256'] for b in bad]}")
    return keys.join(done.select("sha256"), "sha256", "left_anti")


def read_slicing_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("apk string, status string, slice_count long, duration_seconds double, error string").json(path)
