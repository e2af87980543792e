"""Labelled splits, interface catalogues and lists, and analysis targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.scalars import binary_label, cleaned, dotted, permission_list, sha_key
from quillon.operators.evaluation import merged_labels

#: File names of splits in their order (fixed values).
SPLIT_NAMES = ("train.csv", "test_1.csv", "test_2.csv", "test_3.csv")


def table_of(spark: SparkSession, path: str, required: set[str]) -> DataFrame:
    """A CSV file with a header, all cells as trimmed text; names and cells lose outer spaces and a byte-order mark.

    A row with more cells than the header keeps them in ``_extra``; missing ones are
    empty. ``_ordinal`` is the row's place, whatever tasks read the file in parts.
    """
    lines = spark.read.option("header", True).option("inferSchema", False).option("enforceSchema", False)
    raw = lines.csv(path)
    names = [c.replace("﻿", "").strip() for c in raw.columns]
    if missing := required - set(names):
        raise ValueError(f"{path} lacks the columns {sorted(missing)}; it has {sorted(names)}")
    schema = ", ".join(f"`{c}` string" for c in [*names, "_extra"])
    rows = spark.read.option("header", True).option("enforceSchema", True).option("columnPruning", False).option("columnNameOfCorruptRecord", "_extra").schema(schema).csv(path)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    cells = F.regexp_count(F.regexp_replace("_extra", '"[^"]*"', ""), F.lit(",")) + 1  # short rows are kept as well
    return rows.select(*(cleaned(F.col(f"`{c}`")).alias(c) for c in names), F.when(cells > len(names), F.col("_extra")).alias("_extra"), place.alias("_ordinal"))


def split_violations(rows: DataFrame) -> DataFrame:
    """``sha256, problem``: what makes a split invalid; empty for a valid one."""
    key, label = sha_key(F.col("sha256")), binary_label(F.col("label"))
    problem = F.when(F.col("_extra").isNotNull(), "extra cells").when(key.isNull(), "invalid hash").when(label.isNull(), "label is not binary")
    repeated = rows.groupBy(key.alias("sha256")).count().where("sha256 IS NOT NULL AND count > 1").select("sha256", F.lit("repeated hash").alias("problem"))
    return rows.select("sha256", problem.alias("problem")).where("problem IS NOT NULL").unionByName(repeated)


def read_split(spark: SparkSession, path: str, strict: bool = True, ordinal: str | None = None) -> DataFrame:
    """``sha256, label, family, date, vt_scan_date`` of a split; dates stay text. ``ordinal`` names a column with the place in the file."""
    rows = table_of(spark, path, {"sha256", "label"})
    if strict and (bad := split_violations(rows).head(3)):
        raise ValueError(f"{path}: {[tuple(b) for b in bad]}")
    text = [(F.col(c) if c in rows.columns else F.lit("")).alias(c) for c in ("family", "date", "vt_scan_date")]
    place = [F.col("_ordinal").alias(ordinal)] if ordinal else []
    return rows.select(sha_key(F.col("sha256")).alias("sha256"), binary_label(F.col("label")).alias("label"), *text, *place)


def read_labels(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``sha256, label`` of several splits; a key that they label differently is an error."""
    labels = merged_labels(*(read_split(spark, p) for p in paths))
    if bad := labels.where("conflict").head(3):
        raise ValueError(f"conflicting labels: {[b['sha256'] for b in bad]}")
    return labels.drop("conflict")


def existing(spark: SparkSession, folder: str, names: tuple[str, ...] = SPLIT_NAMES) -> list[str]:
    """Paths of those names that the folder has, in their order, on any file system that Spark reads."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for n in names:
        at = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{n}")
        out += sorted(f.getPath().toString() for f in at.getFileSystem(conf).globStatus(at) or ())
    return out


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """``api_index, signature, permissions``; the index is a whole number and unique."""
    rows = table_of(spark, path, {"API", "Index", "Permissions"})
    out = rows.select(F.col("Index").try_cast("int").alias("api_index"), F.col("API").alias("signature"), permission_list(F.col("Permissions")).alias("permissions"))
    if out.where("api_index IS NULL").head(1):
        raise ValueError(f"{path}: an index is not a whole number")
    if bad := out.groupBy("api_index").count().where("count > 1").head(3):
        raise ValueError(f"{path}: repeated indices {[b['api_index'] for b in bad]}")
    return out


def read_api_list(spark: SparkSession, path: str) -> DataFrame:
    """``api_index, class, method`` of a list with one ``class;->method`` a line; the line number from 0 is the index."""
    whole = spark.read.text(path, wholetext=True)
    lines = whole.select(F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")).alias("api_index", "line"))
    parts = F.split(dotted(F.col("line")), ";->", 2)
    out = lines.select("api_index", F.regexp_replace(F.get(parts, F.lit(0)), "^L", "").alias("class"), F.get(parts, F.lit(1)).alias("method"))
    if bad := out.where("coalesce(class, '') = '' OR coalesce(method, '') = ''").head(3):
        raise ValueError(f"{path}: malformed lines {[b['api_index'] for b in bad]}")
    return out


def targets(keys: DataFrame, key: str = "sha256", order: str = "ordinal", limit: int | None = None) -> DataFrame:
    """Valid keys in upper case, in their order, each once; an invalid one is an error when it is read."""
    from quillon.operators.ordering import ordered_distinct

    checked = keys.select(F.coalesce(sha_key(F.col(key)), F.raise_error(F.concat(F.lit("invalid hash: "), F.col(key)))).alias("sha256"), order)
    return ordered_distinct(checked, "sha256", [order], limit)


def found_children(keys: DataFrame, files: DataFrame) -> DataFrame:
    """Keys with the file of that stem in any case; upper-case names come before others."""
    named = files.withColumn("sha256", F.upper("stem")).withColumn("__rank", (F.col("stem") != F.upper("stem")).cast("int"))
    best = named.groupBy("sha256").agg(F.min(F.struct("__rank", "path")).alias("f")).select("sha256", "f.path")
    return keys.join(best, "sha256", "left")
