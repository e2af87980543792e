"""Where results go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.durable import exists, remove

from quillon.functions.relations import formatted
from quillon.operators.ordering import first_wins, last_wins


def write_results(results: DataFrame, path: str) -> None:
    """One JSON folder a key; only the keys of ``results`` are replaced."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sha256").json(path)


def append_cache(results: DataFrame, path: str) -> None:
    """Keeps what was computed; entries with an error are computed again another time."""
    results.where("NOT cached AND error IS NULL").drop("cached").write.mode("append").parquet(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame | None:
    """What was kept, without files that cannot be read; None before the first time."""
    return spark.read.option("ignoreCorruptFiles", True).option("mergeSchema", False).parquet(path) if exists(spark, f"{path}/*.parquet") else None


def write_artefacts(files: DataFrame, report: DataFrame, root: str) -> None:
    """Files as a table partitioned by application; samples of the report that have none now lose what they had."""
    files.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sha256").parquet(root)
    for row in report.where("status IN ('zero-slice', 'error')").select("sha256").toLocalIterator():
        remove(files.sparkSession, f"{root.rstrip('/')}/sha256={row.sha256}")


def write_dead_letters(failed: DataFrame, path: str) -> None:
    """Failures of this run in place of those of the last; an empty folder after a clean run."""
    failed.write.mode("overwrite").json(path)


def write_report(rows: DataFrame, path: str) -> None:
    """Slicing results in the order of their files, the order of the parts being that of the rows."""
    rows.orderBy("apk").write.mode("overwrite").json(path)


def dot_text(edges: DataFrame, by: list[str]) -> DataFrame:
    """Edges as DOT text, one a group; nodes without an edge are not drawn."""
    line = F.concat(F.lit('"'), F.col("src"), F.lit('" -> "'), F.col("dst"), F.lit('";'))
    return edges.groupBy(*by).agg(F.concat(F.lit("digraph {\n"), F.array_join(F.array_sort(F.collect_set(line)), "\n"), F.lit("\n}\n")).alias("text"))


def graph_files(texts: DataFrame, key: list[str], order: str) -> DataFrame:
    """Graph files are written once: of several texts for a name the first stays."""
    return first_wins(texts, key, [order])


def relation_files(relations: DataFrame, key: list[str], order: str) -> DataFrame:
    """Relation files are written anew: of several writes (``order``) for a name the last stays, as sorted lines."""
    written = relations.groupBy(*key, order).agg(F.array_join(F.array_sort(F.collect_set(formatted(F.col("relation")))), "\n").alias("text"))
    return last_wins(written, key, [order])
