"""The tree of program artefacts, ``<sha256>/<api_index>/<instance>/<kind>/<name>``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.durable import exists
from quillon.functions.scalars import without_node_suffix
from quillon.sources.tree import read_tree

TABLE = "api_index int, instance string, kind string, name string, stem string, path string, content string, sha256 string"


def read_artefacts(spark: SparkSession, root: str, applications: list[str] | None = None) -> DataFrame:
    """``sha256, api_index, instance, kind, name, stem, path, content`` of all files of a tree.

    Files are read whole; ``api_index`` is null where the folder is no number. Where
    ``root`` holds the tables that ``slice`` writes, partitioned by application, these
    are read in place of single files. Where ``applications`` are named, others' folders are left out.
    """
    if exists(spark, f"{root.rstrip('/')}/sha256=*"):
        rows = spark.read.schema(TABLE).parquet(root).select("sha256", *(f.split()[0] for f in TABLE.split(", ")[:-1]))
        return rows if applications is None else rows.where(F.col("sha256").isin([k.upper() for k in applications]))
    return read_tree(spark, root, applications)


KEY = ["sha256", "api_index", "instance"]


def slice_files(artefacts: DataFrame) -> DataFrame:
    """The slices of each instance: slice graphs, then control-flow files that none of them stands for.

    A control-flow file is left out if a slice has its name, or if its stem has
    numbered call-site slices.
    """
    slices = artefacts.where("kind = 'SliceGraph'")
    cfg = artefacts.where("kind = 'cfg'")
    bases = slices.where(F.col("stem").contains("__callsite_")).select(*KEY, F.regexp_replace("stem", r"__callsite_\d+$", "").alias("stem")).distinct()
    rest = cfg.join(slices.select(*KEY, "name").distinct(), [*KEY, "name"], "left_anti").join(bases, [*KEY, "stem"], "left_anti")
    return slices.withColumn("source", F.lit(0)).unionByName(rest.select(*slices.columns).withColumn("source", F.lit(1)))


def lacking(api_index: Column) -> Column:
    """The error of an interface that the catalogue lacks."""
    return F.concat(F.lit("the catalogue lacks interface "), F.coalesce(api_index.cast("string"), F.lit("of a folder that is no number")))


def contexts(artefacts: DataFrame, catalog: DataFrame, strict: bool = True) -> DataFrame:
    """One row a slice of an instance that has a call graph and slices: graph texts, interface, relation text.

    Relations are null where no relation file is. An interface that the catalogue
    lacks is an error when the rows are read, or has a null ``signature`` where
    ``strict`` is off; the catalogue joins by hash or, if it is small enough for the
    session's bound, by broadcast.
    """
    calls = artefacts.where("kind = 'CallGraph'").groupBy(*KEY).agg(F.min(F.struct("path", "content")).alias("c")).select(*KEY, without_node_suffix(F.col("c.content")).alias("call_graph"))
    relations = artefacts.where("kind = 'Relation'").select(*KEY, "stem", F.col("content").alias("relations"))
    found = slice_files(artefacts).join(calls, KEY).join(relations, [*KEY, "stem"], "left")
    named = found.join(catalog.select("api_index", "signature", "permissions"), "api_index", "left")
    known = F.coalesce("signature", F.raise_error(lacking(F.col("api_index")))) if strict else F.col("signature")
    return named.withColumn("signature", known).withColumn("graph", without_node_suffix(F.col("content"))).drop("content")


def unfit(artefacts: DataFrame, catalog: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """``sha256, error``: applications that cannot be analyzed, with the first thing that is wrong with them.

    That is a call graph of an interface that the catalogue lacks or, among the rows of
    ``relations`` (sha256, problem), a problem. One of them leaves other applications alone.
    """
    unknown = artefacts.where("kind = 'CallGraph'").select("sha256", "api_index").distinct().join(catalog.select("api_index"), "api_index", "left_anti")
    found = unknown.select("sha256", F.struct(F.lit(0).alias("k"), lacking(F.col("api_index")).alias("error")).alias("e"))
    if relations is not None:
        found = found.unionByName(relations.where("problem IS NOT NULL").select("sha256", F.struct(F.lit(1).alias("k"), F.col("problem").alias("error")).alias("e")))
    return found.groupBy("sha256").agg(F.min("e").alias("e")).select("sha256", "e.error")


def inspection(found: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts of interfaces, call graphs, slices, and slices with a relation file."""
    return found.groupBy(*(by or [])).agg(
        F.countDistinct("sha256", "api_index").alias("apis"),
        F.countDistinct(*KEY).alias("call_graphs"),
        F.count("*").alias("slices"),
        F.count("relations").alias("relation_files"),
    )
