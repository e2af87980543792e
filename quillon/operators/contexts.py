"""Program contexts of listed interfaces, as the files of an artefact tree.

The tables of ``slicing``, with an application's ``sha256`` in ``method``, become rows
``sha256, api_index, instance, kind, name, stem, path, content``: what the readers of
an artefact tree give. A node's label is its text and its number, which readers drop.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.durable import durable
from quillon.functions.relations import file_text
from quillon.operators import graph as G
from quillon.operators import slicing
from quillon.operators.blocks import basic_blocks

KEY = ["sha256", "api_index", "instance"]


@dataclass
class Contexts:
    """Files of the samples that have slices, and a report on all samples."""

    files: DataFrame
    report: DataFrame


def _quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'))


def dot_files(nodes: DataFrame, edges: DataFrame, by: list[str], title: str, isolated: bool = False) -> DataFrame:
    """``*by, content``: graphs as DOT text from ``*by, node, label`` and ``*by, src, dst`` (of nodes).

    Nodes without an edge are not drawn in a graph of several nodes, unless they are
    asked for with ``isolated``. A graph is that of one method or one call graph, so its
    lines are few.
    """
    drawn = nodes
    if not isolated:
        count = nodes.groupBy(*by).agg(F.count("*").alias("n_nodes"))
        ends = edges.select(*by, F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("joined", F.lit(True))
        drawn = nodes.join(count, by).join(ends, [*by, "node"], "left").where("joined OR n_nodes = 1")
    label = nodes.select(*by, "node", _quoted(F.col("label")).alias("label"))
    arrows = edges.join(label.withColumnsRenamed({"node": "src", "label": "s"}), [*by, "src"]).join(label.withColumnsRenamed({"node": "dst", "label": "d"}), [*by, "dst"])
    lines = drawn.select(*by, F.lit(0).alias("o"), F.concat(_quoted(F.col("label")), F.lit(";")).alias("line"))
    lines = lines.unionByName(arrows.select(*by, F.lit(1).alias("o"), F.concat("s", F.lit(" -> "), "d", F.lit(";")).alias("line"))).distinct()
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "line"))), lambda x: F.concat(F.lit("    "), x["line"])), "\n")
    return lines.groupBy(*by).agg(F.concat(F.lit(f"digraph {title} {{\n"), body, F.lit("\n}\n")).alias("content"))


def _labelled(text: Column, number: Column) -> Column:
    return F.concat(text, F.lit("---"), number.cast("string"))


def contexts(method: DataFrame, unit: DataFrame, ref: DataFrame, cfg: DataFrame, calls: DataFrame, features: DataFrame, hops: int = 1, timeout: float | None = None) -> Contexts:
    """Slices of all callers of the listed interfaces, up through their callers, as files.

    A sample without slices has no files. One with an error has none either, and the
    error in its report: ``sha256, status`` (ok, zero-slice, error), ``slice_count`` (instances
    over all interfaces), ``duration_seconds, error``. ``timeout`` bounds the seconds that all
    slices of a sample take; a sample that needs more has an error, others go on.
    """
    roots = durable(slicing.interface_roots(features, method, unit, calls))
    named = roots.withColumn("instance_id", F.concat_ws("/", *KEY))
    packed = slicing.packed_methods(unit, ref, cfg)
    slices, edges = slicing.backward(packed, unit, method, calls, named.select(F.col("instance_id").alias("instance"), "method_id", "signature"), hops, timeout=timeout, owner=F.substring_index("instance", "/", 1))
    part = F.split("instance", "/")
    key = [part[0].alias("sha256"), part[1].cast("int").alias("api_index"), part[2].alias("instance")]
    found = durable(slices.select(*key, "method_id", F.col("key").alias("method_key"), "name", "relations", "slice", "graph", "seconds", "error"))

    over = F.when(F.sum("seconds") > timeout, "the time of the sample is over") if timeout else F.lit(None).cast("string")
    totals = found.groupBy("sha256").agg(F.countDistinct("api_index", "instance").alias("slice_count"), F.round(F.sum("seconds"), 3).alias("duration_seconds"), F.coalesce(F.max("error"), over).alias("error"))
    status = F.when(F.col("error").isNotNull(), "error").when(F.coalesce("slice_count", F.lit(0)) == 0, "zero-slice").otherwise("ok")
    report = method.select("sha256").distinct().join(totals, "sha256", "left").withColumn("status", status)
    report = durable(report.select("sha256", "status", F.when(F.col("status") != "error", F.coalesce("slice_count", F.lit(0))).alias("slice_count"), F.coalesce("duration_seconds", F.lit(0.0)).alias("duration_seconds"), "error"))
    good = found.join(report.where("status = 'ok'").select("sha256"), "sha256", "left_semi")

    texts = unit.select(F.col("unit_id").alias("unit"), "text")
    files = [_slice_graphs(good, texts), _call_graphs(good, edges.select(*key, "src", "dst"), features), _relations(good), *_methods(good, unit, cfg)]
    rows = None
    for f in files:
        rows = f if rows is None else rows.unionByName(f)
    path = F.concat_ws("/", *KEY, "kind", "name")
    return Contexts(rows.select(*KEY, "kind", "name", F.regexp_replace("name", r"\.[^.]*$", "").alias("stem"), path.alias("path"), "content"), report)


def _file(rows: DataFrame, kind: str, name: Column) -> DataFrame:
    return rows.select(*KEY, F.lit(kind).alias("kind"), name.alias("name"), "content")


def _slice_graphs(good: DataFrame, texts: DataFrame) -> DataFrame:
    """Slices with their chains of units merged, in one contraction over all slices."""
    by = [*KEY, "name"]
    at = F.concat_ws("/", *by)
    units = good.select(*by, at.alias("graph_id"), F.explode("slice").alias("unit")).join(texts, "unit")
    node = F.concat_ws("/", "graph_id", F.col("unit").cast("string"))
    nodes = durable(units.select(*by, node.alias("node"), _labelled(F.coalesce("text", F.lit("")), F.col("unit")).alias("text")).withColumn("control", G.is_control(F.col("text"))).distinct())
    within = good.select(at.alias("graph_id"), F.explode("graph").alias("e"))
    edges = durable(within.select(*(F.concat_ws("/", "graph_id", F.col(f"e.{end}").cast("string")).alias(end) for end in ("src", "dst"))).distinct())
    merged, between = G.contracted(nodes.select("node", "text", "control"), edges)
    heads = nodes.select(*by, F.col("node").alias("head")).join(merged, "head").select(*by, F.col("head").alias("node"), F.col("text").alias("label"))
    arrows = nodes.select(*by, F.col("node").alias("src")).join(between, "src").select(*by, "src", "dst")
    return _file(dot_files(heads, arrows, by, "SliceGraph"), "SliceGraph", F.concat("name", F.lit(".dot")))


def _call_graphs(good: DataFrame, edges: DataFrame, features: DataFrame) -> DataFrame:
    nodes = good.select(*KEY, F.col("method_key").alias("node"), F.col("method_key").alias("label")).distinct()
    within = edges.join(nodes.select(*KEY).distinct(), KEY, "left_semi")
    named = features.select("api_index", F.col("name").alias("searched")).distinct()
    return _file(dot_files(nodes, within, KEY, "subgraph_").join(named, "api_index"), "CallGraph", F.concat("searched", F.lit(".dot")))


def _relations(good: DataFrame) -> DataFrame:
    lines = file_text(F.col("relations"))
    return _file(good.withColumn("content", F.when(lines == "", lines).otherwise(F.concat(lines, F.lit("\n")))), "Relation", F.concat("name", F.lit(".txt")))


def _methods(good: DataFrame, unit: DataFrame, cfg: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The control flow of each sliced method as a graph of all its blocks, and its text."""
    where = good.select(*KEY, "method_id", "method_key").distinct()
    wanted = durable(where.select("method_id").distinct())
    placed, edges = basic_blocks(unit.join(wanted, "method_id", "left_semi").select("method_id", "unit_id", "ordinal", "text"), cfg.join(wanted, "method_id", "left_semi"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), "\n")
    nodes = placed.groupBy("method_id", F.col("block").alias("node")).agg(text.alias("text")).select("method_id", "node", _labelled(F.col("text"), F.col("node")).alias("label"))
    drawn = dot_files(nodes, edges, ["method_id"], "cfg", isolated=True)
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "unit_id", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), "\n")
    bodies = unit.join(where.select("method_id").distinct(), "method_id", "left_semi").groupBy("method_id").agg(lines.alias("content"))
    return _file(where.join(drawn, "method_id"), "cfg", F.concat("method_key", F.lit(".dot"))), _file(where.join(bodies, "method_id"), "code", F.concat("method_key", F.lit(".jimple")))
