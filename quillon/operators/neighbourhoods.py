"""Call-graph neighbourhoods of searched methods, over all applications and interfaces at once.

Graphs are rows of one edge table, told apart by ``graph`` columns; each neighbourhood has
a ``key``, which begins with them. All keys walk together: a round joins the frontier of
every key with the edges of its graph, so the number of jobs goes by the hops and not by
the keys. Nothing of a graph is held as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.durable import durable
from quillon.functions.scalars import signature_key
from quillon.operators.components import components
from quillon.operators.contexts import Contexts, dot_files

GRAPH, KEY = ["sha256"], ["sha256", "api_index"]


def searched_methods(features: DataFrame, method: DataFrame, calls: DataFrame) -> DataFrame:
    """``sha256, api_index, node, name``: of the methods with an interface's class and name, the target of the first call."""
    target = method.select("sha256", F.col("method_id").alias("node"), "class", "name").join(features.select("api_index", "class", "name"), ["class", "name"])
    called = calls.select(F.col("dst").alias("node"), "ordinal").join(target, "node")
    first = called.groupBy(*KEY, "name").agg(F.min(F.struct("ordinal", "node")).alias("f"))
    return first.select(*KEY, "f.node", "name")


def within_hops(edges: DataFrame, roots: DataFrame, k: int, graph: list[str] = GRAPH, key: list[str] = KEY) -> DataFrame:
    """``*key, node, depth``: what ``k + 1`` expansions from each key's roots reach, edges taken both ways."""
    ends = [(F.col(a).alias("node"), F.col(b).alias("to")) for a, b in (("src", "dst"), ("dst", "src"))]
    step = durable(edges.select(*graph, *ends[0]).unionByName(edges.select(*graph, *ends[1])).distinct())
    seen = frontier = durable(roots.select(*key, "node").distinct().withColumn("depth", F.lit(0)))
    for depth in range(1, k + 2):
        moved = frontier.join(step, [*graph, "node"]).select(*key, F.col("to").alias("node")).distinct()
        frontier = durable(moved.join(seen, [*key, "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = durable(seen.unionByName(frontier)) if depth % 4 == 0 else seen.unionByName(frontier)
    return seen


def induced_by_key(edges: DataFrame, nodes: DataFrame, graph: list[str] = GRAPH, key: list[str] = KEY) -> DataFrame:
    """``*key, src, dst``: the edges of each key's graph with both ends among the key's nodes."""
    plain = nodes.select(*key, "node").distinct()
    out = edges.select(*graph, "src", "dst").distinct().join(plain.withColumnRenamed("node", "src"), [*graph, "src"])
    return out.join(plain.withColumnRenamed("node", "dst"), [*key, "dst"], "left_semi").select(*key, "src", "dst")


def pruned_by_key(edges: DataFrame, third_party: DataFrame, roots: DataFrame, graph: list[str] = GRAPH, key: list[str] = KEY) -> DataFrame:
    """Keyed edges but those from a third-party node to any other node than the key's searched one; none of a key whose searched node has no edge left."""
    third = third_party.select(*graph, F.col("node").alias("src"), F.lit(True).alias("__third")).distinct()
    to = roots.select(*key, F.col("node").alias("dst"), F.lit(True).alias("__searched")).distinct()
    kept = edges.join(third, [*graph, "src"], "left").join(to, [*key, "dst"], "left").where("__third IS NULL OR __searched").select(*key, "src", "dst")
    kept = durable(kept)
    alive = kept.select(*key, F.explode(F.array("src", "dst")).alias("node")).join(roots, [*key, "node"], "left_semi").select(*key).distinct()
    return kept.join(alive, key, "left_semi")


def connected_by_key(edges: DataFrame, key: list[str] = KEY) -> DataFrame:
    """The keyed edges of the keys whose edges are one component."""
    ends = [F.struct(*key, F.col(c).alias("node")).alias(c) for c in ("src", "dst")]
    label = components(edges.select(*ends)).select(*(F.col(f"node.{k}").alias(k) for k in key), "component")
    whole = label.groupBy(*key).agg((F.min("component") == F.max("component")).alias("whole")).where("whole")
    return edges.join(whole, key, "left_semi")


def neighbourhoods(edges: DataFrame, roots: DataFrame, third_party: DataFrame, k: int, graph: list[str] = GRAPH, key: list[str] = KEY) -> DataFrame:
    """``*key, src, dst``: each key's neighbourhood, pruned of what third parties call, where it is connected."""
    around = durable(induced_by_key(edges, within_hops(edges, roots, k, graph, key), graph, key))
    return connected_by_key(durable(pruned_by_key(around, third_party, roots, graph, key)), key)


def neighbourhood_files(method: DataFrame, unit: DataFrame, calls: DataFrame, features: DataFrame, k: int) -> Contexts:
    """The neighbourhoods of listed interfaces as files, with the bodies of their methods, and a report on all samples.

    ``method`` tells third-party methods by ``is_application`` being false, where it has
    that column. ``slice_count`` is the number of interfaces that are called, whether a
    graph is left of them or not.
    """
    roots = durable(searched_methods(features, method, calls))
    own = method.select("sha256", F.col("method_id").alias("src"))
    edges = calls.select("src", "dst").join(own, "src").select("sha256", "src", "dst").distinct()
    third = method.where("NOT is_application") if "is_application" in method.columns else method.where("false")
    found = durable(neighbourhoods(edges, roots, third.select("sha256", F.col("method_id").alias("node")), k))
    info = method.select("sha256", F.col("method_id").alias("node"), "signature", "has_body")
    nodes = durable(found.select(*KEY, F.explode(F.array("src", "dst")).alias("node")).distinct().join(info, ["sha256", "node"]))
    drawn = dot_files(nodes.select(*KEY, "node", F.col("signature").alias("label")), found, KEY, "subgraph")
    graphs = drawn.join(roots.select(*KEY, "name"), KEY).select(*KEY, F.lit("Subgraph").alias("kind"), F.concat("name", F.lit(".dot")).alias("name"), "content")
    with_body = nodes.where("has_body").select(*KEY, F.col("node").alias("method_id"), signature_key(F.col("signature")).alias("name"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "unit_id", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), "\n")
    bodies = unit.join(with_body.select("method_id").distinct(), "method_id", "left_semi").groupBy("method_id").agg(lines.alias("content"))
    functions = with_body.join(bodies, "method_id").select(*KEY, F.lit("Subgraph/functions").alias("kind"), F.concat("name", F.lit(".jimple")).alias("name"), "content")
    files = graphs.unionByName(functions).withColumn("path", F.concat_ws("/", *KEY, "kind", "name"))
    counted = roots.groupBy("sha256").agg(F.count("*").alias("slice_count"))
    report = method.select("sha256").distinct().join(counted, "sha256", "left").select(
        "sha256",
        F.when(F.coalesce("slice_count", F.lit(0)) == 0, "zero-slice").otherwise("ok").alias("status"),
        F.coalesce("slice_count", F.lit(0)).cast("long").alias("slice_count"),
        F.lit(0.0).alias("duration_seconds"),
        F.lit(None).cast("string").alias("error"),
    )
    return Contexts(files, report)
