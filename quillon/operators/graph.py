"""Directed graphs as edge tables: neighbourhoods, reachability, bridging, contraction.

Edges are distinct ``src, dst`` rows. Iterative operators join the frontier with the
edges, round by round, each round cut from its lineage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.durable import durable
from quillon.operators.components import components


def degrees(edges: DataFrame) -> DataFrame:
    """``node, out_degree, in_degree`` of each node of an edge."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def reached(edges: DataFrame, start: DataFrame, hops: int | None = None, both_ways: bool = False, backward: bool = False, rounds: int = 10_000) -> DataFrame:
    """``node, depth``: the nodes within ``hops`` of ``start`` (any number if None), with the least depth.

    ``start`` has a column ``node``. A node enters the frontier once. A walk without
    ``hops`` that does not end within the rounds is an error.
    """
    step = edges.select(F.col("dst" if backward else "src").alias("node"), F.col("src" if backward else "dst").alias("to"))
    if both_ways:
        step = step.unionByName(step.select(F.col("to").alias("node"), F.col("node").alias("to"))).distinct()
    seen = frontier = durable(start.select("node").distinct().withColumn("depth", F.lit(0)))
    for depth in range(1, (rounds if hops is None else hops) + 1):
        new = step.join(frontier.select("node"), "node").select(F.col("to").alias("node")).distinct().join(seen, "node", "left_anti")
        frontier = durable(new.withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = durable(seen.unionByName(frontier)) if depth % 8 == 0 else seen.unionByName(frontier)
    else:
        if hops is None:
            raise RuntimeError(f"the walk does not end within {rounds} rounds")
    return seen


def khop(edges: DataFrame, start: DataFrame, k: int) -> DataFrame:
    """The undirected neighbourhood of the searched nodes: ``k + 1`` expansions."""
    return reached(edges, start, hops=k + 1, both_ways=True)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges with both ends among ``nodes``."""
    within = nodes.select("node").distinct()
    return edges.join(within.withColumnRenamed("node", "src"), "src", "left_semi").join(within.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")


def pruned(edges: DataFrame, third_party: DataFrame, searched: DataFrame) -> DataFrame:
    """Edges but those that a third-party node has to any other node than a searched one.

    Empty if no searched node is left in an edge.
    """
    kept = edges.join(third_party.select(F.col("node").alias("src"), F.lit(True).alias("__third")).distinct(), "src", "left").join(searched.select(F.col("node").alias("dst"), F.lit(True).alias("__searched")).distinct(), "dst", "left")
    kept = kept.where(F.col("__third").isNull() | F.col("__searched").isNotNull()).select("src", "dst")
    left = kept.select(F.explode(F.array("src", "dst")).alias("node")).join(searched.select("node"), "node", "left_semi")
    return kept.limit(0) if left.isEmpty() else kept


def connected_to_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes without isolated ones; a graph of a single node keeps it."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return nodes if nodes.limit(2).count() < 2 else nodes.join(ends, "node", "left_semi")


def is_connected(edges: DataFrame) -> DataFrame:
    """One row, ``connected``: whether all ends of edges are one component; a graph without edges is connected."""
    return components(edges).agg((F.countDistinct("component") <= 1).alias("connected"))


def connected_graphs(edges: DataFrame, graph: str) -> DataFrame:
    """``graph, connected`` for each graph that has edges, all graphs in the same rounds."""
    ends = (F.struct(F.col(graph).alias("graph"), F.col(end).alias("node")).alias(end) for end in ("src", "dst"))
    return components(edges.select(*ends)).groupBy(F.col("node.graph").alias(graph)).agg((F.countDistinct("component") <= 1).alias("connected"))


def bridged(edges: DataFrame, kept: DataFrame, rounds: int = 10_000) -> DataFrame:
    """``src, dst`` for kept nodes joined by a path whose inner nodes are all not kept.

    The frontier holds (kept node, not kept node that it reaches) and stops at kept nodes.
    """
    step = edges.select(F.col("src").alias("at"), F.col("dst").alias("to")).distinct()
    is_kept = kept.select(F.col("node").alias("to"), F.lit(True).alias("kept")).distinct()
    walk = durable(kept.select(F.col("node").alias("src"), F.col("node").alias("at")).distinct())
    found, seen = None, None
    for _ in range(rounds):
        moved = durable(walk.join(step, "at").select("src", "to").distinct().join(is_kept, "to", "left"))
        ended = moved.where("kept").select("src", F.col("to").alias("dst"))
        found = ended if found is None else found.unionByName(ended)
        inner = moved.where("kept IS NULL").select("src", F.col("to").alias("at"))
        if seen is not None:
            inner = inner.join(seen, ["src", "at"], "left_anti")
        walk = durable(inner)
        if walk.isEmpty():
            break
        seen = durable(walk if seen is None else seen.unionByName(walk))
    else:
        raise RuntimeError(f"the paths do not end within {rounds} rounds")
    return found.distinct()


# How lines of control-flow statements begin.
CONTROL = "^(if|goto|return|switch|tableswitch|lookupswitch)"


def is_control(text: Column) -> Column:
    """Whether any line of a node's text begins a control-flow statement."""
    return F.exists(F.split(text, "\n"), lambda x: x.rlike(CONTROL))


def contracted(nodes: DataFrame, edges: DataFrame, rounds: int = 64) -> tuple[DataFrame, DataFrame]:
    """Merges chains: a into b if a's only edge leads to b, b has no other, and a is no control node.

    ``nodes`` has ``node, text, control``. Gives merged nodes (``head``, ``text`` with
    the members' texts in order, ``size``) and the edges between heads. Pointers to
    the head of a chain double in length each round. A chain that is a whole cycle
    has no head; it is cut before its least node.
    """
    deg = degrees(edges)
    one_out = deg.where("out_degree = 1").join(nodes.where(~F.col("control")), "node", "left_semi").select(F.col("node").alias("src"))
    one_in = deg.where("in_degree = 1").select(F.col("node").alias("dst"))
    merge = edges.where("src <> dst").join(one_out, "src", "left_semi").join(one_in, "dst", "left_semi").select(F.col("dst").alias("node"), F.col("src").alias("up"))
    links = durable(nodes.select("node").join(merge, "node", "left"))
    at = durable(_jumped(links, rounds))
    if not at.where("up IS NOT NULL").isEmpty():  # whole cycles
        cut = at.where("up IS NOT NULL").groupBy("least").agg(F.min("node").alias("node")).select("node", F.lit(True).alias("first"))
        links = durable(links.join(cut, "node", "left").select("node", F.when(F.col("first").isNull(), F.col("up")).alias("up")))
        at = durable(_jumped(links, rounds))
    members = at.select("node", "head", "distance").join(nodes.select("node", "text"), "node")
    merged = members.groupBy("head").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("distance", "text"))), lambda x: x["text"]), "\n").alias("text"), F.count("*").alias("size"))
    head = at.select("node", "head")
    outer = edges.join(links.where("up IS NOT NULL").select(F.col("up").alias("src"), F.col("node").alias("dst")), ["src", "dst"], "left_anti")
    between = outer.join(head.withColumnsRenamed({"node": "src", "head": "s"}), "src").join(head.withColumnsRenamed({"node": "dst", "head": "d"}), "dst").select(F.col("s").alias("src"), F.col("d").alias("dst")).distinct()
    return merged, between


def _jumped(links: DataFrame, rounds: int) -> DataFrame:
    """``node, head, distance, least, up``: up is null once the head is found, and never null in a cycle."""
    now = durable(links.select("node", "up", F.coalesce("up", "node").alias("head"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("distance"), F.least("node", F.coalesce("up", "node")).alias("least")))
    n = now.count()
    for k in range(rounds):
        if (1 << k) > 2 * n or now.where("up IS NOT NULL").isEmpty():
            break
        above = now.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("head").alias("head2"), F.col("distance").alias("d2"), F.col("least").alias("l2"))
        now = durable(
            now.join(above, "up", "left").select(
                "node",
                F.col("up2").alias("up"),
                F.coalesce("head2", "head").alias("head"),
                (F.col("distance") + F.coalesce("d2", F.lit(0))).alias("distance"),
                F.least("least", F.coalesce("l2", "least")).alias("least"),
            )
        )
    return now
