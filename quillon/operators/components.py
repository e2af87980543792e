"""Connected components of an undirected graph given as edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.durable import remove, stored

ROUNDS = 60
#: Rounds whose places are read in one plan.
STEPS = 8


def components(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = ROUNDS) -> DataFrame:
    """``node, component`` for each node of an edge; the component is its least node.

    Contracts the graph until no edge is left: every node goes to the node of the least
    hash among its neighbours and itself, with a new hash each round, and edges between
    nodes of different places are kept between the places. A round leaves two thirds of
    the nodes or fewer on average, however they are numbered, so all rounds together
    cost a multiple of the first, and there are as many as the logarithm of the nodes.
    The places are then read from the last round back to the first. Each round is cut
    from its lineage.

    Self edges make their node a component; null ends are dropped.
    """
    spark = edges.sparkSession
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    alone = e.where("u = v").select(F.col("u").alias("node")).distinct()
    now, path = stored(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    levels: list[tuple[DataFrame, str]] = []
    while not now.isEmpty():
        if len(levels) == rounds:
            raise RuntimeError(f"the components are not found after {rounds} rounds")
        levels.append(stored(_places(now, len(levels))))
        after = stored(_between(now, levels[-1][0]))
        remove(spark, path)
        now, path = after
    root = now.select(F.col("u").alias("node"), F.col("v").alias("root"))  # no rows
    for k, (level, _) in enumerate(reversed(levels), 1):
        further = root.withColumnsRenamed({"node": "place", "root": "further"})
        root = level.join(further, "place", "left").select("node", F.coalesce("further", "place").alias("root"))
        if k % STEPS == 0 or k == len(levels):
            root, _ = stored(root)
    for _, path in levels:
        remove(spark, path)
    least, _ = stored(root.groupBy("root").agg(F.min("node").alias("component")))
    found = root.join(least, "root").select("node", "component")
    return found.unionByName(alone.join(root.select("node"), "node", "left_anti").withColumn("component", F.col("node")))


def _places(edges: DataFrame, salt: int) -> DataFrame:
    """``node, place``: the node of the least hash among the neighbours of each node and itself."""

    def hashed(node: str) -> Column:
        return F.struct(F.xxhash64(F.lit(salt), node).alias("hash"), F.col(node).alias("node"))

    ways = edges.select(F.col("u").alias("node"), F.col("v").alias("to")).unionByName(edges.select(F.col("v").alias("node"), F.col("u").alias("to")))
    return ways.groupBy("node").agg(F.min(hashed("to")).alias("least")).select("node", F.least("least", hashed("node"))["node"].alias("place"))


def _between(edges: DataFrame, places: DataFrame) -> DataFrame:
    """The edges between different places."""
    u, v = (places.withColumnsRenamed({"node": end, "place": f"{end}_place"}) for end in ("u", "v"))
    ends = edges.join(u, "u").join(v, "v").where("u_place <> v_place")
    return ends.select(F.greatest("u_place", "v_place").alias("u"), F.least("u_place", "v_place").alias("v")).distinct()
