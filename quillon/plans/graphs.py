"""Queries: graphs. Edges come from whole-number arithmetic on keys, so any engine has the same ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.operators import graph as G
from quillon.operators.components import components
from quillon.operators.neighbourhoods import neighbourhoods
from quillon.plans.registry import query
from quillon.plans.scoring import table

_N = "(SELECT count(*) FROM supplier)"
_EDGES = f"edges AS (SELECT DISTINCT s_suppkey AS src, (7 * s_suppkey + 3) % {_N} AS dst FROM supplier UNION SELECT DISTINCT s_suppkey, (5 * s_suppkey + 1) % {_N} FROM supplier WHERE s_suppkey % 4 = 0)"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey")
    n = supplier.count()
    key = F.col("s_suppkey")
    first = supplier.select(key.alias("src"), ((7 * key + 3) % n).alias("dst"))
    return first.unionByName(supplier.where(key % 4 == 0).select(key.alias("src"), ((5 * key + 1) % n).alias("dst"))).distinct()


def _start(spark: SparkSession) -> DataFrame:
    return spark.range(1, 2).withColumnRenamed("id", "node")


@query(f"WITH {_EDGES} SELECT node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT src AS node, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) GROUP BY node")
def degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degrees(_edges(spark, sf_dir))


_HOOD = f"{_EDGES}, way AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), hood(node, depth) AS (SELECT 1::BIGINT, 0 UNION SELECT b, depth + 1 FROM hood JOIN way ON a = node WHERE depth < 3)"


@query(f"WITH RECURSIVE {_HOOD} SELECT src, dst FROM edges WHERE src IN (SELECT node FROM hood) AND dst IN (SELECT node FROM hood)")
def khop_induced(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    return G.induced(edges, G.khop(edges, _start(spark), 2))


@query(f"WITH RECURSIVE {_EDGES}, up(node, depth) AS (SELECT 1::BIGINT, 0 UNION SELECT src, depth + 1 FROM up JOIN edges ON dst = node WHERE depth < 6) SELECT node, min(depth)::INT AS depth FROM up GROUP BY node")
def backward_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.reached(_edges(spark, sf_dir), _start(spark), hops=6, backward=True)


@query(f"WITH {_EDGES} SELECT src, dst FROM edges WHERE src % 3 <> 0 OR dst % 5 = 0")
def prune_tpl(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return G.pruned(edges, nodes.where("node % 3 = 0"), nodes.where("node % 5 = 0"))


@query("SELECT c_custkey AS node FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def isolated_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are nodes, large orders are edges to other nodes; customers without one are isolated and go."""
    nodes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"))
    large = table(spark, sf_dir, "orders").where("o_totalprice > 400000")
    return G.connected_to_edges(nodes, large.select((-1 - F.col("o_orderkey")).alias("src"), F.col("o_custkey").alias("dst")))


def _steps(spark: SparkSession, sf_dir: str, width: int) -> DataFrame:
    """An edge from every customer to the one ``width`` keys further: as many paths, which grow with the table."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(key.alias("src"), (key + width).alias("dst"))


@query("SELECT node, min(node) OVER (PARTITION BY node % 7) AS component FROM (SELECT c_custkey AS node FROM customer UNION SELECT c_custkey + 7 FROM customer)")
def component_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(_steps(spark, sf_dir, 7))


@query("""
    SELECT width, count(DISTINCT node % width) <= 1 AS connected
    FROM (SELECT c_custkey AS node, 1 AS width FROM customer UNION SELECT c_custkey + 1, 1 FROM customer UNION SELECT c_custkey, 7 FROM customer UNION SELECT c_custkey + 7, 7 FROM customer) GROUP BY width
""")
def connectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One path through all customers is connected, seven of them are not."""
    one, seven = (_steps(spark, sf_dir, w).withColumn("width", F.lit(w)) for w in (1, 7))
    return G.connected_graphs(one.unionByName(seven), "width")


def _chain(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each user's events in their order, as a chain."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    following = F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return events, events.select(F.col("event_id").alias("src"), following.alias("dst")).where("dst IS NOT NULL")


@query("""
    WITH flagged AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
    numbered AS (SELECT *, sum(CASE WHEN before IS NULL OR before = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM flagged)
    SELECT first(event_id ORDER BY ts, event_id) AS head, string_agg(event_type, chr(10) ORDER BY ts, event_id) AS text, count(*) AS size FROM numbered GROUP BY user_id, island
""")
def chain_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, edges = _chain(spark, sf_dir)
    nodes = events.select(F.col("event_id").alias("node"), F.col("event_type").alias("text"), (F.col("event_type") == "purchase").alias("control"))
    return G.contracted(nodes, edges)[0]


@query("SELECT src, dst FROM (SELECT event_id AS src, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events WHERE event_type <> 'view') WHERE dst IS NOT NULL")
def bridge_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, edges = _chain(spark, sf_dir)
    return G.bridged(edges, events.where("event_type <> 'view'").select(F.col("event_id").alias("node")))


def _sessions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A graph for each user: an event leads to the next one and, after a click, to the third next; the first event of each type is searched."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    ahead = events.select("user_id", "event_type", F.col("event_id").alias("src"), F.lead("event_id", 1).over(w).alias("one"), F.lead("event_id", 3).over(w).alias("three"))
    next_ = ahead.select("user_id", "src", F.col("one").alias("dst")).unionByName(ahead.where("event_type = 'click'").select("user_id", "src", F.col("three").alias("dst")))
    first = events.groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("f")).select("user_id", "event_type", F.col("f.event_id").alias("node"))
    return next_.where("dst IS NOT NULL"), first, events.where("event_type = 'view'").select("user_id", F.col("event_id").alias("node"))


@query("""
    WITH RECURSIVE ahead AS (SELECT user_id AS g, event_type AS t, event_id AS src, lead(event_id, 1) OVER w AS one, lead(event_id, 3) OVER w AS three FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    edges AS (SELECT g, src, one AS dst FROM ahead WHERE one IS NOT NULL UNION SELECT g, src, three FROM ahead WHERE t = 'click' AND three IS NOT NULL),
    ways AS (SELECT g, src AS a, dst AS b FROM edges UNION SELECT g, dst, src FROM edges),
    roots AS (SELECT user_id AS g, event_type AS key, first(event_id ORDER BY ts, event_id) AS root FROM events GROUP BY user_id, event_type),
    hood(g, key, node, depth) AS (SELECT g, key, root, 0 FROM roots UNION SELECT h.g, h.key, b, depth + 1 FROM hood h JOIN ways w ON w.g = h.g AND w.a = h.node WHERE depth < 3),
    nodes AS (SELECT DISTINCT g, key, node FROM hood),
    kept AS (
        SELECT s.g, s.key, e.src, e.dst FROM edges e JOIN nodes s ON s.g = e.g AND s.node = e.src JOIN nodes d ON d.g = e.g AND d.key = s.key AND d.node = e.dst
        JOIN roots r ON r.g = s.g AND r.key = s.key WHERE e.dst = r.root OR e.src NOT IN (SELECT event_id FROM events WHERE event_type = 'view')),
    ends AS (SELECT g, key, src AS node FROM kept UNION SELECT g, key, dst FROM kept),
    paths AS (SELECT g, key, src AS a, dst AS b FROM kept UNION SELECT g, key, dst, src FROM kept),
    reach(g, key, node) AS (SELECT g, key, root FROM roots JOIN ends USING (g, key) WHERE node = root UNION SELECT r.g, r.key, b FROM reach r JOIN paths x ON x.g = r.g AND x.key = r.key AND x.a = r.node),
    whole AS (SELECT g, key FROM (SELECT g, key, count(*) AS n FROM ends GROUP BY g, key) JOIN (SELECT g, key, count(*) AS m FROM reach GROUP BY g, key) USING (g, key) WHERE n = m)
    SELECT g AS user_id, key AS event_type, src, dst FROM kept JOIN whole USING (g, key)
""")
def keyed_neighbourhoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pruned and connected neighbourhoods of all users and types at once."""
    edges, roots, third = _sessions(spark, sf_dir)
    found = neighbourhoods(edges, roots, third, k=2, graph=["user_id"], key=["user_id", "event_type"])
    return found.select("user_id", "event_type", "src", "dst")
