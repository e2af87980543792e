"""Queries: program slices. Programs are made of the provided tables by whole-number arithmetic, so any engine has the same ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions.relations import formatted
from quillon.operators import slicing
from quillon.operators.blocks import basic_blocks
from quillon.operators.verdict import RuleModel, Settings, applications_tier, functions_tier, interfaces_tier
from quillon.plans.graphs import _EDGES, _edges
from quillon.plans.registry import query
from quillon.plans.scoring import table

_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate"
_UNITS = f"""
    SELECT l_orderkey AS m, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n,
        'r' || (l_partkey % 12) AS def, 'r' || (l_suppkey % 12) AS use1, 'i' || (l_linenumber % 3) AS use2, l_quantity > 40 AS branch FROM lineitem
"""


def _lines(spark: SparkSession, sf_dir: str, branch: Column) -> DataFrame:
    """Each order as a method: its lines are units that define and use registers, numbered from 1 to ``n``."""
    line = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey")
    return line.select(
        F.col("l_orderkey").alias("method_id"),
        F.row_number().over(w.orderBy(*_ORDER.split(", "))).alias("ordinal"),
        F.count("*").over(w).alias("n"),
        F.concat(F.lit("r"), (F.col("l_partkey") % 12).cast("string")).alias("def"),
        F.concat(F.lit("r"), (F.col("l_suppkey") % 12).cast("string")).alias("use1"),
        F.concat(F.lit("i"), (F.col("l_linenumber") % 3).cast("string")).alias("use2"),
        branch.alias("branch"),
        "l_partkey",
        "l_linenumber",
        "l_quantity",
    ).withColumn("unit_id", F.col("method_id") * 1000 + F.col("ordinal"))


def _program(at: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Units and their references; the last unit is the searched call."""
    last = F.col("ordinal") == F.col("n")
    kind = F.when(last, "invoke").when(F.col("branch"), "if").otherwise("assign")
    unit = at.select("method_id", "unit_id", "ordinal", kind.alias("kind"), F.when(last, "<A: void f()>").alias("invoked"), F.lit("").alias("text"))

    def reference(role: str, value: Column, ordinal: int) -> Column:
        return F.struct(F.lit(role).alias("role"), F.lit(ordinal).alias("ordinal"), value.alias("value"), F.lit(True).alias("is_local"), F.lit(None).cast("string").alias("base"))

    uses = [reference("use", F.col("use1"), 0), reference("use", F.col("use2"), 1)]
    roles = F.when(last, F.array(*uses, reference("arg", F.col("use1"), 0), reference("arg", F.col("use2"), 1))).when(F.col("branch"), F.array(*uses)).otherwise(F.array(*uses, reference("def", F.col("def"), 0)))
    return unit, at.select("method_id", "unit_id", F.explode(roles).alias("r")).select("method_id", "unit_id", "r.*")


def _straight_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Methods without branches in their flow."""
    at = _lines(spark, sf_dir, F.col("l_quantity") > 40)
    flow = at.where("ordinal <> n").select("method_id", F.col("unit_id").alias("src"), (F.col("unit_id") + 1).alias("dst"), F.lit(0).alias("ordinal"))
    return *_program(at), flow


def _branching(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Methods whose flow has diamonds (jumps over the next unit) and loops (jumps back), the searched call within some of them."""
    i = F.col("ordinal")
    jumps, loops = F.col("l_quantity") > 25, F.col("l_linenumber") % 3 == 0
    at = _lines(spark, sf_dir, jumps | loops)
    onto = F.array(F.when(i < F.col("n"), i + 1), F.when(jumps & (i + 2 <= F.col("n")), i + 2), F.when(loops & (i > 1), 1 + F.col("l_partkey") % F.when(i > 1, i - 1)))
    ways = at.select("method_id", F.col("unit_id").alias("src"), i.alias("i"), F.posexplode(onto).alias("way", "to")).where("to IS NOT NULL")
    flow = ways.select("method_id", "src", (F.col("method_id") * 1000 + F.col("to")).alias("dst"), (3 * F.col("i") + F.col("way")).alias("ordinal"))
    return *_program(at), flow


@query(rf"""
    WITH RECURSIVE u AS ({_UNITS}),
    walk(m, i, live, direct, found, kept) AS (
        SELECT m, i, list_distinct([use1, use2]), list_distinct([use1, use2]),
            list_concat(list_transform(list_distinct([use1, use2]), lambda v: '[Direct] ' || v), CASE WHEN use1 <> use2 THEN ['[Parallel] ' || least(use1, use2) || ' and ' || greatest(use1, use2) || ' work together'] ELSE [] END), [i]
        FROM u WHERE i = n
        UNION ALL
        SELECT s.m, s.i, CASE WHEN s.hit THEN list_distinct(list_concat(list_filter(s.live, lambda v: s.branch OR v <> s.def), [s.use1, s.use2])) ELSE s.live END, s.direct,
            CASE WHEN NOT s.hit THEN s.found WHEN s.branch THEN list_concat(s.found, ['[Conditional] ' || s.use1, '[Conditional] ' || s.use2])
                ELSE list_concat(s.found, CASE WHEN s.use1 <> s.use2 THEN ['[Parallel] ' || least(s.use1, s.use2) || ' and ' || greatest(s.use1, s.use2) || ' work together'] ELSE [] END,
                    list_transform(s.new, lambda v: '[Transitive] ' || v), list_transform(list_filter(s.new, lambda v: v <> s.def), lambda v: '[Derived] ' || s.def || ' <- ' || v)) END,
            CASE WHEN s.branch OR list_contains(s.live, s.def) THEN list_concat([s.i], s.kept) ELSE s.kept END
        FROM (
            SELECT w.m, u.i, w.live, w.direct, w.found, w.kept, u.def, u.use1, u.use2, u.branch, u.branch OR len(list_filter(w.live, lambda v: contains(u.def, v))) > 0 AS hit,
                list_filter(list_distinct([u.use1, u.use2]), lambda v: NOT list_contains(w.direct, v)) AS new
            FROM walk w JOIN u ON u.m = w.m AND u.i = w.i - 1 WHERE len(w.live) > 0
        ) s
    )
    SELECT m AS o_orderkey, array_to_string(kept, ',') AS slice, array_to_string(list_sort(list_distinct(found)), chr(10)) AS relations
    FROM (SELECT *, row_number() OVER (PARTITION BY m ORDER BY i) AS r FROM walk) WHERE r = 1
""")
def backward_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slice before the last line of each order, and the relations on the way."""
    return _slices(spark, *_straight_lines(spark, sf_dir))


def _slices(spark: SparkSession, unit: DataFrame, ref: DataFrame, flow: DataFrame) -> DataFrame:
    targets = slicing.callsites(unit, spark.createDataFrame([("<A: void f()>",)], "signature string"))
    found = slicing.sliced(slicing.packed_methods(unit, ref, flow), targets)
    kept = F.array_join(F.transform("slice", lambda u: (u % 1000).cast("string")), ",")
    lines = F.array_join(F.array_sort(F.array_distinct(F.transform("relations", formatted))), "\n")
    return found.select(F.col("method_id").alias("o_orderkey"), kept.alias("slice"), lines.alias("relations"))


@query(f"""
    WITH RECURSIVE u AS (
        SELECT l_orderkey AS m, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n, 'r' || (l_partkey % 12) AS def, 'r' || (l_suppkey % 12) AS use1,
            'i' || (l_linenumber % 3) AS use2, l_quantity > 25 AS jumps, l_linenumber % 3 = 0 AS loops, l_partkey AS p FROM lineitem),
    flow AS (
        SELECT m, i AS src, i + 1 AS dst, 3 * i AS o FROM u WHERE i < n UNION ALL SELECT m, i, i + 2, 3 * i + 1 FROM u WHERE jumps AND i + 2 <= n
        UNION ALL SELECT m, i, 1 + p % nullif(i - 1, 0), 3 * i + 2 FROM u WHERE loops AND i > 1),
    ins AS (SELECT m, dst AS i, list(src ORDER BY o) AS before FROM flow GROUP BY m, dst),
    outs AS (SELECT m, src AS i, list(dst ORDER BY o) AS after FROM flow GROUP BY m, src),
    method AS (
        SELECT m, max(n) AS n, list(def ORDER BY i) AS def, list(use1 ORDER BY i) AS use1, list(use2 ORDER BY i) AS use2, list(jumps OR loops ORDER BY i) AS branch,
            list(coalesce(before, []::BIGINT[]) ORDER BY i) AS before, list(coalesce(after, []::BIGINT[]) ORDER BY i) AS after
        FROM u LEFT JOIN ins USING (m, i) LEFT JOIN outs USING (m, i) GROUP BY m),
    flowing(m, queue, seen, live, found) AS (
        SELECT m, before[n], list_concat([n], before[n]), list_transform(range(1, n + 1), lambda k: CASE WHEN k = n THEN list_distinct([use1[n], use2[n]]) END),
            list_concat(['[Direct] ' || use1[n], '[Direct] ' || use2[n]], CASE WHEN use1[n] <> use2[n] THEN ['[Parallel] ' || least(use1[n], use2[n]) || ' and ' || greatest(use1[n], use2[n]) || ' work together'] ELSE [] END)
        FROM method
        UNION ALL
        SELECT m, list_concat(queue[2:], list_filter(preds, lambda q: NOT list_contains(seen, q))), list_concat(seen, list_filter(preds, lambda q: NOT list_contains(seen, q))),
            list_transform(range(1, n + 1), lambda k: CASE WHEN k <> x THEN live[k] WHEN NOT hit THEN names ELSE list_distinct(list_concat(list_filter(names, lambda v: br OR v <> d), uses)) END),
            CASE WHEN NOT hit THEN found WHEN br THEN list_concat(found, list_transform(uses, lambda v: '[Conditional] ' || v))
                ELSE list_concat(found, CASE WHEN len(uses) > 1 THEN ['[Parallel] ' || list_min(uses) || ' and ' || list_max(uses) || ' work together'] ELSE [] END,
                    list_transform(new, lambda v: '[Transitive] ' || v), list_transform(list_filter(new, lambda v: v <> d), lambda v: '[Derived] ' || d || ' <- ' || v)) END
        FROM (
            SELECT *, br OR len(list_filter(names, lambda v: contains(d, v))) > 0 AS hit, list_filter(uses, lambda v: NOT list_contains(first, v)) AS new FROM (
                SELECT f.*, n, queue[1] AS x, before[queue[1]] AS preds, branch[queue[1]] AS br, def[queue[1]] AS d, list_distinct([use1[queue[1]], use2[queue[1]]]) AS uses, [use1[n], use2[n]] AS first,
                    list_distinct(flatten(list_filter(list_transform(after[queue[1]], lambda a: live[a]), lambda l: l IS NOT NULL))) AS names
                FROM flowing f JOIN method USING (m) WHERE len(queue) > 0))),
    flown AS (SELECT m, live, found FROM flowing WHERE len(queue) = 0),
    walk(m, queue, seen, kept) AS (
        SELECT m, before[n], [n], [n] FROM method
        UNION ALL
        SELECT m, list_concat(queue[2:], onward), list_concat(seen, [x], onward), CASE WHEN len(names) > 0 AND (br OR list_contains(names, d)) AND NOT list_contains(kept, x) THEN list_concat(kept, [x]) ELSE kept END
        FROM (
            SELECT *, CASE WHEN len(names) > 0 THEN list_filter(preds, lambda q: q <> x AND NOT list_contains(seen, q)) ELSE [] END AS onward FROM (
                SELECT w.*, queue[1] AS x, before[queue[1]] AS preds, branch[queue[1]] AS br, def[queue[1]] AS d,
                    list_distinct(flatten(list_filter(list_transform(after[queue[1]], lambda a: live[a]), lambda l: l IS NOT NULL))) AS names
                FROM walk w JOIN method USING (m) JOIN flown USING (m) WHERE len(queue) > 0)))
    SELECT m AS o_orderkey, array_to_string(list_reverse(kept), ',') AS slice, array_to_string(list_sort(list_distinct(found)), chr(10)) AS relations FROM walk JOIN flown USING (m) WHERE len(queue) = 0
""")
def branching_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices where the flow branches, joins and loops: each unit is visited once, in the order of the edges."""
    return _slices(spark, *_branching(spark, sf_dir))


def _callers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Suppliers as methods that call each other; every fifth call has no call site, as a call through an interface has none."""
    edges = _edges(spark, sf_dir)
    nodes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("method_id"), F.col("s_nationkey").alias("nation"))
    one = [F.concat(F.lit("C"), F.col("nation").cast("string")), F.concat(F.lit("m"), (F.col("method_id") % 3).cast("string"))]
    signature = F.concat(F.lit("<A: void m"), F.col("method_id").cast("string"), F.lit("()>"))
    method = nodes.select("method_id", F.lit("app").alias("sha256"), one[0].alias("class"), one[1].alias("name"), signature.alias("signature"), F.lit(0).alias("n_params"), (F.col("method_id") % 7 != 0).alias("has_body"))
    calls = edges.join(method.select(F.col("method_id").alias("dst"), F.col("signature").alias("invoked"), F.col("name").alias("called")), "dst").withColumn("ordinal", F.col("src") * 100_000 + F.col("dst"))
    site = F.when((F.col("src") * 31 + F.col("dst")) % 5 != 0, F.col("invoked"))
    sites = calls.select(F.col("src").alias("method_id"), F.col("ordinal").alias("unit_id"), F.col("dst").cast("int").alias("ordinal"), F.lit("invoke").alias("kind"), site.alias("invoked"), F.concat(F.lit("call "), F.when(F.col("dst") % 11 != 0, F.col("called")).otherwise(F.lit("it"))).alias("text"))
    own = method.select("method_id", (-F.col("method_id")).alias("unit_id"), F.lit(-1).alias("ordinal"), F.lit("invoke").alias("kind"), F.lit("<P: void api()>").alias("invoked"), F.lit("call api").alias("text"))
    return method, sites.unionByName(own), calls.select("src", "dst", "ordinal")


_CALLS = f"{_EDGES}, method AS (SELECT s_suppkey AS id, s_nationkey AS nation, s_suppkey % 7 <> 0 AS body FROM supplier), calls AS (SELECT src, dst, (src * 31 + dst) % 5 <> 0 AS site FROM edges JOIN method s ON s.id = src JOIN method d ON d.id = dst)"


@query(f"""
    WITH RECURSIVE {_CALLS}, up AS (SELECT calls.* FROM calls JOIN method ON id = src WHERE body),
    walk(root, node, depth) AS (SELECT id, id, 0 FROM method UNION SELECT root, src, depth + 1 FROM walk JOIN up ON dst = node WHERE site AND depth < 2),
    nodes AS (SELECT root, node, min(depth) AS depth FROM walk GROUP BY root, node)
    SELECT root AS instance, node AS src, -1::BIGINT AS dst FROM nodes
    UNION ALL
    SELECT DISTINCT d.root, up.src, up.dst FROM nodes d JOIN up ON up.dst = d.node JOIN nodes s ON s.root = d.root AND s.node = up.src WHERE d.depth < 2 AND s.depth <= d.depth + 1
""")
def caller_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a call in each method up through two hops of callers: the sliced methods (dst -1) and the call-graph edges."""
    method, unit, calls = _callers(spark, sf_dir)
    no_refs = spark.createDataFrame([], "unit_id long, role string, ordinal int, value string, is_local boolean, base string")
    no_flow = spark.createDataFrame([], "method_id long, src long, dst long, ordinal int")
    roots = method.select(F.col("method_id").alias("instance"), "method_id", F.lit("<P: void api()>").alias("signature"))
    slices, edges = slicing.backward(slicing.packed_methods(unit, no_refs, no_flow), unit, method, calls, roots, hops=2)

    def number(key: str) -> Column:
        return F.regexp_extract(key, r"m(\d+)$", 1).cast("bigint")

    return slices.select("instance", F.col("method_id").alias("src"), F.lit(-1).cast("bigint").alias("dst")).unionByName(edges.select("instance", number("src").alias("src"), number("dst").alias("dst")))


@query(f"""
    WITH {_CALLS}, named AS (SELECT src, dst, site, 'C' || nation AS class, 'm' || (dst % 3) AS name, src * 100000 + dst AS o FROM calls JOIN method ON id = dst),
    first AS (SELECT class, name, arg_min(dst, o) AS target FROM named GROUP BY class, name),
    candidates AS (SELECT DISTINCT n.class, n.name, n.src FROM named n JOIN method ON id = n.src AND body),
    holding AS (SELECT DISTINCT c.class, c.name, c.src FROM candidates c JOIN named x ON x.src = c.src AND x.name = c.name AND x.dst % 11 <> 0),
    good AS (SELECT h.* , target FROM holding h JOIN first f USING (class, name) WHERE EXISTS (SELECT 1 FROM calls WHERE calls.src = h.src AND calls.dst = f.target AND site))
    SELECT class, name, row_number() OVER (PARTITION BY class, name ORDER BY src) - 1 AS instance, src, target FROM good
""")
def interface_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where slices begin: callers of each interface by class and name, those that call its first overload, numbered."""
    method, unit, calls = _callers(spark, sf_dir)
    listed = method.select("class", "name").distinct().withColumn("api_index", F.concat_ws(" ", "class", "name"))
    roots = slicing.interface_roots(listed, method, unit.where("unit_id > 0"), calls)
    part = F.split("api_index", " ")
    return roots.select(part[0].alias("class"), part[1].alias("name"), F.col("instance").cast("bigint").alias("instance"), F.col("method_id").alias("src"), F.regexp_extract("signature", r"m(\d+)", 1).cast("bigint").alias("target"))


@query("""
    WITH said AS (SELECT lang, source, bool_or(contains(text, 'idiot')) AS a, bool_or(contains(text, 'scum')) AS b FROM documents GROUP BY lang, source),
    rolled AS (SELECT lang, (bool_or(a)::INT + bool_or(b)::INT) AS hits FROM said GROUP BY lang)
    SELECT lang AS sha256, CASE WHEN hits > 0 THEN 'MALWARE' ELSE 'BENIGN' END AS prediction, hits || ' listed calls' AS finding FROM rolled
""")
def tiers_to_the_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as functions, their sources as interfaces, their languages as applications, through all three tiers."""
    settings = Settings(mode="no-verification", timeout=None, concurrency=None)
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("sha256"), F.col("source").alias("api_index"), F.col("source").alias("signature"), F.col("doc_id").alias("ordinal"), F.col("text").alias("graph"))

    def model() -> RuleModel:
        return RuleModel(("idiot", "scum"))

    interfaces = interfaces_tier(functions_tier(docs, model, settings), model, settings)
    return applications_tier(interfaces, model, settings).select("sha256", "prediction", F.get("key_findings", F.lit(0)).alias("finding"))


@query(f"""
    WITH u AS (SELECT l_orderkey AS m, row_number() OVER w AS i, count(*) OVER (PARTITION BY l_orderkey) AS n, l_quantity > 45 AS jumps, l_returnflag = 'R' AS ends, l_linenumber % 3 = 0 AS loops FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY {_ORDER})),
    flow AS (
        SELECT m, i AS src, i + 1 AS dst FROM u WHERE i < n AND NOT ends UNION ALL SELECT m, i, i + 2 FROM u WHERE i + 2 <= n AND jumps UNION ALL SELECT m, i, 1 FROM u WHERE loops AND i > 1),
    led AS (
        SELECT m, i, CASE WHEN (SELECT count(*) FROM flow f WHERE f.m = u.m AND f.dst = u.i) = 1 AND (SELECT min(src) FROM flow f WHERE f.m = u.m AND f.dst = u.i) = i - 1
            AND (SELECT count(*) FROM flow f WHERE f.m = u.m AND f.src = u.i - 1) = 1 THEN 0 ELSE 1 END AS leads FROM u),
    placed AS (SELECT m, i, sum(leads) OVER (PARTITION BY m ORDER BY i) - 1 AS block FROM led),
    units AS (SELECT m, block, string_agg(i, ',' ORDER BY i) AS units, max(i) AS last FROM placed GROUP BY m, block),
    onward AS (SELECT DISTINCT units.m, units.block, d.block AS dst FROM units JOIN flow ON flow.m = units.m AND flow.src = units.last JOIN placed d ON d.m = flow.m AND d.i = flow.dst)
    SELECT units.m AS o_orderkey, CAST(units.block AS INTEGER) AS block, units, coalesce((SELECT string_agg(dst, ',' ORDER BY dst) FROM onward o WHERE o.m = units.m AND o.block = units.block), '') AS successors FROM units
""")
def block_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a method with jumps, ends and loops: its blocks, those that nothing reaches among them."""
    w = Window.partitionBy("l_orderkey")
    line = table(spark, sf_dir, "lineitem")
    at = line.select(F.col("l_orderkey").alias("method_id"), F.row_number().over(w.orderBy(*_ORDER.split(", "))).cast("long").alias("unit_id"), F.count("*").over(w).alias("n"), (F.col("l_quantity") > 45).alias("jumps"), (F.col("l_returnflag") == "R").alias("ends"), (F.col("l_linenumber") % 3 == 0).alias("loops"))
    i = F.col("unit_id")
    ways = F.array(F.when((i < F.col("n")) & ~F.col("ends"), i + 1), F.when((i + 2 <= F.col("n")) & F.col("jumps"), i + 2), F.when(F.col("loops") & (i > 1), F.lit(1).cast("long")))
    flow = at.select("method_id", i.alias("src"), F.explode(F.filter(ways, lambda x: x.isNotNull())).alias("dst"))
    placed, edges = basic_blocks(at.select("method_id", "unit_id", i.alias("ordinal")), flow)

    def joined(c: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x.cast("string")), ",")

    units = placed.groupBy("method_id", "block").agg(joined("unit_id").alias("units"))
    onward = edges.groupBy("method_id", F.col("src").alias("block")).agg(joined("dst").alias("successors"))
    return units.join(onward, ["method_id", "block"], "left").select(F.col("method_id").alias("o_orderkey"), "block", "units", F.coalesce("successors", F.lit("")).alias("successors"))
