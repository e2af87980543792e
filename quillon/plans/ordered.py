"""Queries: joins, groups, orders within groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.scalars import ratio, token_estimate
from quillon.operators.ordering import batched_by_budget, callsite_names, first_wins, halved, last_wins, numbered
from quillon.operators.verdict import Recorded, RuleModel, Settings, answered, function_prompt, functions_tier, prompt_key, revision_prompt, summary_prompt
from quillon.plans.registry import query
from quillon.plans.scoring import table
from quillon.sources.predictions import to_do


@query("""
    SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49) AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < -900)
""")
def cfg_fallback_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fallback row counts only if neither of two sets has it: two anti joins."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    first = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey"))
    second = table(spark, sf_dir, "customer").where("c_acctbal < -900").select(F.col("c_custkey").alias("o_custkey"))
    return orders.join(first, "o_orderkey", "left_anti").join(second, "o_custkey", "left_anti").select("o_orderkey")


@query("SELECT p_brand, count(*) AS sites, count(DISTINCT p_partkey) AS parts FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_brand")
def catalog_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row must find its catalogue entry; a missing one is an error."""
    joined = table(spark, sf_dir, "lineitem").select("l_partkey").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey", "left")
    brand = F.coalesce("p_brand", F.raise_error(F.concat(F.lit("the catalogue lacks "), F.col("l_partkey").cast("string"))))
    return joined.groupBy(brand.alias("p_brand")).agg(F.count("*").alias("sites"), F.countDistinct("l_partkey").alias("parts"))


@query("SELECT l_orderkey, l_suppkey, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS parts FROM lineitem GROUP BY l_orderkey, l_suppkey")
def context_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered members of each context; a context is small, so its list is."""
    members = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    text = F.array_join(F.transform(members, lambda m: F.concat_ws(":", m["l_linenumber"], m["l_partkey"])), ",")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(text.alias("parts"))


_LINES = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate"


@query(f"""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'm' || l_orderkey || CASE WHEN count(*) OVER (PARTITION BY l_orderkey) = 1 THEN ''
        ELSE '__callsite_' || (row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINES}) - 1) END AS slice_name FROM lineitem
""")
def callsite_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").withColumn("m", F.concat(F.lit("m"), F.col("l_orderkey").cast("string")))
    named = callsite_names(line, ["l_orderkey"], _LINES.split(", "), "m")
    return named.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "slice_name")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS number FROM events")
def numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return numbered(events, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "number")


@query("""
    SELECT user_id, event_type, first_id, last_id FROM (
        SELECT user_id, event_type, first(event_id ORDER BY ts, event_id) AS first_id, last(event_id ORDER BY ts, event_id) AS last_id FROM events GROUP BY user_id, event_type)
""")
def first_and_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    key, order = ["user_id", "event_type"], ["ts", "event_id"]
    first = first_wins(events, key, order).select(*key, F.col("event_id").alias("first_id"))
    last = last_wins(events, key, order).select(*key, F.col("event_id").alias("last_id"))
    return first.join(last, key)


_HALF = "CASE WHEN row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) <= ceil(count(*) OVER (PARTITION BY conv_id) / 2) THEN 'L' ELSE 'R' END"


@query(f"SELECT conv_id, half, count(*) AS turns, min(turn) AS first_turn FROM (SELECT conv_id, turn, {_HALF} AS half FROM conversations) GROUP BY conv_id, half")
def half_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = halved(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn", "role"])
    return turns.groupBy("conv_id", "half").agg(F.count("*").alias("turns"), F.min("turn").alias("first_turn"))


@query("""
    WITH RECURSIVE turn AS (SELECT conv_id, turn, role, greatest(1, (octet_length(encode(coalesce(text, ''))) + 2) // 3)::BIGINT AS tokens FROM conversations),
    placed AS (SELECT *, row_number() OVER w AS i, sum(tokens) OVER w AS upto FROM turn WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role ROWS UNBOUNDED PRECEDING)),
    budget AS (SELECT max(tokens) + 50 AS most FROM turn),
    part(conv_id, batch, lo, hi, total) AS (
        SELECT conv_id, '', 1::BIGINT, count(*), sum(tokens) FROM placed GROUP BY conv_id
        UNION ALL
        SELECT p.conv_id, p.batch || side, CASE WHEN side = 'L' THEN lo ELSE m + 1 END, CASE WHEN side = 'L' THEN m ELSE hi END,
            CASE WHEN side = 'L' THEN middle.upto - first.upto + first.tokens ELSE p.total - (middle.upto - first.upto + first.tokens) END
        FROM (SELECT *, lo + (hi - lo + 2) // 2 - 1 AS m FROM part, budget WHERE total + 50 > most) p
        JOIN placed first ON first.conv_id = p.conv_id AND first.i = lo JOIN placed middle ON middle.conv_id = p.conv_id AND middle.i = m CROSS JOIN (VALUES ('L'), ('R')) sides(side)
    )
    SELECT placed.conv_id, placed.turn, placed.role, placed.tokens, part.batch
    FROM part, budget, placed WHERE part.total + 50 <= most AND placed.conv_id = part.conv_id AND placed.i BETWEEN lo AND hi
""")
def batch_by_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations halved until each part fits; also tested against a recursive function."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", token_estimate(F.coalesce("text", F.lit(""))).alias("tokens"))
    budget = turns.agg(F.max("tokens")).first()[0] or 1
    return batched_by_budget(turns, ["conv_id"], ["turn", "role"], "tokens", int(budget) + 50, overhead=50)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sha256"))
    done = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("sha256"), F.lit("rule").alias("model"))
    return to_do(keys, done, {"model": "rule"}).withColumnRenamed("sha256", "doc_id")


@query("SELECT sum(coalesce(CASE WHEN conv_id % 3 = 0 THEN NULL ELSE octet_length(encode(text)) END, greatest(1, (octet_length(encode(text)) + 2) // 3)))::BIGINT AS tokens FROM conversations")
def token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a service reports, or the estimate where it reports nothing."""
    turns = table(spark, sf_dir, "conversations")
    reported = F.when(F.col("conv_id") % 3 != 0, F.octet_length("text").cast("long"))
    return turns.agg(F.sum(F.coalesce(reported, token_estimate(F.col("text")))).alias("tokens"))


@query("""
    WITH function AS (SELECT lang, source, doc_id, contains(text, 'idiot') OR contains(text, 'scum') AS hit FROM documents),
    interface AS (SELECT lang, source, count(*) AS functions, bool_or(hit) AS hit FROM function GROUP BY lang, source)
    SELECT lang, sum(functions)::BIGINT AS functions, count(*) AS interfaces, sum(CASE WHEN hit THEN 1 ELSE 0 END)::BIGINT AS hits,
        CASE WHEN sum(CASE WHEN hit THEN 1 ELSE 0 END) / count(*) >= 0.5 THEN 'MALWARE' ELSE 'BENIGN' END AS prediction FROM interface GROUP BY lang
""")
def tiered_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions, interfaces, applications: the model's answers at the first tier, rolled up."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    said = answered(docs, "text", "answer", lambda: RuleModel(("idiot", "scum")))
    functions = said.select("lang", "source", (F.col("answer") != "Uses nothing of note").alias("hit"))
    interfaces = functions.groupBy("lang", "source").agg(F.count("*").alias("functions"), F.bool_or("hit").alias("hit"))
    share = ratio(F.count_if("hit"), F.count("*"))
    verdict = interfaces.groupBy("lang").agg(F.sum("functions").alias("functions"), F.count("*").alias("interfaces"), F.count_if("hit").alias("hits"), share.alias("share"))
    return verdict.select("lang", "functions", "interfaces", "hits", F.when(F.col("share") >= 0.5, "MALWARE").otherwise("BENIGN").alias("prediction"))


@query("""
    WITH d AS (SELECT doc_id, CASE WHEN doc_id % 11 = 10 THEN 9 ELSE doc_id % 7 END AS k FROM documents)
    SELECT doc_id, CASE k WHEN 0 THEN 'passed' WHEN 3 THEN 'unavailable' WHEN 5 THEN 'unavailable' WHEN 9 THEN 'disabled' WHEN 6 THEN 'unavailable' ELSE 'revised' END AS status,
        CASE WHEN k = 6 THEN NULL WHEN k = 9 THEN 'short ' || doc_id WHEN k = 5 THEN 'short ' || doc_id WHEN k IN (0, 3) THEN 'purpose ' || doc_id || chr(10) || chr(10) || 'flow' ELSE 'revised ' || doc_id END AS summary,
        CASE k WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 WHEN 2 THEN 1.0 WHEN 4 THEN 0.0 END AS drc, CASE k WHEN 2 THEN 1 WHEN 9 THEN NULL ELSE 0 END AS n_invalid, CASE WHEN k = 6 THEN 'no recorded answer' END AS error
    FROM d
""")
def recorded_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as functions whose answers are recorded: every way through verification and revision, without a model."""
    k = F.col("doc_id") % 7
    ident = F.col("doc_id").cast("string")
    one = F.array(F.struct(F.lit("Direct").alias("kind"), F.array(F.lit("r1")).alias("variables")))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("graph"), F.concat_ws(".", "source", ident).alias("signature"), F.when(~k.isin(3, 5, 6), one).alias("expected"))
    off = F.col("doc_id") % 11 == 10
    graph, signature = F.col("graph"), F.col("signature")
    purpose, flow = F.concat(F.lit("purpose "), ident), F.lit("flow")
    item = F.when(k == 1, '{"type":"Direct","variable":"r9"}').when(k == 2, '{"type":"Direct","variable":"r1"},{"type":"Direct","variable":"1"}').otherwise('{"type":"Direct","variable":"r1"}')
    whole = F.concat(F.lit('{"functionPurpose":"'), purpose, F.lit('","controlFlowAnalysis":"flow","relationships":['), item, F.lit("]}"))
    short = F.concat(F.lit("short "), ident)
    summary = F.when(k == 4, short).otherwise(F.concat(purpose, F.lit("\n\n"), flow))

    def recorded(prompt, answer, json_mode: bool = False):
        return F.struct(prompt_key(prompt, json_mode).alias("fingerprint"), answer.alias("answer"))

    first = F.when(k != 6, recorded(function_prompt(graph, signature), F.when(k.isin(4, 5), F.lit('{"functionPurpose": "cut')).otherwise(whole), json_mode=True))
    fallen = F.when(k.isin(4, 5) | off, recorded(summary_prompt(graph, signature), short))
    again = F.when(k.isin(1, 2, 4), recorded(revision_prompt(graph, signature, summary, F.col("expected")), F.concat(F.lit("revised "), ident)))
    answers = Recorded(docs.select(F.explode(F.array(first, fallen, again)).alias("r")).where("r IS NOT NULL").select("r.*"))
    settings = Settings(budget=1 << 40, timeout=None)
    said = functions_tier(docs.where(~off), answers, settings).unionByName(functions_tier(docs.where(off), answers, Settings(mode="no-verification", budget=1 << 40, timeout=None)))
    return said.select("doc_id", "status", "summary", F.col("metrics.drc").alias("drc"), F.size("invalid").alias("n_invalid"), "error")
