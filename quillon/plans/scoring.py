"""Queries: labels, predictions, scoring, coverage, verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import relations as R
from quillon.functions.scalars import fingerprint, last_match, percent, signature_key, token_estimate, without_node_suffix
from quillon.operators.coverage import coverage_by_unit, routed, status_counts
from quillon.operators.evaluation import confusion, merged_labels
from quillon.operators.ordering import ordered_distinct
from quillon.plans.registry import query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _split_and_rule(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Labels as the split, and a rule on document length as the predictions, some of them missing."""
    split = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"), "quality")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    said = docs.where("doc_id % 10 <> 0").select("doc_id", (F.col("n_chars") > 2000).cast("int").alias("prediction"))
    return split.join(docs.select("doc_id", "lang"), "doc_id", "left"), said


_SCORED = """
    SELECT l.doc_id, l.toxic AS label, l.quality, d.lang, CASE WHEN l.doc_id % 10 <> 0 THEN CASE WHEN d.n_chars > 2000 THEN 1 ELSE 0 END END AS said
    FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id
"""
_COUNTS = """
    count(*) AS total_expected, count(said) AS evaluated, count(*) - count(said) AS missing,
    coalesce(sum(CASE WHEN label = 1 AND said = 1 THEN 1 END), 0)::BIGINT AS true_positive, coalesce(sum(CASE WHEN label = 0 AND said = 0 THEN 1 END), 0)::BIGINT AS true_negative,
    coalesce(sum(CASE WHEN label = 0 AND said = 1 THEN 1 END), 0)::BIGINT AS false_positive, coalesce(sum(CASE WHEN label = 1 AND said = 0 THEN 1 END), 0)::BIGINT AS false_negative
"""
_RATIOS = """
    SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM (
        SELECT *, CASE WHEN true_positive + false_positive > 0 THEN true_positive / (true_positive + false_positive) ELSE 0.0 END AS precision,
            CASE WHEN true_positive + false_negative > 0 THEN true_positive / (true_positive + false_negative) ELSE 0.0 END AS recall,
            CASE WHEN false_positive + true_negative > 0 THEN false_positive / (false_positive + true_negative) ELSE 0.0 END AS fpr,
            CASE WHEN false_negative + true_positive > 0 THEN false_negative / (false_negative + true_positive) ELSE 0.0 END AS fnr
        FROM counts)
"""


@query(f"WITH scored AS ({_SCORED}), counts AS (SELECT {_COUNTS} FROM scored) {_RATIOS}")
def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    split, said = _split_and_rule(spark, sf_dir)
    return confusion(split, said, "doc_id")


@query(f"WITH scored AS ({_SCORED}), counts AS (SELECT lang, quality, {_COUNTS} FROM scored GROUP BY lang, quality) {_RATIOS}")
def eval_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    split, said = _split_and_rule(spark, sf_dir)
    return confusion(split, said, "doc_id", by=["lang", "quality"])


@query(f"WITH scored AS ({_SCORED}), counts AS (SELECT {_COUNTS} FROM scored) SELECT printf('%.2f%%', 100 * f1) AS f1, printf('%.2f%%', 100 * fpr) AS fpr, printf('%.2f%%', 100 * fnr) AS fnr FROM ({_RATIOS})")
def eval_printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eval_report(spark, sf_dir).select(*(percent(F.col(c)).alias(c) for c in ("f1", "fpr", "fnr")))


@query("""
    SELECT sha256, max(label) AS label, max(label) <> min(label) AS conflict FROM (
        SELECT doc_id AS sha256, toxic AS label FROM labels WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, CASE WHEN doc_id % 50 = 1 THEN 1 - toxic ELSE toxic END FROM labels WHERE doc_id % 3 <> 2
    ) GROUP BY sha256
""")
def label_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("sha256"), F.col("toxic").alias("label"))
    flipped = labels.withColumn("label", F.when(F.col("sha256") % 50 == 1, 1 - F.col("label")).otherwise(F.col("label")))
    return merged_labels(labels.where("sha256 % 3 <> 0"), flipped.where("sha256 % 3 <> 2"))


@query("SELECT o_custkey FROM (SELECT o_custkey, min(o_orderkey) AS first FROM orders GROUP BY o_custkey ORDER BY first, o_custkey LIMIT 25)")
def target_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit is the operator: the first 25 of many distinct keys in their order."""
    return ordered_distinct(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", ["o_orderkey"], limit=25)


@query("SELECT doc_id, m[-1] AS said FROM (SELECT doc_id, regexp_extract_all(text, '([a-z]+)\\.', 1) AS m FROM documents) WHERE len(m) > 0")
def last_match_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", last_match(F.col("text"), r"([a-z]+)\.").alias("said")).where("said IS NOT NULL")


@query("SELECT page_id, trim(regexp_replace(url || '---' || page_id, '---[0-9]+', '', 'g')) AS node FROM pages")
def strip_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", without_node_suffix(F.concat("url", F.lit("---"), F.col("page_id").cast("string"))).alias("node"))


@query("SELECT doc_id, greatest(1, (octet_length(encode(text)) + 2) // 3)::BIGINT AS tokens FROM documents")
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", token_estimate(F.col("text")).alias("tokens"))


@query("SELECT doc_id, sha256(concat_ws(chr(31), coalesce(text, ''), coalesce(lang, ''), coalesce(source, ''), 'rule')) AS fingerprint FROM documents")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", fingerprint(F.col("text"), F.col("lang"), F.col("source"), F.lit("rule")).alias("fingerprint"))


@query("SELECT p_partkey, split_part(regexp_replace('<' || p_name || '(' || p_size || ')>', '^<', ''), '(', 1) AS signature FROM part")
def signature_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", signature_key(F.concat(F.lit("<"), F.col("p_name"), F.lit("("), F.col("p_size").cast("string"), F.lit(")>"))).alias("signature"))


@query("""
    WITH sets AS (SELECT l_orderkey AS k, l_linenumber % 4 = 1 OR l_quantity > 25 AS s, l_discount > 0.03 AS e, l_partkey AS v FROM lineitem),
    flags AS (SELECT k, v, max(CASE WHEN s THEN 1 ELSE 0 END) AS s, max(CASE WHEN e THEN 1 ELSE 0 END) AS e FROM sets GROUP BY k, v),
    counts AS (SELECT k, sum(s * e) AS m, sum(s) AS s, sum(e) AS e FROM flags GROUP BY k),
    every AS (SELECT o_orderkey, coalesce(m, 0)::BIGINT AS matches, coalesce(s, 0)::BIGINT AS selected, coalesce(e, 0)::BIGINT AS expected FROM orders LEFT JOIN counts ON k = o_orderkey),
    rated AS (SELECT *, CASE WHEN selected > 0 THEN matches / selected WHEN expected = 0 THEN 1.0 ELSE 0.0 END AS drc, CASE WHEN expected > 0 THEN matches / expected ELSE 1.0 END AS recall FROM every)
    SELECT *, CASE WHEN drc + recall > 0 THEN 2 * drc * recall / (drc + recall) ELSE 0.0 END AS f1 FROM rated
""")
def drc_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = table(spark, sf_dir, "orders").select("o_orderkey")
    line = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    selected = line.where((F.col("l_linenumber") % 4 == 1) | (F.col("l_quantity") > 25))
    return coverage_by_unit(units, selected, line.where("l_discount > 0.03"), ["o_orderkey"], ["l_partkey"])


_STATUS = "SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 17 = 0 THEN 'unavailable' WHEN o_orderkey % 5 = 0 OR (o_orderkey % 11) / 10 < 0.5 THEN 'revised' ELSE 'passed' END AS status FROM orders"


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    key = F.col("o_orderkey")
    facts = orders.withColumns({"drc": key % 11 / 10, "n_invalid": (key % 5 == 0).cast("int"), "available": key % 17 != 0})
    return routed(facts)


@query(_STATUS)
def verify_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(spark, sf_dir).select("o_orderkey", "o_orderpriority", "status")


@query(f"""
    SELECT o_orderpriority, sum(CASE WHEN status = 'passed' THEN 1 ELSE 0 END)::BIGINT AS passed, sum(CASE WHEN status = 'revised' THEN 1 ELSE 0 END)::BIGINT AS revised,
        sum(CASE WHEN status = 'unavailable' THEN 1 ELSE 0 END)::BIGINT AS unavailable, 0::BIGINT AS disabled, 0::BIGINT AS other FROM ({_STATUS}) GROUP BY o_orderpriority
""")
def verify_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status_counts(_routed(spark, sf_dir), ["o_orderpriority"])


@query("SELECT event_type AS status, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def status_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


_RELATION = """
    SELECT DISTINCT l_orderkey, CASE l_linenumber % 4 WHEN 0 THEN 'Direct' WHEN 1 THEN 'Transitive' WHEN 2 THEN 'Conditional' ELSE 'Derived' END AS kind,
        CASE WHEN l_linenumber % 4 = 3 THEN ['r' || (l_partkey % 100), 'r' || (l_suppkey % 100)] ELSE ['r' || (l_partkey % 100)] END AS variables FROM lineitem
"""


@query(f"SELECT l_orderkey, kind, array_to_string(variables, ',') AS variables FROM ({_RELATION})")
def relation_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as relation files hold them, with their spellings, written for each order and parsed back."""
    line = table(spark, sf_dir, "lineitem")
    kind = F.get(F.array(F.lit("Direct"), F.lit("TRANSITIVE"), F.lit("conditional"), F.lit("Inheritance")), F.col("l_linenumber") % 4)
    a, b = (F.concat(F.lit("r"), (F.col(c) % 100).cast("string")) for c in ("l_partkey", "l_suppkey"))
    text = F.concat(F.lit("["), kind, F.lit("] "), F.when(F.col("l_linenumber") % 4 == 3, F.concat(a, F.lit(" <- "), b)).otherwise(a))
    files = line.groupBy("l_orderkey").agg(F.array_join(F.collect_list(text), "\n").alias("text"))
    found = files.select("l_orderkey", F.explode(R.static_set(F.col("text"))).alias("r"))
    return found.select("l_orderkey", "r.kind", F.array_join("r.variables", ",").alias("variables"))


@query("""
    SELECT l_orderkey, '[Parallel] ' || array_to_string(v, ' and ') || ' work together' AS line
    FROM (SELECT l_orderkey, list_sort(list(DISTINCT 'r' || l_partkey)) AS v FROM lineitem GROUP BY l_orderkey) WHERE len(v) >= 2
""")
def parallel_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.collect_set(F.concat(F.lit("r"), F.col("l_partkey").cast("string")))
    grouped = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(names.alias("v"))
    made = grouped.select("l_orderkey", R.relation(F.lit("Parallel"), F.col("v")).alias("r")).where("r IS NOT NULL")
    return made.select("l_orderkey", R.formatted(F.col("r")).alias("line"))


@query("""
    SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'Direct' WHEN event_id % 4 = 1 AND event_id % 3 <> 0 THEN 'Derived' WHEN event_id % 4 = 2 THEN 'Parallel' END AS kind,
        CASE WHEN event_id % 4 = 0 THEN 'r' || (user_id % 50) WHEN event_id % 4 = 1 AND event_id % 3 <> 0 THEN 'r1,r' || (user_id % 50) WHEN event_id % 4 = 2 THEN 'a1,b' || (user_id % 50) END AS variables,
        CASE WHEN event_id % 4 = 3 OR event_id % 4 = 1 AND event_id % 3 = 0 THEN 1 ELSE 0 END AS n_invalid FROM events
""")
def tolerant_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers as JSON, some malformed: valid relations and the count of the others."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id")
    name = F.concat(F.lit("r"), (F.col("user_id") % 50).cast("string"))
    other = F.concat(F.lit("b"), (F.col("user_id") % 50).cast("string"))
    k = F.col("event_id") % 4
    item = (
        F.when(k == 0, F.concat(F.lit('[{"type":"Direct","variable":"'), name, F.lit('"}]')))
        .when(k == 1, F.concat(F.lit('[{"type":"derived","target":"r1","source":"'), F.when(F.col("event_id") % 3 == 0, F.lit("1.5")).otherwise(name), F.lit('"}]')))
        .when(k == 2, F.concat(F.lit('[{"type":"Parallel","left":"'), other, F.lit('","right":"a1"}]')))
        .otherwise(F.lit('[{"type":"Unknown","variable":"r1"}]'))
    )
    parsed = events.withColumn("items", F.from_json(item, f"array<{R.MODEL_ITEM}>"))
    first = F.get(R.model_set(F.col("items")), F.lit(0))
    return parsed.select("event_id", first["kind"].alias("kind"), F.array_join(first["variables"], ",").alias("variables"), F.size(R.model_invalid(F.col("items"))).alias("n_invalid"))
