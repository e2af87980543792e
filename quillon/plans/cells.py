"""Queries: untidy cells of splits and catalogues, look-ups by file name, and texts of relations and graph nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import relations as R
from quillon.functions.scalars import binary_label, last_integer, permission_list, sha_key, stem, unfenced
from quillon.operators.graph import is_control
from quillon.plans.registry import query
from quillon.plans.scoring import table
from quillon.sources.splits import found_children, split_violations


def _text(column: str) -> Column:
    return F.col(column).cast("string")


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as a split would hold them: hashes in both cases and too short, labels in several spellings, some of them none, rows with too many cells."""
    doc = F.col("doc_id")
    digits = F.sha2(_text("doc_id"), 256)
    digits = F.when(doc % 7 == 3, F.substring(digits, 1, 63)).when(doc % 2 == 0, F.upper(digits)).otherwise(digits)
    said = F.when(doc % 5 == 0, F.concat(_text("toxic"), F.lit(".0 "))).when(doc % 5 == 1, F.lit("2")).when(doc % 5 == 2, F.concat(_text("toxic"), F.lit("e0"))).when(doc % 5 == 3, F.lit("yes")).otherwise(_text("toxic"))
    cells = table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit(" \t"), digits, F.lit(" ")).alias("sha256"), F.when(doc % 11 != 4, said).alias("label"), F.when(doc % 17 == 5, F.lit("more")).alias("_extra"))
    return cells.unionByName(cells.where("doc_id % 13 = 2"))


_SPLIT = """
    once AS (SELECT doc_id, CASE WHEN doc_id % 7 <> 3 THEN upper(sha256(doc_id::VARCHAR)) END AS sha256,
        CASE WHEN doc_id % 11 <> 4 AND doc_id % 5 NOT IN (1, 3) THEN toxic END::INT AS label, doc_id % 17 = 5 AS extra FROM labels),
    split AS (SELECT * FROM once UNION ALL SELECT * FROM once WHERE doc_id % 13 = 2)
"""


@query(f"WITH {_SPLIT} SELECT doc_id, sha256, label FROM split")
def split_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).select("doc_id", sha_key(F.col("sha256")).alias("sha256"), binary_label(F.col("label")).alias("label"))


@query(f"""
    WITH {_SPLIT}, bad AS (
        SELECT sha256, CASE WHEN extra THEN 'extra cells' WHEN sha256 IS NULL THEN 'invalid hash' WHEN label IS NULL THEN 'label is not binary' END AS problem FROM split
        UNION ALL SELECT sha256, 'repeated hash' FROM split WHERE sha256 IS NOT NULL GROUP BY sha256 HAVING count(*) > 1)
    SELECT problem, count(*) AS n, count(DISTINCT sha256) AS hashes FROM bad WHERE problem IS NOT NULL GROUP BY problem
""")
def split_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What makes the split invalid, and how often; an unreadable hash counts as none."""
    found = split_violations(_split(spark, sf_dir)).withColumn("sha256", sha_key(F.col("sha256")))
    return found.groupBy("problem").agg(F.count("*").alias("n"), F.countDistinct("sha256").alias("hashes"))


@query("""
    SELECT permission, count(*) AS interfaces, min(p_partkey) AS first FROM (
        SELECT p_partkey, unnest(CASE p_partkey % 8 WHEN 0 THEN [p_brand, p_type] WHEN 1 THEN [p_brand] WHEN 2 THEN [p_type] WHEN 4 THEN ['[''' || p_brand || ''', ' || p_type || ']']
            WHEN 6 THEN [p_name] WHEN 7 THEN [p_type, p_type] ELSE [] END) AS permission FROM part)
    GROUP BY permission
""")
def permission_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interfaces of each permission, whose cells are lists, quoted and bare scalars, empty, or lists that do not parse."""
    k = F.col("p_partkey") % 8
    cell = (
        F.when(k == 0, F.format_string("['Permission:%s', \"%s\"]", "p_brand", "p_type"))
        .when(k == 1, F.format_string(" Permission:%s ", "p_brand"))
        .when(k == 2, F.format_string("'%s'", "p_type"))
        .when(k == 3, F.lit("[]"))
        .when(k == 4, F.format_string("['%s', %s]", "p_brand", "p_type"))
        .when(k == 6, F.format_string("(' ', '%s',)", "p_name"))
        .when(k == 7, F.format_string("['%s','%s']", "p_type", "p_type"))
    )
    members = table(spark, sf_dir, "part").select("p_partkey", F.explode(permission_list(cell)).alias("permission"))
    return members.groupBy("permission").agg(F.count("*").alias("interfaces"), F.min("p_partkey").alias("first"))


@query("""
    SELECT o_orderkey, CASE WHEN o_orderkey % 4 IN (0, 1) THEN '/upper/' || upper(sha256(o_orderkey::VARCHAR)) || '.apk' WHEN o_orderkey % 4 = 2 THEN '/lower/' || sha256(o_orderkey::VARCHAR) || '.v2.apk' END AS path
    FROM (SELECT o_orderkey FROM orders)
""")
def file_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys with the file named after them in any case; of two, the one in upper case."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.sha2(_text("o_orderkey"), 256).alias("digits"))
    k = F.col("o_orderkey") % 4
    upper = orders.where(k.isin(0, 1)).select(F.concat(F.lit("/upper/"), F.upper("digits"), F.lit(".apk")).alias("path"))
    lower = orders.where(k == 1).select(F.concat(F.lit("/lower/"), F.col("digits"), F.lit(".apk")).alias("path"))
    other = orders.where(k == 2).select(F.concat(F.lit("/lower/"), F.col("digits"), F.lit(".v2.apk")).alias("path"))
    files = upper.unionByName(lower).select(stem(F.col("path")).alias("stem"), "path").unionByName(other.select(F.regexp_replace(stem(F.col("path")), r"\.v2$", "").alias("stem"), "path"))
    return found_children(orders.select("o_orderkey", F.upper("digits").alias("sha256")), files).select("o_orderkey", "path")


@query(r"""
    SELECT doc_id, m[-1]::BIGINT AS said FROM (
        SELECT doc_id, regexp_extract_all(coalesce(text, '') || CASE WHEN doc_id % 3 = 0 THEN '' ELSE chr(10) || '7' || chr(10) || ' -' || doc_id || ' ' || chr(10) || 'end 9' END, '(?m)^\s*([+-]?\d+)\s*$', 1) AS m FROM documents)
""")
def last_integers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last line of a tool's output that is an integer."""
    tail = F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("\n7\n -"), _text("doc_id"), F.lit(" \nend 9")))
    return table(spark, sf_dir, "documents").select("doc_id", last_integer(F.concat(F.coalesce("text", F.lit("")), tail)).alias("said"))


def _kinds(a: Column, b: Column) -> tuple[Column, Column]:
    k = F.col("l_linenumber") % 4
    return F.get(F.array(F.lit("Direct"), F.lit("Conditional"), F.lit("Derived"), F.lit("Parallel")), k), F.when(k < 2, F.array(a)).otherwise(F.array(a, b))


@query("""
    SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN '{"type":"Direct","variable":"b' || l_partkey || '"}' WHEN 1 THEN '{"type":"Conditional","variable":"b' || l_partkey || '"}'
        WHEN 2 THEN '{"type":"Derived","target":"b' || l_partkey || '","source":"a' || l_suppkey || '"}' ELSE '{"type":"Parallel","variables":["a' || l_suppkey || '","b' || l_partkey || '"]}' END AS json
    FROM lineitem
""")
def relation_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A relation of each kind as JSON, with the fields of its kind alone."""
    a, b = F.concat(F.lit("b"), _text("l_partkey")), F.concat(F.lit("a"), _text("l_suppkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", R.as_json(R.relation(*_kinds(a, b))).alias("json"))


@query("""
    SELECT l_orderkey, string_agg(line, chr(10) ORDER BY encode(line)) AS text FROM (
        SELECT DISTINCT l_orderkey, CASE l_linenumber % 4 WHEN 0 THEN '[Direct] r' || l_partkey % 9 WHEN 1 THEN '[Conditional] r' || l_partkey % 9
            WHEN 2 THEN '[Derived] r' || l_partkey % 9 || ' <- s' || l_suppkey % 9 ELSE '[Parallel] r' || l_partkey % 9 || ' and s' || l_suppkey % 9 || ' work together' END AS line FROM lineitem)
    GROUP BY l_orderkey
""")
def answers_to_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers in Markdown fences, read strictly and written as relation files."""
    a, b = F.concat(F.lit("r"), (F.col("l_partkey") % 9).cast("string")), F.concat(F.lit("s"), (F.col("l_suppkey") % 9).cast("string"))
    said = table(spark, sf_dir, "lineitem").select("l_orderkey", R.as_json(R.relation(*_kinds(a, b))).alias("item"))
    answers = said.groupBy("l_orderkey").agg(F.concat(F.lit("```json\n["), F.array_join(F.collect_list("item"), ",\n"), F.lit("]\n```\n")).alias("answer"))
    items = F.from_json(unfenced(F.col("answer")), f"array<{R.MODEL_ITEM}>")
    return answers.select("l_orderkey", R.file_text(R.model_set_strict(items)).alias("text"))


#: Statements of which the first six are control flow.
_STATEMENTS = ("if r1 == 0 goto label1", "goto label2", "return", "switch(r2)", "tableswitch(r3)", "lookupswitch(r4)", "r5 = if_value", "r6 = r7 + 1", " goto indented", "staticinvoke <a.B: void returnNow()>()", "nop", "r8 = gotoTable[r1]")


@query("SELECT l_orderkey, bool_or(l_partkey % 40 < 6) AS control, count(*) AS statements FROM lineitem GROUP BY l_orderkey")
def control_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of several statements, and whether one of these begins with a jump."""
    at = F.col("l_partkey") % 40
    statement = F.coalesce(F.get(F.array(*map(F.lit, _STATEMENTS)), at.cast("int")), F.concat(F.lit("r9 = r"), at.cast("string")))
    nodes = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(statement), "\n").alias("node"), F.count("*").alias("statements"))
    return nodes.select("l_orderkey", is_control(F.col("node")).alias("control"), "statements")
