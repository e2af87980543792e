"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import decontam, html, language, licenses, lines, negatives, packing, passages, quality, secrets, simhash, warc
from quillon.llm.shared import table

_BASE_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "main.text", F.length("main.text").cast("long").alias("n_chars"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.grouped(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = language.held_out(F.col("doc_id"))
    model = language.learn(docs.where(~out))
    return language.predicted(docs.select("doc_id", "text"), model).select("doc_id", out.alias("held_out"), F.col("language.lang").alias("lang_pred"), "language.score")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_matches(table(spark, sf_dir, "documents").select("doc_id", "text"))
    named = F.transform("licenses", lambda m: F.concat_ws(":", m["license"], m["start"], m["end"], m["matched"], m["words"]))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_matches"), F.array_join(named, ",").alias("matches"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def named(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def many(kind):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("secrets", lambda s: s["kind"] != "novel")
    return found.select("doc_id", many("assign"), many("access"), many("hex"), F.sha2(named(base), 256).alias("base_sha256"), named(F.col("secrets")).alias("spans"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits.spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "hits.n_words",
        n_hit.alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("hits.items"), ","), 256).alias("items_sha256"),
        (F.size("hits.spans") > 0).alias("contaminated"),
    )


_OP6_SQL = r"""
WITH words AS (
    SELECT 'd' AS side, CAST(doc_id AS VARCHAR) AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
    UNION ALL
    SELECT 'b', CAST(item_id AS VARCHAR), regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), items AS (
    SELECT id, w, least(10, len(w)) AS n FROM words WHERE side = 'b' AND len(w) > 0
), windows AS (
    SELECT DISTINCT id AS item, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM items)
), places AS (
    SELECT id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
    FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words CROSS JOIN (SELECT DISTINCT n FROM items) WHERE side = 'd')
), found AS (
    SELECT id, i, places.n AS n, item FROM places JOIN windows ON places.n = windows.n AND places.s = windows.s
), hit AS (
    SELECT id, count(DISTINCT p) AS n_hit FROM (SELECT id, unnest(range(i, i + n)) AS p FROM found) GROUP BY id
), of AS (
    SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT id, item FROM found) GROUP BY id
)
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM documents JOIN words ON side = 'd' AND words.id = CAST(doc_id AS VARCHAR) LEFT JOIN hit ON hit.id = words.id LEFT JOIN of ON of.id = words.id
"""


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judged(table(spark, sf_dir, "documents").select("doc_id", "text"), measures=_BASE_MEASURES)
    base_failed = F.expr("verdict.n_words < 20 OR 100 * verdict.n_repeat_words > 30 * verdict.n_words")
    return found.select("doc_id", *(f"verdict.{m}" for m in _BASE_MEASURES), base_failed.alias("base_failed"), (~base_failed & F.col("verdict.kept")).alias("kept"))


_OP7_SQL = r"""
WITH words AS (
    SELECT doc_id, coalesce(text, '') AS t, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), windows AS (
    SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM words)
), again AS (
    SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM windows) WHERE n > 1
), repeated AS (
    SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM again) GROUP BY doc_id
), lines AS (
    SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
    FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM words) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), measured AS (
    SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines,
        CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
        len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_stutters,
        length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^\p{L}]', '', 'g')) AS n_letters
    FROM words LEFT JOIN repeated USING (doc_id) LEFT JOIN lines USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 100 * n_symbols > 8 * word_chars OR 2 * n_dup_lines > n_lines OR 100 * n_stutters > 30 * n_words
        OR 2 * n_upper > n_letters OR word_chars > 20 * n_words OR word_chars < 2 * n_words) AS kept
FROM measured
"""

def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.packed(table(spark, sf_dir, "documents"), with_ids=False)
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", passages.digests(F.col("text"), F.col("spans")).alias("d")).select("doc_id", "d.*")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    given = docs.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))))
    return lines.deduplicated(given, min_tokens=1).select(
        "doc_id",
        (F.col("n_lines") - F.size("removed")).cast("long").alias("n_kept"),
        F.size("removed").cast("long").alias("n_removed"),
        F.array_join(F.transform("removed", lambda i: i.cast("string")), ",").alias("removed"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


_OP9_SQL = """
WITH given AS (
    SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents
), blocks AS (
    SELECT doc_id, b, n, substring(x, 2 * b + 1, 2 * 1049) AS x FROM (SELECT *, unnest(range(0, greatest(n - 49, 0), 1000)) AS b FROM given)
), windows AS (
    SELECT doc_id, b + k AS i, substring(x, 2 * k + 1, 100) AS s FROM (SELECT *, unnest(range(0, least(1000, n - 49 - b))) AS k FROM blocks)
), firsts AS (
    SELECT s, min(doc_id) AS first FROM windows GROUP BY s HAVING min(doc_id) < max(doc_id)
), gone AS (
    SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, true) AS new FROM windows JOIN firsts USING (s) WHERE doc_id > first
), spans AS (
    SELECT doc_id, min(i) AS a, max(i) + 50 AS e FROM (SELECT doc_id, i, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM gone) GROUP BY doc_id, run
), parts AS (
    SELECT doc_id, a, substring(x, 2 * before + 1, 2 * (a - before)) AS part
    FROM (SELECT doc_id, a, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM (SELECT doc_id, a, e FROM spans UNION ALL SELECT doc_id, n, n FROM given)) JOIN given USING (doc_id)
), kept AS (
    SELECT doc_id, sha256(unhex(string_agg(part, '' ORDER BY a))) AS kept_sha256 FROM parts GROUP BY doc_id
), counts AS (
    SELECT doc_id, sum(e - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id
)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, kept_sha256
FROM given JOIN kept USING (doc_id) LEFT JOIN counts USING (doc_id)
"""

_OP10_SQL = """
WITH split AS (
    SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL
), lines AS (
    SELECT doc_id, no, line, list_sort(list_distinct(list_filter(string_split(lower(line), ' '), lambda w: w <> ''))) AS s
    FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS no FROM split)
), classes AS (
    SELECT row_number() OVER () AS id, s, len(s) AS n, place FROM (SELECT s, min((doc_id, no)) AS place FROM lines WHERE len(s) > 0 GROUP BY s)
), tokens AS (
    SELECT id, n, place, unnest(s) AS w FROM classes
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY c, w) AS i FROM tokens JOIN (SELECT w, count(*) AS c FROM tokens GROUP BY w) USING (w)
), prefixes AS (
    SELECT * FROM ranked WHERE i <= n - (4 * n + 4) // 5 + 1
), pairs AS (
    SELECT DISTINCT x.id AS x, y.id AS y FROM prefixes x JOIN prefixes y ON x.w = y.w AND y.place < x.place AND 5 * y.n >= 4 * x.n AND 5 * x.n >= 4 * y.n
), alike AS (
    SELECT DISTINCT x FROM pairs JOIN classes a ON a.id = x JOIN classes b ON b.id = y WHERE 9 * len(list_intersect(a.s, b.s)) >= 4 * (a.n + b.n)
), judged AS (
    SELECT doc_id, no, line, id IS NOT NULL AND ((doc_id, no) <> place OR x IS NOT NULL) AS gone
    FROM lines LEFT JOIN classes ON classes.s = lines.s LEFT JOIN alike ON alike.x = id
), kept AS (
    SELECT doc_id, count(*) FILTER (NOT gone) AS n_kept, count(*) FILTER (gone) AS n_removed,
        coalesce(string_agg(no, ',' ORDER BY no) FILTER (gone), '') AS removed, coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT gone), '') AS text
    FROM judged GROUP BY doc_id
)
SELECT doc_id, coalesce(n_kept, 0) AS n_kept, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM documents LEFT JOIN kept USING (doc_id)
"""

def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    store = warc.Store.made(pages)
    wanted = pages.select(warc.surt(warc.uri_of(F.col("url"))).alias("surt"), "page_id")
    return store.captures(wanted, on=("surt", "page_id"), payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_OP11_SQL = """
WITH stored AS (
    SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), firsts AS (
    SELECT payload_digest, min(page_id) AS first FROM stored WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to
FROM stored LEFT JOIN firsts USING (payload_digest)
"""


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mined(spark, table(spark, sf_dir, "embeddings"))


_OP12_SQL = """
WITH usable AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, CAST(list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS DOUBLE[]) AS q
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, CAST(list_dot_product(a.q, r.q) AS BIGINT) AS score
    FROM usable a JOIN usable r ON a.vec_id % 100 = 0 AND r.vec_id <> a.vec_id
), positives AS (
    SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 5
"""

QUERIES = {"op1_main_text": op1_main_text, "op2_simhash": op2_simhash, "op3_language_id": op3_language_id, "op4_license_scan": op4_license_scan, "op5_secret_scan": op5_secret_scan, "op6_decontamination": op6_decontamination, "op7_quality_rules": op7_quality_rules, "op8_best_fit_packing": op8_best_fit_packing, "op9_suffix_dedup": op9_suffix_dedup, "op10_line_dedup": op10_line_dedup, "op11_warc": op11_warc, "op12_hard_negatives": op12_hard_negatives}
ORACLES = {"op6_decontamination": _OP6_SQL, "op7_quality_rules": _OP7_SQL, "op9_suffix_dedup": _OP9_SQL, "op10_line_dedup": _OP10_SQL, "op11_warc": _OP11_SQL, "op12_hard_negatives": _OP12_SQL}
