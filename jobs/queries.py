"""The jobs as queries: each run twice into one new folder, and its output read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import session_ledger, verdict_report
from quillon.durable import ensure_checkpoint_dir

_RATIOS = ("precision", "recall", "f1", "fpr", "fnr")


def _folder(spark: SparkSession, job: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{job}-{uuid.uuid4().hex}"


def job1_verdict_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each verdict beside the scorecard of its group."""
    out = _folder(spark, "job1")
    for _ in range(2):
        verdict_report.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", out)
    cards = spark.read.parquet(f"{out}/scorecards").select("lang", "source", "total_expected", "missing", *_RATIOS)
    return spark.read.schema(verdict_report.VERDICTS).parquet(f"{out}/verdicts").join(cards, ["lang", "source"], "left")


_JOB1_SQL = """
WITH seen AS (
    SELECT doc_id, sha256(coalesce(text, '')) AS fingerprint, coalesce(nullif(lang, ''), 'unknown') AS lang, coalesce(source, '') AS source,
        CAST(len(regexp_extract_all(lower(coalesce(text, '')), 'idiot|scum|moron|clown|worthless')) AS BIGINT) AS hits,
        CAST(CASE WHEN trim(coalesce(text, '')) = '' THEN 0 ELSE greatest(1, (strlen(text) + 2) // 3) END AS BIGINT) AS tokens
    FROM documents
), once AS (
    SELECT * FROM seen QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY fingerprint, lang, source) = 1
), known AS (
    SELECT doc_id, max(toxic) AS label, max(toxic) <> min(toxic) AS conflict FROM labels WHERE toxic IS NOT NULL GROUP BY doc_id
), verdicts AS (
    SELECT once.doc_id, source, CAST(label AS INTEGER) AS label, CASE WHEN tokens BETWEEN 1 AND 120000 THEN CASE WHEN hits >= 1 THEN 1 ELSE 0 END END AS prediction, hits, tokens, fingerprint,
        CASE WHEN tokens = 0 THEN 'no text' WHEN tokens > 120000 THEN 'over budget' WHEN label IS NULL THEN 'unlabelled' WHEN conflict THEN 'conflict' ELSE 'scored' END AS status, lang
    FROM once LEFT JOIN known ON known.doc_id = once.doc_id
), counts AS (
    SELECT lang, source, count(*) AS total_expected, count(*) - count(prediction) AS missing, count(*) FILTER (label = 1 AND prediction = 1) AS tp, count(*) FILTER (label = 0 AND prediction = 0) AS tn,
        count(*) FILTER (label = 0 AND prediction = 1) AS fp, count(*) FILTER (label = 1 AND prediction = 0) AS fn
    FROM verdicts WHERE label IS NOT NULL AND status <> 'conflict' GROUP BY lang, source
), rated AS (
    SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall,
        CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0.0 END AS fpr, CASE WHEN fn + tp > 0 THEN fn / (fn + tp) ELSE 0.0 END AS fnr FROM counts
)
SELECT v.*, total_expected, missing, precision, recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) WHEN precision IS NOT NULL THEN 0.0 END AS f1, fpr, fnr
FROM verdicts v LEFT JOIN rated ON rated.lang = v.lang AND rated.source = v.source
"""


def job2_session_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sessions after a second run, which finds nothing new."""
    out = _folder(spark, "job2")
    for _ in range(2):
        session_ledger.run(spark, f"{sf_dir}/conversations.parque[t]", out, f"{out}/checkpoint")  # a pattern, as it may be a file or a folder
    return spark.read.schema(session_ledger.SESSIONS).parquet(f"{out}/sessions").withColumn("bucket", F.col("bucket").cast("long"))


_JOB2_SQL = """
WITH entries AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, CAST(greatest(1, (strlen(coalesce(text, '')) + 2) // 3) AS BIGINT) AS tokens,
        CAST(len(regexp_extract_all(lower(coalesce(text, '')), 'idiot|scum|moron|clown|worthless')) AS BIGINT) AS hits, sha256(coalesce(text, '')) AS fingerprint
    FROM conversations WHERE conv_id IS NOT NULL
), once AS (
    SELECT * FROM entries QUALIFY row_number() OVER (PARTITION BY conv_id, turn, role ORDER BY fingerprint) = 1
), flagged AS (
    SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') AS requests, CAST(coalesce(sum(tokens) FILTER (role <> 'assistant'), 0) AS BIGINT) AS input_tokens,
        CAST(coalesce(sum(tokens) FILTER (role = 'assistant'), 0) AS BIGINT) AS output_tokens, sum(tokens) > 2000 AS over_budget, count(*) - count(DISTINCT fingerprint) AS repeated,
        min(turn) AS first_turn, max(turn) AS last_turn, count(*) FILTER (role = 'assistant' AND hits > 0) AS flagged_turns
    FROM once GROUP BY conv_id
)
SELECT *, CASE WHEN flagged_turns > 0 THEN 'MALWARE' ELSE 'BENIGN' END AS prediction, CAST(floor(conv_id / 1000) AS BIGINT) AS bucket FROM flagged
"""

QUERIES = {"job1_verdict_report": job1_verdict_report, "job2_session_ledger": job2_session_ledger}
ORACLES = {"job1_verdict_report": _JOB1_SQL, "job2_session_ledger": _JOB2_SQL}
