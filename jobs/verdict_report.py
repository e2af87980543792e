"""Verdicts on text reports, and how they fare against labels: a batch job.

    python -m jobs.verdict_report --documents D --labels L --output OUT [--config FILE]

Reads ``documents`` (doc_id, text, lang, source) and ``labels`` (doc_id and the column
that the configuration names). Writes

* ``OUT/verdicts``, partitioned by lang: a row for each document with its prediction
  (1 where listed terms stand in its text often enough), its label and its status;
* ``OUT/scorecards``, partitioned by lang: counts and ratios for each group, computed
  from the verdicts as they were written.

A document without text, or with more tokens than are allowed, has no prediction; one
without a label, or with contradicting ones, is not scored. A repeated id counts once,
by its least fingerprint. Without a language the partition is ``unknown``. Both tables
are replaced as a whole, so a rerun, also after a run that broke off, gives the same.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs.common import LOG, configured, hits, logged
from quillon.functions.scalars import fingerprint, token_estimate
from quillon.operators.evaluation import confusion, merged_labels
from quillon.operators.ordering import first_wins

VERDICTS = "doc_id long, source string, label int, prediction int, hits long, tokens long, fingerprint string, status string, lang string"


def verdicts(documents: DataFrame, labels: DataFrame, config: dict) -> DataFrame:
    """``doc_id, source, label, prediction, hits, tokens, fingerprint, status, lang``; texts are not shuffled."""
    text = F.coalesce("text", F.lit(""))
    empty = F.trim(text) == ""
    seen = documents.select(
        "doc_id",
        fingerprint(text).alias("fingerprint"),
        F.coalesce(F.nullif(F.col("lang"), F.lit("")), F.lit("unknown")).alias("lang"),
        F.coalesce("source", F.lit("")).alias("source"),
        hits(text, config["terms"]).alias("hits"),
        F.when(empty, 0).otherwise(token_estimate(text)).cast("long").alias("tokens"),
    )
    once = first_wins(seen, ["doc_id"], ["fingerprint"])
    named = labels.select(F.col("doc_id").alias("sha256"), F.col(config["label"]).alias("label")).where("label IS NOT NULL")
    known = merged_labels(named).withColumnRenamed("sha256", "doc_id")
    problem = F.when(F.col("tokens") == 0, "no text").when(F.col("tokens") > config["max_tokens"], "over budget")
    status = F.coalesce(problem, F.when(F.col("label").isNull(), "unlabelled").when(F.col("conflict"), "conflict"), F.lit("scored"))
    return once.join(known, "doc_id", "left").select(
        "doc_id",
        "source",
        F.col("label").cast("int").alias("label"),
        F.when(problem.isNull(), (F.col("hits") >= config["min_hits"]).cast("int")).alias("prediction"),
        "hits",
        "tokens",
        "fingerprint",
        status.alias("status"),
        "lang",
    )


def scorecards(rows: DataFrame, by: list[str]) -> DataFrame:
    """Counts and ratios of each group; documents without a label, or with two, are left out, those without a prediction are missing."""
    samples = rows.where("label IS NOT NULL AND status <> 'conflict'")
    return confusion(samples, rows.where("prediction IS NOT NULL"), "doc_id", by=by)


def run(spark: SparkSession, documents: str, labels: str, output: str, config: dict | None = None) -> None:
    """Reads both tables, writes verdicts and scorecards, and logs how many rows were read and written."""
    config = config or configured("verdict_report")
    if "lang" not in config["by"]:
        raise ValueError("scorecards are partitioned by lang, which must be among the groups")
    read, wrote, scored = (Observation(n) for n in ("read", "verdicts", "scorecards"))
    docs = spark.read.parquet(documents).select("doc_id", "text", "lang", "source").observe(read, F.count(F.lit(1)).alias("rows"))
    made = verdicts(docs, spark.read.parquet(labels), config).observe(wrote, F.count(F.lit(1)).alias("rows"), F.count("prediction").alias("predicted"), F.count_if(F.col("status") == "scored").alias("scored"))
    made.write.mode("overwrite").partitionBy("lang").parquet(f"{output}/verdicts")
    LOG.info("read %d documents of %s and the labels of %s", read.get["rows"], documents, labels)
    LOG.info("wrote %(rows)d verdicts, %(predicted)d predicted, %(scored)d scored", wrote.get)
    cards = scorecards(spark.read.schema(VERDICTS).parquet(f"{output}/verdicts"), config["by"]).observe(scored, F.count(F.lit(1)).alias("rows"))
    cards.write.mode("overwrite").partitionBy("lang").parquet(f"{output}/scorecards")
    LOG.info("wrote %d scorecards to %s", scored.get["rows"], output)


def main(argv: list[str] | None = None) -> int:
    a = argparse.ArgumentParser(prog="jobs.verdict_report", description=__doc__.splitlines()[0])
    for name in ("documents", "labels", "output"):
        a.add_argument(f"--{name}", required=True)
    a.add_argument("--config", help="a JSON file with settings in place of those of verdict_report.json")
    args = a.parse_args(argv)
    logged()
    from quillon.session import session

    spark = session("verdict_report")
    try:
        run(spark, args.documents, args.labels, args.output, configured("verdict_report", args.config))
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
