"""What model sessions cost and say, kept up to date as their turns arrive: an incremental job.

    python -m jobs.session_ledger --conversations C --output OUT --checkpoint CP [--config FILE]

Streams the Parquet files of ``conversations`` (conv_id, turn, role, text; a folder, or a
pattern of folders or files) that no earlier run has taken, and ends when there are no
more. Writes

* ``OUT/ledger``, partitioned by bucket (a range of conv_id) and batch: tokens, listed terms
  and a fingerprint of each turn;
* ``OUT/sessions``, partitioned by bucket: what the turns of each session come to.

The checkpoint says which files are done. A batch replaces its own partitions of the ledger
and then the sessions of the buckets that it touches, so one that broke off is done again
with the same result. A turn that arrives again counts once, as it first came; within a
batch the least fingerprint counts. Turns without a conv_id are counted in the log and left
out; a null text is empty.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import LOG, configured, hits, logged
from quillon.functions.scalars import fingerprint, token_estimate
from quillon.operators.ordering import first_wins

LEDGER = "conv_id long, turn long, role string, tokens long, hits long, fingerprint string, bucket long, batch long"
SESSIONS = "conv_id long, turns long, requests long, input_tokens long, output_tokens long, over_budget boolean, repeated long, first_turn long, last_turn long, flagged_turns long, prediction string, bucket long"


def entries(turns: DataFrame, config: dict) -> DataFrame:
    """The ledger's columns but for the batch, of turns with a conv_id."""
    text = F.coalesce("text", F.lit(""))
    return turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        token_estimate(text).alias("tokens"),
        hits(text, config["terms"]).alias("hits"),
        fingerprint(text).alias("fingerprint"),
        F.floor(F.col("conv_id") / config["bucket_span"]).cast("long").alias("bucket"),
    )


def sessions(ledger: DataFrame, config: dict) -> DataFrame:
    """One row a session; input is what the assistant was given, output what it said."""
    once = first_wins(ledger, ["bucket", "conv_id", "turn", "role"], ["batch", "fingerprint"])
    said, none = F.col("role") == "assistant", F.lit(0).cast("long")
    flagged = F.count_if(said & (F.col("hits") > 0))
    total = once.groupBy("bucket", "conv_id").agg(
        F.count("*").alias("turns"),
        F.count_if(F.col("role") == "user").alias("requests"),
        F.sum(F.when(~said, F.col("tokens")).otherwise(none)).alias("input_tokens"),
        F.sum(F.when(said, F.col("tokens")).otherwise(none)).alias("output_tokens"),
        (F.sum("tokens") > config["max_session_tokens"]).alias("over_budget"),
        (F.count("*") - F.count_distinct("fingerprint")).alias("repeated"),
        F.min("turn").alias("first_turn"),
        F.max("turn").alias("last_turn"),
        flagged.alias("flagged_turns"),
        F.when(flagged > 0, "MALWARE").otherwise("BENIGN").alias("prediction"),
    )
    return total.select(*(c.split()[0] for c in SESSIONS.split(", ")))


def _replaced(rows: DataFrame, path: str, *by: str) -> None:
    """Writes partitions in place of those that are there."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def run(spark: SparkSession, conversations: str, output: str, checkpoint: str, config: dict | None = None) -> int:
    """Takes what is new, waits for the stream to end, and gives the number of rows that it read."""
    config = config or configured("session_ledger")
    ledger, out = f"{output}/ledger", f"{output}/sessions"
    spark.createDataFrame([], SESSIONS).write.mode("append").partitionBy("bucket").parquet(out)  # there is a table, also before the first turn

    def add(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        _replaced(entries(batch, config).withColumn("batch", F.lit(number).cast("long")), ledger, "bucket", "batch")
        every = own.read.schema(LEDGER).parquet(ledger)
        touched = every.where(F.col("batch") == number).select("bucket").distinct()
        _replaced(sessions(every.join(touched, "bucket", "left_semi"), config), out, "bucket")
        LOG.info("batch %d: ledger and sessions written", number)

    schema = spark.read.parquet(conversations).schema
    turns = spark.readStream.schema(schema).option("maxFilesPerTrigger", config["max_files_per_batch"]).parquet(conversations)
    query = turns.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    taken = sum(p["numInputRows"] for p in query.recentProgress)
    LOG.info("read %d new turns of %s, wrote to %s", taken, conversations, output)
    return taken


def main(argv: list[str] | None = None) -> int:
    a = argparse.ArgumentParser(prog="jobs.session_ledger", description=__doc__.splitlines()[0])
    for name in ("conversations", "output", "checkpoint"):
        a.add_argument(f"--{name}", required=True)
    a.add_argument("--config", help="a JSON file with settings in place of those of session_ledger.json")
    args = a.parse_args(argv)
    logged()
    from quillon.session import session

    spark = session("session_ledger")
    try:
        run(spark, args.conversations, args.output, args.checkpoint, configured("session_ledger", args.config))
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
