"""Results as they arrive: new files of a folder into a table, each once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.functions.scalars import HASH


def arriving_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of ``sha256, prediction`` from JSON result lines; malformed ones are left out."""
    raw = spark.readStream.schema("sha256 string, prediction string").json(folder)
    said = F.upper("prediction")
    return raw.where(F.upper("sha256").rlike(HASH) & said.isin("MALWARE", "BENIGN")).select(F.upper("sha256").alias("sha256"), (said == "MALWARE").cast("int").alias("prediction"))


def append_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what is there now and ends; a later run goes on behind it."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
