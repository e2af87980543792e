"""Cutting lineage so that a lost executor costs no recomputation."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only where none is set and the master is local."""
    sc = spark.sparkContext
    if (current := sc.getCheckpointDir()) is not None:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="quillon-checkpoint-")
    sc.setCheckpointDir(named)
    return named


#: Has Spark remove an execution's shuffle files at its end; fixed values, by version.
_CLEANUP = ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.shuffleDependency.fileCleanup.enabled")


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder; readers start from the files.

    The shuffle files behind it are then of no use and are removed at once, where the
    version of Spark can; the session's setting is put back.
    """
    ensure_checkpoint_dir(df.sparkSession)
    with _shuffles_removed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a plan of its own, which takes the setting


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` as Parquet in a new folder under the checkpoint folder, and that folder.

    Unlike a checkpoint, which keeps the size that Spark estimated for the plan behind it,
    the files have a size of their own; estimates of joins in a loop multiply with each round.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}"
    with _shuffles_removed(spark):
        df.select("*").write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in _CLEANUP}
    try:
        for key in before:
            spark.conf.set(key, "true")
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder on any file system that Spark writes to; one that is not there is no error."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, pattern: str) -> bool:
    """Whether a path or a pattern of paths has a file or folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    return bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at))


def release(frame: DataFrame) -> None:
    """Deletes the files behind a frame that ``durable`` gave, once nothing reads it any more."""
    plan = frame._jdf.queryExecution().analyzed()
    file = plan.rdd().getCheckpointFile() if plan.nodeName() == "LogicalRDD" else None
    if file is not None and file.isDefined():
        remove(frame.sparkSession, file.get())
