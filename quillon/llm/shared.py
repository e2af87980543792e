"""What several operators of this subpackage use."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows whose texts a task holds as Python objects at a time.
SLICE_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(column: pa.Array, rows: int = SLICE_ROWS) -> Iterator[list[str | None]]:
    """The values of an Arrow string column, a bounded number at a time."""
    for at in range(0, len(column), rows):
        yield column.slice(at, rows).to_pylist()


def byte_texts(column: pa.Array, rows: int = SLICE_ROWS) -> Iterator[list[bytes | None]]:
    """Like ``texts``, as UTF-8 bytes without decoding them."""
    for at in range(0, len(column), rows):
        yield column.slice(at, rows).cast(pa.binary()).to_pylist()


def stored_bytes(df: DataFrame) -> int:
    """What the optimizer knows of the size of a frame's sources in bytes; 0 where it knows nothing."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or with underscores before it if the frame has such a column (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted
