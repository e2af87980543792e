"""Coverage of selected relations against expected ones, from tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.relations import metrics

STATUSES = ("passed", "revised", "unavailable", "disabled")


def coverage_by_unit(units: DataFrame, selected: DataFrame, expected: DataFrame, unit: list[str], element: list[str]) -> DataFrame:
    """Metrics for each row of ``units``, also where both sets are empty.

    The sets are tables with the columns of ``unit`` and ``element``; repeated rows
    count once. Both sides go through one aggregate of flags, so a set is never held
    as a whole.
    """
    both = selected.select(*unit, *element).withColumn("s", F.lit(1)).withColumn("e", F.lit(0)).unionByName(expected.select(*unit, *element).withColumn("s", F.lit(0)).withColumn("e", F.lit(1)))
    flags = both.groupBy(*unit, *element).agg(F.max("s").alias("s"), F.max("e").alias("e"))
    counts = flags.groupBy(*unit).agg(F.sum(F.col("s") * F.col("e")).alias("m"), F.sum("s").alias("s"), F.sum("e").alias("e"))
    joined = units.select(*unit).distinct().join(counts, unit, "left")
    none = F.lit(0).cast("long")
    return joined.select(*unit, metrics(*(F.coalesce(c, none) for c in ("m", "s", "e"))).alias("metrics")).select(*unit, "metrics.*")


def routed(verified: DataFrame, threshold: float = 0.5, drc: str = "drc", n_invalid: str = "n_invalid", available: str = "available") -> DataFrame:
    """Adds ``status``: without static relations unavailable, with malformed ones or too low a coverage revised, else passed."""
    if not 0 <= threshold <= 1:
        raise ValueError("the threshold lies between 0 and 1")
    status = F.when(~F.col(available), "unavailable").when((F.col(n_invalid) > 0) | (F.col(drc) < threshold), "revised").otherwise("passed")
    return verified.withColumn("status", status)


def status_counts(rows: DataFrame, by: list[str], status: str = "status") -> DataFrame:
    """A column for each known status, 0 where there are none, and ``other`` for any further one."""
    known = [F.count_if(F.col(status) == s).alias(s) for s in STATUSES]
    return rows.groupBy(*by).agg(*known, F.count_if(~F.col(status).isin(*STATUSES)).alias("other"))
