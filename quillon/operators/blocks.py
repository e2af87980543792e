"""Basic blocks of methods, from degrees and a running sum over each method's units."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def basic_blocks(unit: DataFrame, cfg: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows of ``unit`` with ``block`` and ``at``, and ``method_id, src, dst`` of the edges between blocks.

    ``unit`` has method_id, unit_id, ordinal and passes its other columns on; ``cfg`` has
    method_id, src, dst. A unit leads a block unless its only edge comes from the unit
    before it, in the order of ``ordinal``, and that is the other's only edge. Blocks are
    numbered from 0, ``at`` is a unit's place in its own. A repeated edge counts as often
    as it stands; edges to units that are not there are left out. Units of a method meet
    in one task, as they are its window.
    """
    into = cfg.groupBy("method_id", F.col("dst").alias("unit_id")).agg(F.count("*").alias("__in"), F.min("src").alias("__from"))
    out = cfg.groupBy("method_id", F.col("src").alias("unit_id")).agg(F.count("*").alias("__out"))
    w = Window.partitionBy("method_id").orderBy("ordinal", "unit_id")
    known = unit.join(into, ["method_id", "unit_id"], "left").join(out, ["method_id", "unit_id"], "left")
    before = F.lag("unit_id").over(w)
    follows = (F.col("__in") == 1) & (F.col("__from") == before) & (F.lag("__out").over(w) == 1)
    led = known.withColumn("__leads", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1))
    numbered = led.withColumn("block", (F.sum("__leads").over(w) - 1).cast("int")).withColumn("__last", F.coalesce(F.lead("__leads").over(w), F.lit(1)) == 1)
    placed = numbered.withColumn("at", (F.row_number().over(Window.partitionBy("method_id", "block").orderBy("ordinal", "unit_id")) - 1).cast("int"))
    ends = numbered.where("__last").select("method_id", F.col("unit_id").alias("src"), F.col("block").alias("__b"))
    begins = numbered.select("method_id", F.col("unit_id").alias("dst"), F.col("block").alias("__d"))
    edges = cfg.select("method_id", "src", "dst").join(ends, ["method_id", "src"]).join(begins, ["method_id", "dst"])
    return placed.drop("__in", "__from", "__out", "__leads", "__last"), edges.select("method_id", F.col("__b").alias("src"), F.col("__d").alias("dst")).distinct()
