"""Scoring of binary verdicts against labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.scalars import ratio


def confusion(samples: DataFrame, predictions: DataFrame, key: str, by: list[str] | None = None, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Counts and ratios, one row in all or one for each group of ``by`` (columns of ``samples``).

    Samples without a prediction count as missing, predictions without a sample are
    ignored. The positive class is 1. A ratio without a denominator is 0. One left
    join and one aggregate, combined before the shuffle.
    """
    joined = samples.select(key, label, *(by or [])).join(predictions.select(key, F.col(prediction).alias("said")), key, "left")
    said, truth = F.col("said"), F.col(label)

    def cell(t: int, s: int, name: str):
        return F.count_if((truth == t) & (said == s)).alias(name)

    counted = joined.groupBy(*(by or [])).agg(
        F.count("*").alias("total_expected"),
        F.count("said").alias("evaluated"),
        cell(1, 1, "true_positive"),
        cell(0, 0, "true_negative"),
        cell(0, 1, "false_positive"),
        cell(1, 0, "false_negative"),
    )
    tp, tn, fp, fn = (F.col(c) for c in ("true_positive", "true_negative", "false_positive", "false_negative"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    with_ratios = counted.withColumns({"missing": F.col("total_expected") - F.col("evaluated"), "precision": precision, "recall": recall, "fpr": ratio(fp, fp + tn), "fnr": ratio(fn, fn + tp)})
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0))
    return with_ratios.withColumn("f1", f1)


def require_complete(report: DataFrame, allow_missing: bool = False) -> DataFrame:
    """The report, or an error when it is computed if samples have no prediction and must have one."""
    if allow_missing:
        return report
    return report.withColumn("missing", F.when(F.col("missing") > 0, F.raise_error(F.concat(F.lit("samples without a prediction: "), F.col("missing").cast("string"))).cast("long")).otherwise(F.col("missing")))


def merged_labels(*splits: DataFrame) -> DataFrame:
    """``sha256, label, conflict`` over several splits; a conflict is a key with both labels."""
    every = splits[0].select("sha256", "label")
    for s in splits[1:]:
        every = every.unionByName(s.select("sha256", "label"))
    return every.groupBy("sha256").agg(F.max("label").alias("label"), (F.max("label") != F.min("label")).alias("conflict"))
