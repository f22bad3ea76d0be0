"""Calibration error and classification metrics from counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactlens.functions.calibration import bin_index


def _bins(pairs: DataFrame, n_bins: int) -> DataFrame:
    return pairs.groupBy(bin_index(F.col("confidence"), n_bins).alias("bin")).agg(
        F.count("*").alias("n"), F.sum("confidence").alias("_conf"), F.count_if("correct").alias("_ok"))


def reliability_bins(pairs: DataFrame, n_bins: int = 10) -> DataFrame:
    """(bin, n, avg_confidence, accuracy) of non-empty equal-width confidence bins."""
    return _bins(pairs, n_bins).select(
        "bin", "n",
        F.bround(F.col("_conf") / F.col("n"), 6).alias("avg_confidence"),
        F.bround(F.col("_ok") / F.col("n"), 6).alias("accuracy"))


def ece(pairs: DataFrame, n_bins: int = 10) -> DataFrame:
    """One row: expected calibration error to four decimals, 0.0 without pairs."""
    gap = F.abs(F.col("_conf") / F.col("n") - F.col("_ok") / F.col("n"))
    total = _bins(pairs, n_bins).agg(F.sum(F.col("n") * gap).alias("_gap"), F.sum("n").alias("_n"))
    return total.select(F.coalesce(F.bround(F.col("_gap") / F.col("_n"), 4), F.lit(0.0)).alias("ece"))


def confusion(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    return df.groupBy(F.col(y_true).alias("y_true"), F.col(y_pred).alias("y_pred")).agg(F.count("*").alias("n"))


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _per_class(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    """Unrounded precision, recall, F1 and support; works on the k x k confusion counts."""
    cells = confusion(df, y_true, y_pred)
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(F.lit(0))
    sides = cells.select(F.inline(F.array(
        F.struct(F.col("y_true").alias("label"), F.col("n").alias("sup"), F.lit(0).cast("bigint").alias("pred"),
                 hit.alias("tp")),
        F.struct(F.col("y_pred").alias("label"), F.lit(0).cast("bigint").alias("sup"), F.col("n").alias("pred"),
                 F.lit(0).cast("bigint").alias("tp")))))
    sums = sides.groupBy("label").agg(F.sum("sup").alias("support"), F.sum("pred").alias("predicted"),
                                      F.sum("tp").alias("tp"))
    rated = sums.withColumns({"precision": _ratio(F.col("tp"), F.col("predicted")),
                              "recall": _ratio(F.col("tp"), F.col("support"))})
    return rated.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"),
                                         F.col("precision") + F.col("recall")))


def classification_report(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Per-class precision, recall, F1 (zero division gives 0) and support."""
    return _per_class(df, y_true, y_pred).select(
        "label", *[F.bround(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


def f1_summary(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """One row: accuracy, macro-F1, weighted-F1 and the number of rows."""
    total = F.sum("support")
    return _per_class(df, y_true, y_pred).agg(
        F.bround(F.sum("tp") / total, 6).alias("accuracy"),
        F.bround(F.avg("f1"), 6).alias("macro_f1"),
        F.bround(F.sum(F.col("f1") * F.col("support")) / total, 6).alias("weighted_f1"),
        total.alias("n"))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, n, weight): balanced weights n / (k * n_c); totals come from the class counts."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    every = Window.partitionBy()
    return counts.select(
        label, "n", (F.sum("n").over(every) / (F.count("*").over(every) * F.col("n"))).alias("weight"))
