"""Report tables behind the figures (V1-V5): label clean-up, metric
matrices, grand-average bars with a baseline pair, and the parity profile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .agreement import PAIRS, TOTAL_ROW

BASELINE_PAIR = "SHAP-LIME"


def clean_label(col) -> Column:
    """V1: strip a trailing '.csv', underscores -> spaces, trim."""
    c = F.col(col) if isinstance(col, str) else col
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\.csv$", ""), "_", " "))


def metric_matrix(summary_long: DataFrame, metric: str, pairs=PAIRS) -> DataFrame:
    """V2/V3: dataset x pair matrix of one metric, total row excluded."""
    names = [p for _, _, p in pairs]
    return summary_long.where((F.col("metric") == metric) & (F.col("dataset") != TOTAL_ROW)) \
        .groupBy("dataset").pivot("pair", names).agg(F.first("value"))


def baseline_bars(summary_long: DataFrame, baseline_pair: str = BASELINE_PAIR) -> DataFrame:
    """V4: every (metric, pair) of the total row with the baseline pair's
    value of the same metric alongside."""
    total = summary_long.where(F.col("dataset") == TOTAL_ROW)
    base = total.where(F.col("pair") == baseline_pair).select("metric", F.col("value").alias("baseline"))
    return total.join(base, "metric", "left").select(
        "metric", "pair", "value", "baseline", (F.col("value") - F.col("baseline")).alias("diff_to_baseline"))


def parity_profile(summary_long: DataFrame, metric: str = "Spearman", left_pair: str = "Rulex-SHAP",
                   right_pair: str = BASELINE_PAIR) -> DataFrame:
    """V5: per dataset the two pairs side by side, which one is higher, and
    both grand means (windows over the small per-dataset table)."""
    d = summary_long.where((F.col("metric") == metric) & (F.col("dataset") != TOTAL_ROW))
    a = d.where(F.col("pair") == left_pair).select("dataset", F.col("value").alias("left_value"))
    b = d.where(F.col("pair") == right_pair).select("dataset", F.col("value").alias("right_value"))
    w = Window.partitionBy()
    return a.join(b, "dataset", "full_outer").select(
        "dataset", "left_value", "right_value",
        F.signum(F.col("left_value") - F.col("right_value")).cast("int").alias("sign"),
        F.avg("left_value").over(w).alias("left_mean"), F.avg("right_value").over(w).alias("right_mean"))
