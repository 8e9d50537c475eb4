"""Model-quality metrics (G1-G5) over long prediction tables.

Input grain: one row per scored example with a group key (e.g. dataset,
target, classifier), the true label, the predicted label and a score whose
order defines the ROC curve. Every metric is a grouped aggregate; AUROC uses
distinct-score counts and a distributed running total, never a global sort
in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import prefix_sums


def accuracy(df: DataFrame, key: Sequence[str], label="label", pred="prediction") -> DataFrame:
    return df.groupBy(*key).agg(
        F.avg((F.col(label) == F.col(pred)).cast("double")).alias("accuracy"),
        F.count(F.lit(1)).alias("n"))


def weighted_f1(df: DataFrame, key: Sequence[str], label="label", pred="prediction") -> DataFrame:
    """Per-class F1 weighted by true-class support; zero division -> 0."""
    key = list(key)
    conf = df.groupBy(*key, F.col(label).alias("l"), F.col(pred).alias("p")).count()
    by_label = conf.groupBy(*key, F.col("l").alias("c")).agg(
        F.sum("count").alias("support"),
        F.sum(F.when(F.col("l") == F.col("p"), F.col("count")).otherwise(0)).alias("tp"))
    by_pred = conf.groupBy(*key, F.col("p").alias("c")).agg(F.sum("count").alias("predicted"))
    per = by_label.join(by_pred, key + ["c"], "full_outer").select(
        *key, "c", F.coalesce("support", F.lit(0)).alias("support"),
        F.coalesce("tp", F.lit(0)).alias("tp"), F.coalesce("predicted", F.lit(0)).alias("predicted"))
    den = F.col("support") + F.col("predicted")
    f1 = F.when(den > 0, 2.0 * F.col("tp") / den).otherwise(F.lit(0.0))
    return per.groupBy(*key).agg(
        (F.sum(f1 * F.col("support")) / F.sum("support")).alias("f1_weighted"))


def auroc(df: DataFrame, key: Sequence[str], label="label", score="score") -> DataFrame:
    """Mann-Whitney AUROC with mid-ranks for tied scores; NULL with one class."""
    key = list(key)
    per_score = df.groupBy(*key, F.col(score).alias("s")).agg(
        F.sum((F.col(label) == 1).cast("bigint")).alias("pos"),
        F.sum((F.col(label) != 1).cast("bigint")).alias("neg"))
    cum = prefix_sums(per_score, [F.col("s").asc()], {"neg_below": F.col("neg")},
                      partition_cols=key, inclusive=False)
    return cum.groupBy(*key).agg(
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"),
        F.sum(F.col("pos") * (F.col("neg_below") + 0.5 * F.col("neg"))).alias("u")) \
        .select(*key, F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0),
                             F.col("u") / (F.col("n_pos").cast("double") * F.col("n_neg"))).alias("auroc"))


def metric_rows(df: DataFrame, key: Sequence[str], label="label", pred="prediction",
                score="score", n_train: DataFrame | None = None, digits: int = 4) -> DataFrame:
    """One row per group with accuracy, weighted F1, AUROC rounded to ``digits``."""
    key = list(key)
    a = accuracy(df, key, label, pred)
    f = weighted_f1(df, key, label, pred)
    r = auroc(df, key, label, score)
    out = a.join(f, key).join(r, key).select(
        *key, F.col("n").alias("n_test"),
        F.round("accuracy", digits).alias("accuracy"),
        F.round("f1_weighted", digits).alias("f1_weighted"),
        F.round("auroc", digits).alias("auroc"))
    if n_train is not None:
        out = out.join(n_train, key, "left")
    return out


def averaged_row(rows: DataFrame, group: Sequence[str], label_col: str, label: str,
                 metrics: Sequence[str] = ("accuracy", "f1_weighted", "auroc"),
                 digits: int = 4, keep_detail: bool = True) -> DataFrame:
    """Mean of the already-rounded per-target rows (NULL AUROC skipped)."""
    group = list(group)
    scale = 10 ** digits

    def mean_of_rounded(m):
        # the inputs are exact multiples of 10^-digits: sum them as integers
        # and divide once, so the result (and its rounding) does not depend on
        # the order in which partial sums arrive
        units = F.sum(F.round(F.col(m) * scale).cast("bigint")).cast("double")
        return F.round(units / F.count(m)) / F.lit(float(scale))

    avg = rows.groupBy(*group).agg(
        *[mean_of_rounded(m).alias(m) for m in metrics],
        *[F.max(c).alias(c) for c in rows.columns if c in ("n_test", "n_train")]) \
        .withColumn(label_col, F.lit(label))
    if not keep_detail:
        return avg
    return rows.unionByName(avg, allowMissingColumns=True)


def hierarchical_rows(gates: DataFrame, specialists: DataFrame, group: Sequence[str], label_col: str, label: str,
                      average_only: bool = True, digits: int = 4) -> DataFrame:
    """G5 for the two-level flow: gate rows as they are, specialists averaged (their own rows too
    unless ``average_only``)."""
    return gates.unionByName(averaged_row(specialists, group, label_col, label, digits=digits,
                                          keep_detail=not average_only), allowMissingColumns=True)


def subset_accuracy(df: DataFrame, key: Sequence[str], pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """share of rows where every label is predicted right."""
    allok = None
    for lab, pr in pairs:
        e = F.col(lab) == F.col(pr)
        allok = e if allok is None else allok & e
    return df.groupBy(*key).agg(F.avg(allok.cast("double")).alias("subset_accuracy"))


def class_ratio(df: DataFrame, key: Sequence[str], label: str) -> DataFrame:
    """count(label 0) / count(label 1), else 1."""
    n0 = F.sum((F.col(label) == 0).cast("bigint"))
    n1 = F.sum((F.col(label) == 1).cast("bigint"))
    return df.groupBy(*key).agg(
        F.when(n1 > 0, n0 / n1).otherwise(F.lit(1.0)).alias("ratio"))
