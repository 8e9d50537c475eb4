"""Multi-label and gatekeeper/specialist training flows.

Every model is a *scorer* (see ``models``): either a closed-form scorer or a
fitted Spark ML model. Rows carry a feature array ``x``; a gate's score is
appended to ``x`` so later categories see earlier gate scores. Only row
counts (the > 5 positives guard) reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from ..sources.sinks import rule_miner_export
from .clean import or_label

MIN_SPECIALIST_ROWS = 5


@dataclass
class Category:
    name: str
    labels: list


def fit_per_label(train: DataFrame, labels: Sequence[str], fit: Callable) -> dict:
    """one model per label; ``fit`` is (train, label) -> scorer."""
    return {lab: fit(train, lab) for lab in labels}


def predict_per_label(models: dict, test: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``test`` with ``score_<label>`` and ``pred_<label>`` for every label's model."""
    for lab, scorer in models.items():
        test = scorer.predict(test, "x", out=f"score_{lab}") \
            .withColumn(f"pred_{lab}", (F.col(f"score_{lab}") >= threshold).cast("int"))
    return test


def append_gate_scores(train: DataFrame, test: DataFrame, categories: Sequence[Category],
                       gates: dict) -> tuple[DataFrame, DataFrame]:
    """per category, score its gate on the current features and append
    the score as a feature (``Gatekeeper_<cat>_Score`` column and array slot)."""
    for cat in categories:
        col = f"Gatekeeper_{cat.name}_Score"
        scorer = gates[cat.name]
        train = scorer.predict(train, "x", out=col).withColumn("x", F.concat("x", F.array(F.col(col))))
        test = scorer.predict(test, "x", out=col).withColumn("x", F.concat("x", F.array(F.col(col))))
    return train, test


def fit_gates(train: DataFrame, categories: Sequence[Category], fit: Callable) -> tuple[dict, DataFrame]:
    """Fit gate models in category order; each sees earlier gate scores. Returns the gates and the rows with all scores."""
    gates = {}
    cur = train
    for cat in categories:
        labelled = cur.withColumn("__gate", or_label(cat.labels))
        gates[cat.name] = fit(labelled, "__gate")
        col = f"Gatekeeper_{cat.name}_Score"
        # read by every pass of the next gate's training, or of the specialists': scored once
        cur = materialize(gates[cat.name].predict(cur, "x", out=col).withColumn("x", F.concat("x", F.array(F.col(col)))))
    return gates, cur


def specialist_predictions(train: DataFrame, test: DataFrame, categories: Sequence[Category],
                           specialists: Callable, threshold: float = 0.5) -> DataFrame:
    """Specialists per label, trained on rows whose true gate is 1
    (skipped unless more than 5 such rows), applied to rows whose predicted
    gate is 1; every other test row gets 0. A category without enough rows has
    no specialists: all its labels are NULL scores and 0. Output: id, category,
    label, gate_pred, score, final_pred, a row per test row and label."""
    out = None
    for cat in categories:
        gcol = f"Gatekeeper_{cat.name}_Score"
        pos_train = train.where(or_label(cat.labels) == 1)
        # read once a label and side: written once
        gated = materialize(test.select("id", "x", F.when(F.col(gcol) >= threshold, 1).otherwise(0).alias("gate_pred")))
        enough = pos_train.count() > MIN_SPECIALIST_ROWS  # guard: one scalar count
        for lab in cat.labels:
            tag = [F.lit(cat.name).alias("category"), F.lit(lab).alias("label")]
            unscored = (gated.where("gate_pred = 0") if enough else gated).select(
                "id", *tag, "gate_pred", F.lit(None).cast("double").alias("score"), F.lit(0).alias("final_pred"))
            if enough:  # only gated rows are scored
                s = specialists(cat, lab, pos_train).predict(gated.where("gate_pred = 1"), "x", out="score")
                unscored = s.select("id", *tag, "gate_pred", F.col("score").cast("double").alias("score"),
                                    (F.col("score") >= threshold).cast("int").alias("final_pred")).unionByName(unscored)
            out = unscored if out is None else out.unionByName(unscored)
    return out


def unified_export(train: DataFrame, test: DataFrame, categories: Sequence[Category], predictions: DataFrame, path: str,
                   fmt: str = "parquet") -> DataFrame:
    """the whole flow as one table, written once: both sides with the gate scores that were added along the chain and
    their labels, the specialists' final predictions beside the test rows, and ``Set_Type``.

    ``predictions``: what :func:`specialist_predictions` gives; a category without specialists predicts 0.
    """
    labels = [lab for c in categories for lab in c.labels]
    # one row an id: labels are few and known
    wide = predictions.groupBy("id").agg(*[F.max(F.when(F.col("label") == lab, F.col("final_pred"))).alias(f"pred_{lab}") for lab in labels])
    none = [F.lit(None).cast("int").alias(f"pred_{lab}") for lab in labels]
    rule_miner_export(train.select("*", *none), test.join(wide, "id", "left"), path, fmt)
    return train.sparkSession.read.format(fmt).load(path)
