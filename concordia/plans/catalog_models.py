"""Registered training-flow queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hierarchy as hy
from ..operators import models as md
from ..operators.models import LinearLogit
from ..session import materialize
from . import catalog_explain as ce
from . import frames

R6 = 6
# The category order of the two-level flow on the order frame.
CATEGORIES = [hy.Category("returns", ["has_R", "has_A"]), hy.Category("normal", ["has_N"])]
GATE_CHAIN_WEIGHT = 0.5


def _labelled_frames(spark, sf):
    from ..sources.tables import Tables
    r = frames.order_risk_split(Tables(spark, sf))
    # read by every pass of every model: written once, not joined and grouped again
    base = materialize(r.select(F.col("o_orderkey").alias("id"), "split", md.features_array(ce.FEATURES).alias("x"),
                                "has_R", "has_A", "has_N", "y"))
    return base.where(F.col("split") == "train"), base.where(F.col("split") == "test")


def fixed_gates():
    b_r, w_r = frames.LINEAR_MODELS["has_R"]
    b_n, w_n = frames.LINEAR_MODELS["has_N"]
    return {"returns": LinearLogit(b_r, tuple(w_r)),
            "normal": LinearLogit(b_n, tuple(w_n) + (GATE_CHAIN_WEIGHT,))}


def _fixed_specialist(cat, label, pos_train):
    return ce.model_for(label)


def q_f7_gate_feature(spark, sf):
    train, test = _labelled_frames(spark, sf)
    tr, te = hy.append_gate_scores(train, test, CATEGORIES, fixed_gates())
    cols = [f"Gatekeeper_{c.name}_Score" for c in CATEGORIES]
    return tr.unionByName(te).select("id", "split", *[F.round(c, R6).alias(c) for c in cols])


def q_f9_gate_specialist(spark, sf):
    train, test = _labelled_frames(spark, sf)
    tr, te = hy.append_gate_scores(train, test, CATEGORIES, fixed_gates())
    out = hy.specialist_predictions(tr, te, CATEGORIES, _fixed_specialist)
    return out.select("id", "category", "label", "gate_pred", F.round("score", R6).alias("score"), "final_pred")


# ---------------------------------------------------------- trained models
def _fit_gbt(df, label):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector
    m = GBTClassifier(labelCol="__l", featuresCol="features", seed=42, maxIter=10, maxDepth=3) \
        .fit(df.select(array_to_vector("x").alias("features"), F.col(label).cast("double").alias("__l")))
    return md.SparkMLScorer(m)


def q_f2_gbt_rf_scores(spark, sf):
    """GBT with positive-class ratio weight, forest with
    class-balanced weights; probability of class 1 and the prediction."""
    from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array
    train, test = _labelled_frames(spark, sf)
    out = None
    for kind, mode in (("gbt", "ratio"), ("rf", "balanced")):
        w = md.balance_weights(train, "y", mode=mode)
        data = w.select(array_to_vector("x").alias("features"), F.col("y").cast("double").alias("label"), "weight")
        clf = GBTClassifier(seed=42, maxIter=10, maxDepth=3, weightCol="weight") if kind == "gbt" else \
            RandomForestClassifier(seed=42, numTrees=20, maxDepth=5, weightCol="weight")
        m = clf.fit(data)
        s = m.transform(test.select("id", array_to_vector("x").alias("features"))).select(
            "id", F.lit(kind).alias("model"), F.round(vector_to_array("probability")[1], R6).alias("probability"),
            F.col("prediction").cast("int").alias("prediction"))
        out = s if out is None else out.unionByName(s)
    return out


def q_f9_hierarchical_models(spark, sf):
    train, test = _labelled_frames(spark, sf)
    gates, tr = hy.fit_gates(train, CATEGORIES, _fit_gbt)
    _, te = hy.append_gate_scores(train, test, CATEGORIES, gates)
    out = hy.specialist_predictions(tr, te, CATEGORIES, lambda c, lab, pos: _fit_gbt(pos, lab))
    return out.select("id", "category", "label", "gate_pred", F.round("score", R6).alias("score"), "final_pred")


QUERIES = {
    "f7_gate_feature": q_f7_gate_feature,
    "f9_gate_specialist": q_f9_gate_specialist,
    "f2_gbt_rf_scores": q_f2_gbt_rf_scores,
    "f9_hierarchical_models": q_f9_hierarchical_models,
}

_X = [f"x{k}" for k in range(ce.P)]


def _gate_sql():
    g1 = ce._prob("has_R", _X)
    b, w = frames.LINEAR_MODELS["has_N"]
    z = f"{float(b)!r}::DOUBLE" + "".join(f" + {float(wi)!r}::DOUBLE * ({c})" for wi, c in zip(w, _X)) + \
        f" + {GATE_CHAIN_WEIGHT!r}::DOUBLE * (g1)"
    return f"""g AS (SELECT id, split, g1, 1.0::DOUBLE / (1.0::DOUBLE + exp(-({z}))) AS g2 FROM (
                 SELECT a.*, {g1} AS g1 FROM (
                     SELECT o_orderkey AS id, split, {', '.join(f'{c}::DOUBLE AS x{k}' for k, c in enumerate(ce.FEATURES))},
                            has_R, has_A, has_N FROM ors) a) b)"""


def _spec_sql():
    parts = []
    for cat, gcol in (("returns", "g1"), ("normal", "g2")):
        labels = [c.labels for c in CATEGORIES if c.name == cat][0]
        guard = f"(SELECT count(*) FROM ors WHERE split = 'train' AND greatest({', '.join(labels)}) = 1) > 5"
        for lab in labels:
            p = ce._prob(lab, _X)
            parts.append(f"""SELECT t.id, '{cat}' AS category, '{lab}' AS label,
                cast(g.{gcol} >= 0.5 AS integer) AS gate_pred,
                CASE WHEN g.{gcol} >= 0.5 AND {guard} THEN round({p}, {R6}) END AS score,
                CASE WHEN g.{gcol} >= 0.5 AND {guard} THEN cast({p} >= 0.5 AS integer) ELSE 0 END AS final_pred
                FROM te t JOIN g ON g.id = t.id""")
    return " UNION ALL ".join(parts)


ORACLES = {
    "f7_gate_feature": f"""WITH ors AS ({frames.SQL_ORDER_RISK_SPLIT}), {_gate_sql()}
        SELECT id, split, round(g1, {R6}) AS Gatekeeper_returns_Score, round(g2, {R6}) AS Gatekeeper_normal_Score
        FROM g""",
    "f9_gate_specialist": f"""WITH {ce.BASE_CTE}, {_gate_sql()} {_spec_sql()}""",
}
