"""Registered queries of the whole flow: raw export, unified hierarchical export,
models on a subset of the features, floors of trained models, curve axis."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import encode as en
from ..operators import hierarchy as hy
from ..operators import merge as mg
from ..operators import models as md
from ..operators import quality as q
from ..session import materialize, scratch_path
from ..sources import sinks
from ..sources.files import load_file
from ..sources.tables import Tables
from . import catalog_explain as ce
from . import catalog_models as cm
from . import frames

R6 = 6
SUBSET = ce.FEATURES[:4]
#: What a trained model's AUROC on the test rows must exceed; a constant score has 0.5.
AUROC_FLOOR = 0.6
FLOOR_LABELS = ("has_R", "has_A", "has_N")


def q_s7_raw_export(spark, sf):
    """The frame before one-hot encoding, text columns as they are, exported as CSV and read back."""
    r = frames.order_risk_split(Tables(spark, sf)).select("o_orderkey", "split", "o_orderstatus", *frames.ORDER_NUMERIC, "y")
    path = scratch_path(spark, f"raw-{uuid.uuid4().hex}.csv")
    sinks.rule_miner_export(r.where("split = 'train'").drop("split"), r.where("split = 'test'").drop("split"), path, fmt="csv")
    back = load_file(spark, path)
    return back.groupBy("Set_Type", "o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("y").cast("long")).alias("y_sum"),
        F.sum(F.col("o_orderkey").cast("long")).alias("key_sum"))


def q_f9_unified_export(spark, sf):
    """Both sides of the two-level flow in one table, read back."""
    train, test = cm._labelled_frames(spark, sf)
    tr, te = hy.append_gate_scores(train, test, cm.CATEGORIES, cm.fixed_gates())
    predictions = hy.specialist_predictions(tr, te, cm.CATEGORIES, cm._fixed_specialist)
    path = scratch_path(spark, f"flow-{uuid.uuid4().hex}")
    back = hy.unified_export(tr.drop("split"), te.drop("split"), cm.CATEGORIES, predictions, path)
    labels = [lab for c in cm.CATEGORIES for lab in c.labels]
    return back.select("id", "Set_Type", F.size("x").alias("n_features"), *labels, *[f"pred_{lab}" for lab in labels],
                       *[F.round(f"Gatekeeper_{c.name}_Score", R6).alias(f"Gatekeeper_{c.name}_Score") for c in cm.CATEGORIES])


def _wide(spark, sf):
    r = frames.order_risk_split(Tables(spark, sf))
    rows = materialize(r.select(F.col("o_orderkey").alias("id"), "split", *ce.FEATURES, F.col("y").cast("int").alias("y")))
    return rows.where("split = 'train'"), rows.where("split = 'test'")


def q_f11_feature_subset(spark, sf):
    """Models trained on four of the features: probabilities, and whether the other features leave them as they are."""
    from pyspark.ml.functions import vector_to_array

    train, test = _wide(spark, sf)
    out = None
    for kind in ("gbt", "rf"):
        weighted = md.balance_weights(train, "y", mode="ratio" if kind == "gbt" else "balanced")
        model = md.train_classifier(weighted, SUBSET, "y", kind, weight_col="weight", maxIter=8, numTrees=8)
        score = vector_to_array("probability")[1]
        other = test.withColumns({c: F.lit(0) for c in ce.FEATURES if c not in SUBSET})
        a = model.transform(test).select("id", score.alias("p"))
        b = model.transform(other).select("id", score.alias("q"))
        rows = a.join(b, "id").select("id", F.lit(kind).alias("model"), F.col("p").between(0, 1).cast("int").alias("in_range"),
                                      (F.col("p") == F.col("q")).cast("int").alias("subset_only"))
        out = rows if out is None else out.unionByName(rows)
    return out


def q_f2_auroc_floor(spark, sf):
    """Do models trained on a target that depends on the features rank its test rows better than the floor?

    ``y`` has no such link in the order frame; the three line-status targets do.
    """
    from pyspark.ml.functions import vector_to_array

    train, test = cm._labelled_frames(spark, sf)
    out = None
    for label in FLOOR_LABELS:
        cols = train.select(F.col(label).cast("int").alias(label), *[F.col("x")[j].alias(c) for j, c in enumerate(ce.FEATURES)])
        forest = md.train_classifier(cols, ce.FEATURES, label, "rf", numTrees=10)
        rf = forest.transform(test.select(F.col(label).alias("label"), *[F.col("x")[j].alias(c) for j, c in enumerate(ce.FEATURES)])) \
            .select("label", vector_to_array("probability")[1].alias("score"))
        gbt = cm._fit_gbt(train, label).predict(test.select("x", F.col(label).alias("label")), "x", out="score").select("label", "score")
        for kind, rows in (("rf", rf), ("gbt", gbt)):
            rows = rows.select(F.lit(label).alias("target"), F.lit(kind).alias("model"), "label", "score")
            out = rows if out is None else out.unionByName(rows)
    return q.auroc(out, ["target", "model"]).select("target", "model", (F.col("auroc") > AUROC_FLOOR).cast("int").alias("above_floor"))


def q_v7_curve_axis(spark, sf):
    """The y-axis range of the cumulative-ablation curve."""
    got = mg.curve_axis(mg.ablation_curve(ce._merged(spark, sf), max_features=20))
    return got.select(F.round("y_low", R6).alias("y_low"), F.round("y_high", R6).alias("y_high"))


def q_n1_sparse_levels(spark, sf):
    """One sparse vector of three columns, one of them with a level a line: rows per level and slot."""
    line = F.concat_ws("-", "l_orderkey", "l_linenumber")
    lines = materialize(Tables(spark, sf).lineitem.groupBy(line.alias("line")).agg(
        F.min("l_returnflag").alias("l_returnflag"), F.min(F.when(F.col("l_quantity") > 5, F.col("l_partkey"))).alias("part")))
    cols = ["l_returnflag", "line", "part"]
    index = materialize(en.level_index(lines, cols, drop_first=True))
    vectors = en.one_hot_sparse(lines, "line", cols, index, broadcast_bytes=1 << 16)
    return vectors.select(F.explode("onehot.indices").alias("slot")).groupBy("slot").agg(F.count(F.lit(1)).alias("n")) \
        .join(index, "slot").select("column", "level", "slot", "n")


def q_s12_keyed_overwrite(spark, sf):
    """A metrics table by order status: written from the train rows, then one status overwritten from the test rows."""
    r = frames.order_risk_split(Tables(spark, sf))
    rows = materialize(r.groupBy("split", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("n_lines").alias("lines")))
    path = scratch_path(spark, f"metrics-{uuid.uuid4().hex}")
    sinks.overwrite_keys(rows.where("split = 'train'"), path, ["o_orderstatus"])
    sinks.overwrite_keys(rows.where("split = 'test' AND o_orderstatus = 'F'"), path, ["o_orderstatus"])
    return sinks.read_table(spark, path).select("o_orderstatus", "split", "n", F.col("lines").cast("long").alias("lines"))


QUERIES = {
    "n1_sparse_levels": q_n1_sparse_levels,
    "s12_keyed_overwrite": q_s12_keyed_overwrite,
    "s7_raw_export": q_s7_raw_export,
    "f9_unified_export": q_f9_unified_export,
    "f11_feature_subset": q_f11_feature_subset,
    "f2_auroc_floor": q_f2_auroc_floor,
    "v7_curve_axis": q_v7_curve_axis,
}


def _unified_sql():
    labels = [lab for c in cm.CATEGORIES for lab in c.labels]
    final = ", ".join(f"max(final_pred) FILTER (label = '{lab}') AS pred_{lab}" for lab in labels)
    return f"""WITH {ce.BASE_CTE}, {cm._gate_sql()}, sp AS ({cm._spec_sql()}), wide AS (SELECT id, {final} FROM sp GROUP BY id)
        SELECT o.o_orderkey AS id, CASE WHEN o.split = 'train' THEN 'Train' ELSE 'Test' END AS Set_Type,
               {ce.P + len(cm.CATEGORIES)} AS n_features, {', '.join(labels)}, {', '.join(f'pred_{lab}' for lab in labels)},
               round(g.g1, {R6}) AS Gatekeeper_returns_Score, round(g.g2, {R6}) AS Gatekeeper_normal_Score
        FROM ors o JOIN g ON g.id = o.o_orderkey LEFT JOIN wide w ON w.id = o.o_orderkey"""


ORACLES = {
    "n1_sparse_levels": """WITH c AS (SELECT l_orderkey || '-' || l_linenumber AS line, min(l_returnflag) AS l_returnflag,
            min(CASE WHEN l_quantity > 5 THEN l_partkey END)::VARCHAR AS part FROM lineitem GROUP BY 1),
        l AS (SELECT 0 AS p, 'l_returnflag' AS "column", l_returnflag::VARCHAR AS level FROM c UNION ALL SELECT 1, 'line', line FROM c
              UNION ALL SELECT 2, 'part', part FROM c),
        n AS (SELECT p, "column", level, count(*) AS n FROM l WHERE level IS NOT NULL GROUP BY ALL),
        d AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY level) AS r FROM n)
        SELECT "column", level, row_number() OVER (ORDER BY p, level) - 1 AS slot, n FROM d WHERE r > 1""",
    "s12_keyed_overwrite": f"""WITH r AS ({frames.SQL_ORDER_RISK_SPLIT})
        SELECT o_orderstatus, split, count(*) AS n, cast(sum(n_lines) AS bigint) AS lines FROM r
        WHERE (split = 'test') = (o_orderstatus = 'F') GROUP BY ALL""",
    "s7_raw_export": f"""WITH r AS ({frames.SQL_ORDER_RISK_SPLIT})
        SELECT CASE WHEN split = 'train' THEN 'Train' ELSE 'Test' END AS Set_Type, o_orderstatus, count(*) AS n,
               cast(sum(y) AS bigint) AS y_sum, cast(sum(o_orderkey) AS bigint) AS key_sum FROM r GROUP BY 1, 2""",
    "f9_unified_export": _unified_sql(),
    "f11_feature_subset": f"""WITH {ce.BASE_CTE}
        SELECT id, m.model, 1 AS in_range, 1 AS subset_only FROM te, (VALUES ('gbt'), ('rf')) m(model)""",
    "f2_auroc_floor": f"""SELECT target, model, 1 AS above_floor FROM (VALUES ('gbt'), ('rf')) m(model),
        (VALUES {', '.join(f"('{t}')" for t in FLOOR_LABELS)}) t(target)""",
    "v7_curve_axis": f"""WITH {ce._CURVE}
        SELECT round(greatest(0.0, min(y) - 0.06), {R6}) AS y_low, round(max(y) + 0.06, {R6}) AS y_high FROM curve""",
}
