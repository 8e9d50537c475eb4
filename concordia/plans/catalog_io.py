"""Registered source/sink and report queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import agreement as ag
from ..operators import explain as ex
from ..operators import quality as q
from ..operators import report as rp
from ..session import scratch_path
from ..sources import arff, sinks
from ..sources.tables import Tables
from . import catalog_agreement as ca
from . import catalog_explain as ce
from . import frames

R6 = 6


def _summary_long(spark, sf):
    return ag.agreement_summary(ca._imp(spark, sf), wide=False)


# ------------------------------------------------------------------------- S2
def q_s2_arff_source(spark, sf):
    r = frames.order_risk(Tables(spark, sf)).select("o_orderkey", *frames.ORDER_NUMERIC, "o_orderstatus")
    path = scratch_path(spark, f"arff-{uuid.uuid4().hex}")
    arff.write_arff(r, path, relation="order_risk")
    back = arff.read_arff(spark, path)
    return back.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.round(F.avg(c), R6).alias(c) for c in frames.ORDER_NUMERIC])


# ------------------------------------------------------------------ S6, S7, J7
def q_s6_set_type_union(spark, sf):
    r = frames.order_risk_split(Tables(spark, sf)).select("o_orderkey", "split", *frames.ORDER_NUMERIC, "y")
    out = sinks.rule_miner_export(r.where(F.col("split") == "train").drop("split"),
                                  r.where(F.col("split") == "test").drop("split"))
    return out.groupBy("Set_Type", "y").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("key_sum"),
                                           F.sum("n_lines").alias("lines"))


# -------------------------------------------------------------------- S9, W4
def q_s9_ordered_attributions(spark, sf):
    train, test = ce.split_frames(spark, sf)
    s = ex.linear_shap(ce.model_for("y"), train, test, ce.FEATURES)
    return sinks.presentation_order(s.select("id", "feature")).select("id", "feature", "seq")


# --------------------------------------------------------- S10, S11, J5
def q_s10_partitioned_merge(spark, sf):
    train, test = ce.split_frames(spark, sf)
    per = {t: ex.linear_shap(ce.model_for(t), train, test, ce.FEATURES) for t in ("has_R", "has_A", "has_N")}
    stacked = ex.per_target(per).withColumn("dataset", F.lit("order_risk"))
    path = scratch_path(spark, f"attr-{uuid.uuid4().hex}")
    sinks.write_attributions(stacked, path)
    back = sinks.read_attributions(spark, path)
    return back.groupBy("dataset", "target_context").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("shap_value"), 4).alias("shap_sum"))


# ------------------------------------------------------------------------ S12
def q_s12_latest_performance(spark, sf):
    s = frames.scored_long(Tables(spark, sf)).withColumn("dataset", F.lit("order_risk"))
    runs = None
    for run, part in ((1, "test"), (2, "train")):  # a re-run appended after the first
        a = q.accuracy(s.where(F.col("split") == part), ["dataset", "target"]) \
            .withColumn("run", F.lit(run))
        runs = a if runs is None else runs.unionByName(a)
    path = scratch_path(spark, f"metrics-{uuid.uuid4().hex}")
    for run in (1, 2):
        sinks.write_metrics(runs.where(F.col("run") == run), path, keys=["dataset", "target"])
    latest = sinks.read_metrics(spark, path, keys=["dataset", "target"])
    return latest.select("dataset", "target", "run", F.round("accuracy", R6).alias("accuracy"), "n")


# ----------------------------------------------------------------------- V1-V5
def q_v1_clean_labels(spark, sf):
    d = _summary_long(spark, sf).select("dataset").distinct()
    raw = F.concat(F.regexp_replace("dataset", " ", "_"), F.lit(".csv"))
    return d.select("dataset", rp.clean_label(raw).alias("label"))


def _snake(df):
    return df.toDF(*[c.lower().replace("-", "_") for c in df.columns])


def q_v2_metric_matrices(spark, sf):
    s = _summary_long(spark, sf)
    sp = _snake(rp.metric_matrix(s, "Spearman")).withColumn("metric", F.lit("Spearman"))
    ja = _snake(rp.metric_matrix(s, "Jaccard")).withColumn("metric", F.lit("Jaccard"))
    return sp.unionByName(ja)


def q_v4_baseline_bars(spark, sf):
    b = rp.baseline_bars(_summary_long(spark, sf))
    return b.select("metric", "pair", "value", "baseline", F.round("diff_to_baseline", R6).alias("diff_to_baseline"))


def q_v5_parity_profile(spark, sf):
    p = rp.parity_profile(_summary_long(spark, sf))
    return p.select("dataset", "left_value", "right_value", "sign",
                    F.round("left_mean", R6).alias("left_mean"), F.round("right_mean", R6).alias("right_mean"))


QUERIES = {
    "s2_arff_source": q_s2_arff_source,
    "s6_set_type_union": q_s6_set_type_union,
    "s9_ordered_attributions": q_s9_ordered_attributions,
    "s10_partitioned_merge": q_s10_partitioned_merge,
    "s12_latest_performance": q_s12_latest_performance,
    "v1_clean_labels": q_v1_clean_labels,
    "v2_metric_matrices": q_v2_metric_matrices,
    "v4_baseline_bars": q_v4_baseline_bars,
    "v5_parity_profile": q_v5_parity_profile,
}

_SUM = "WITH " + ca._sql_metrics()
_PAIR_COLS = ", ".join(f"max(CASE WHEN pair = '{p}' THEN value END) AS {p.lower().replace('-', '_')}"
                       for _, _, p in ag.PAIRS)

ORACLES = {
    "s2_arff_source": f"""WITH r AS ({frames.SQL_ORDER_RISK})
        SELECT o_orderstatus, count(*) AS n, """ + ", ".join(
        f"round(avg({c}), {R6}) AS {c}" for c in frames.ORDER_NUMERIC) + " FROM r GROUP BY 1",
    "s6_set_type_union": f"""WITH r AS ({frames.SQL_ORDER_RISK_SPLIT})
        SELECT CASE WHEN split = 'train' THEN 'Train' ELSE 'Test' END AS Set_Type, y, count(*) AS n,
               sum(o_orderkey) AS key_sum, sum(n_lines) AS lines FROM r GROUP BY 1, 2""",
    "s9_ordered_attributions": f"""WITH r AS ({frames.SQL_ORDER_RISK_SPLIT}),
        te AS (SELECT o_orderkey AS id FROM r WHERE split = 'test')
        SELECT id, feature, row_number() OVER (ORDER BY id, lower(feature), feature) AS seq
        FROM te, {ce.FEAT_SQL}""",
    "s10_partitioned_merge": None,  # built below from the linear SHAP oracle
    "s12_latest_performance": f"""WITH {frames.SQL_CTE_SCORED}
        SELECT 'order_risk' AS dataset, target, 2 AS run,
               round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), {R6}) AS accuracy, count(*) AS n
        FROM scored WHERE split = 'train' GROUP BY target""",
    "v1_clean_labels": f"""{_SUM} SELECT DISTINCT dataset,
        trim(replace(regexp_replace(replace(dataset, ' ', '_') || '.csv', '\\.csv$', ''), '_', ' ')) AS label
        FROM summary""",
    "v2_metric_matrices": f"""{_SUM} SELECT dataset, {_PAIR_COLS}, 'Spearman' AS metric FROM summary
        WHERE metric = 'Spearman' AND dataset <> '{ag.TOTAL_ROW}' GROUP BY dataset
        UNION ALL SELECT dataset, {_PAIR_COLS}, 'Jaccard' AS metric FROM summary
        WHERE metric = 'Jaccard' AND dataset <> '{ag.TOTAL_ROW}' GROUP BY dataset""",
    "v4_baseline_bars": f"""{_SUM}, t AS (SELECT * FROM summary WHERE dataset = '{ag.TOTAL_ROW}'),
        b AS (SELECT metric, value AS baseline FROM t WHERE pair = '{rp.BASELINE_PAIR}')
        SELECT t.metric, t.pair, t.value, b.baseline, round(t.value - b.baseline, {R6}) AS diff_to_baseline
        FROM t LEFT JOIN b USING (metric)""",
    "v5_parity_profile": f"""{_SUM}, d AS (SELECT * FROM summary WHERE metric = 'Spearman' AND dataset <> '{ag.TOTAL_ROW}'),
        a AS (SELECT dataset, value AS left_value FROM d WHERE pair = 'Rulex-SHAP'),
        b AS (SELECT dataset, value AS right_value FROM d WHERE pair = '{rp.BASELINE_PAIR}')
        SELECT coalesce(a.dataset, b.dataset) AS dataset, left_value, right_value,
               cast(sign(left_value - right_value) AS integer) AS sign,
               round(avg(left_value) OVER (), {R6}) AS left_mean, round(avg(right_value) OVER (), {R6}) AS right_mean
        FROM a FULL OUTER JOIN b USING (dataset)""",
}


def _s10_sql():
    parts = []
    for t in ("has_R", "has_A", "has_N"):
        b, w = frames.LINEAR_MODELS[t]
        wl = "[" + ", ".join(f"{float(x)!r}::DOUBLE" for x in w) + "]"
        parts.append(f"""SELECT '{t}' AS target_context,
            ({wl})[fn.j + 1] * (([{', '.join(f'te.x{k}' for k in range(ce.P))}])[fn.j + 1]
                                - ([{', '.join(f'm.m{k}' for k in range(ce.P))}])[fn.j + 1]) AS shap_value
            FROM te, mu m, {ce.FEAT_SQL}""")
    means = ", ".join(f"avg(x{k}) AS m{k}" for k in range(ce.P))
    return f"""WITH {ce.BASE_CTE}, mu AS (SELECT {means} FROM tr), s AS ({' UNION ALL '.join(parts)})
        SELECT 'order_risk' AS dataset, target_context, count(*) AS n, round(sum(shap_value), 4) AS shap_sum
        FROM s GROUP BY target_context"""


ORACLES["s10_partitioned_merge"] = _s10_sql()
