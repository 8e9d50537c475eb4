"""Registered agreement queries (I*, W*) and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agreement as ag
from ..session import written
from ..sources.tables import Tables
from . import frames

R6 = 6  # output rounding for values computed in floating point by both engines

PAIRS_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}', '{p}')" for a, b, p in ag.PAIRS) + ") p(m1, m2, pair)"


def _imp(spark, sf, attribute="brand"):
    t = Tables(spark, sf)
    # the importance table feeds every metric: write it once
    return written(ag.unpivot_importance(frames.importance_wide(t, attribute), dataset_col="dataset",
                                         target_col="Target"))


def _sql_ranks(attribute="brand"):
    return f"""imp AS ({frames.sql_importance_long(attribute)}),
    ranks AS (SELECT *, row_number() OVER (PARTITION BY dataset, target, method
                                          ORDER BY value DESC, attribute) AS rank FROM imp),
    pts AS (SELECT a.dataset, a.target, p.pair, a.attribute, a.rank AS xr, b.rank AS yr,
                   a.value AS xv, b.value AS yv
            FROM ranks a JOIN {PAIRS_SQL} ON a.method = p.m1
            JOIN ranks b ON b.method = p.m2 AND b.dataset = a.dataset AND b.target = a.target
                        AND b.attribute = a.attribute)"""


def _sql_metrics(attribute="brand", k=ag.TOP_K):
    return _sql_ranks(attribute) + f""",
    grp AS (SELECT DISTINCT dataset, target, pair FROM pts),
    spearman AS (SELECT dataset, target, pair, 'Spearman' AS metric,
                        CASE WHEN count(*) >= 2 THEN 1.0::DOUBLE - (6.0::DOUBLE * cast(sum((xr - yr) * (xr - yr)) AS DOUBLE))
                             / cast(count(*) * (count(*) * count(*) - 1) AS DOUBLE) END AS value
                 FROM pts GROUP BY ALL),
    kpairs AS (SELECT a.dataset, a.target, a.pair,
                      sum(sign(a.xv - b.xv) * sign(a.yv - b.yv)) AS s,
                      sum(abs(sign(a.xv - b.xv))) AS tx, sum(abs(sign(a.yv - b.yv))) AS ty
               FROM pts a JOIN pts b ON a.dataset = b.dataset AND a.target = b.target
                                    AND a.pair = b.pair AND a.attribute < b.attribute
               GROUP BY ALL),
    kendall AS (SELECT g.dataset, g.target, g.pair, 'Kendall' AS metric,
                       coalesce(k.s / nullif(sqrt(k.tx * k.ty), 0), 0.0) AS value
                FROM grp g LEFT JOIN kpairs k USING (dataset, target, pair)),
    top AS (SELECT dataset, target, method, attribute FROM ranks WHERE rank <= {k}),
    sizes AS (SELECT dataset, target, method, count(*) AS size FROM top GROUP BY ALL),
    inter AS (SELECT a.dataset, a.target, p.pair, count(*) AS inter
              FROM top a JOIN {PAIRS_SQL} ON a.method = p.m1
              JOIN top b ON b.method = p.m2 AND a.dataset = b.dataset AND a.target = b.target
                         AND a.attribute = b.attribute GROUP BY ALL),
    jaccard AS (SELECT g.dataset, g.target, p.pair, 'Jaccard' AS metric,
                       CASE WHEN coalesce(sa.size, 0) + coalesce(sb.size, 0) - coalesce(i.inter, 0) > 0
                            THEN coalesce(i.inter, 0) / (coalesce(sa.size, 0) + coalesce(sb.size, 0) - coalesce(i.inter, 0))
                            ELSE 0.0 END AS value
                FROM (SELECT DISTINCT dataset, target FROM ranks) g CROSS JOIN {PAIRS_SQL}
                LEFT JOIN sizes sa ON sa.dataset = g.dataset AND sa.target = g.target AND sa.method = p.m1
                LEFT JOIN sizes sb ON sb.dataset = g.dataset AND sb.target = g.target AND sb.method = p.m2
                LEFT JOIN inter i ON i.dataset = g.dataset AND i.target = g.target AND i.pair = p.pair),
    per_target AS (SELECT dataset, target, metric, pair, value FROM spearman
                   UNION ALL SELECT dataset, target, metric, pair, value FROM kendall
                   UNION ALL SELECT dataset, target, metric, pair, value FROM jaccard),
    per_dataset AS (SELECT dataset, metric, pair,
                           round_even(list_reduce(list_sort(list(value) FILTER (WHERE value IS NOT NULL)),
                                                  lambda a, b: a + b)
                                      / count(value), 2) + 0.0 AS value
                    FROM per_target GROUP BY ALL),
    summary AS (SELECT * FROM per_dataset
                UNION ALL SELECT '{ag.TOTAL_ROW}' AS dataset, metric, pair,
                       round_even(cast(sum(cast(round(value * 100) AS bigint)) AS DOUBLE) / (100.0::DOUBLE * count(value)), 2)
                       + 0.0 AS value
                FROM per_dataset GROUP BY metric, pair)"""


# ------------------------------------------------------------------ queries
def q_i1_unpivot_contract(spark, sf):
    return _imp(spark, sf)


def q_w1_unique_ranks(spark, sf):
    return ag.unique_ranks(_imp(spark, sf)).select("dataset", "target", "method", "attribute", "rank")


def q_i3_spearman(spark, sf):
    pts = ag.paired_points(ag.unique_ranks(_imp(spark, sf)))
    return ag.spearman(pts).select("dataset", "target", "pair", F.round("value", R6).alias("value"))


def q_i4_kendall_tau_b(spark, sf):
    pts = ag.paired_points(ag.unique_ranks(_imp(spark, sf)))
    return ag.kendall_tau_b(pts).select("dataset", "target", "pair", F.round("value", R6).alias("value"))


def q_i4_kendall_tau_b_parts(spark, sf):
    pts = ag.paired_points(ag.unique_ranks(_imp(spark, sf, "part")))
    return ag.kendall_tau_b(pts).select("dataset", "target", "pair", F.round("value", R6).alias("value"))


def q_i5_topk_jaccard(spark, sf):
    ranks = ag.unique_ranks(_imp(spark, sf))
    return ag.jaccard_top_k(ranks).select("dataset", "target", "pair", F.round("value", R6).alias("value"))


def q_w2_top_k_sets(spark, sf):
    return ag.top_k_sets(ag.unique_ranks(_imp(spark, sf))) \
        .select("dataset", "target", "method", "attribute", "rank")


def q_i6_per_target_metrics(spark, sf):
    return ag.agreement_per_target(_imp(spark, sf)) \
        .select("dataset", "target", "metric", "pair", F.round("value", R6).alias("value"))


def q_i7_agreement_summary(spark, sf):
    return ag.agreement_summary(_imp(spark, sf), wide=False) \
        .select("dataset", "metric", "pair", "value")


def q_i7_agreement_summary_parts(spark, sf):
    return ag.agreement_summary(_imp(spark, sf, "part"), wide=False) \
        .select("dataset", "metric", "pair", "value")


def q_i9_summary_wide(spark, sf):
    return ag.agreement_summary(_imp(spark, sf), wide=True)


def q_w5_default_target(spark, sf):
    """Importance without a Target column -> every row in group Single_Target."""
    t = Tables(spark, sf)
    wide = frames.importance_wide(t).groupBy("dataset", "Attribute").agg(
        F.sum("Rulex").alias("Rulex"), F.sum("SHAP").alias("SHAP"),
        F.sum("LIME").alias("LIME"), F.max("Ablation").alias("Ablation"))
    imp = ag.unpivot_importance(wide)
    return ag.agreement_per_target(imp) \
        .select("dataset", "target", "metric", "pair", F.round("value", R6).alias("value"))


QUERIES = {
    "i1_unpivot_contract": q_i1_unpivot_contract,
    "w1_unique_ranks": q_w1_unique_ranks,
    "w2_top_k_sets": q_w2_top_k_sets,
    "i3_spearman": q_i3_spearman,
    "i4_kendall_tau_b": q_i4_kendall_tau_b,
    "i4_kendall_tau_b_parts": q_i4_kendall_tau_b_parts,
    "i5_topk_jaccard": q_i5_topk_jaccard,
    "i6_per_target_metrics": q_i6_per_target_metrics,
    "i7_agreement_summary": q_i7_agreement_summary,
    "i7_agreement_summary_parts": q_i7_agreement_summary_parts,
    "i9_summary_wide": q_i9_summary_wide,
    "w5_default_target": q_w5_default_target,
}


def _wide_sql():
    cols = ", ".join(
        f"max(CASE WHEN metric = '{m}' AND pair = '{p}' THEN value END) AS {ag.metric_column_name(m, p)}"
        for m in ag.METRICS for _, _, p in ag.PAIRS)
    return f"WITH {_sql_metrics()} SELECT dataset, {cols} FROM summary GROUP BY dataset"


_W5_IMP = f"""imp AS (
    SELECT dataset, 'Single_Target' AS target, attribute, method, value FROM (
        SELECT dataset, Attribute AS attribute, sum(Rulex) AS Rulex, sum(SHAP) AS SHAP,
               sum(LIME) AS LIME, max(Ablation) AS Ablation
        FROM ({frames.sql_importance_wide()}) w GROUP BY dataset, Attribute) x
    UNPIVOT (value FOR method IN (Rulex, SHAP, LIME, Ablation)))"""

ORACLES = {
    "i1_unpivot_contract": frames.sql_importance_long(),
    "w1_unique_ranks": f"WITH {_sql_ranks()} SELECT dataset, target, method, attribute, rank FROM ranks",
    "w2_top_k_sets": f"WITH {_sql_ranks()} SELECT dataset, target, method, attribute, rank FROM ranks WHERE rank <= {ag.TOP_K}",
    "i3_spearman": f"WITH {_sql_metrics()} SELECT dataset, target, pair, round(value, {R6}) AS value FROM spearman",
    "i4_kendall_tau_b": f"WITH {_sql_metrics()} SELECT dataset, target, pair, round(value, {R6}) AS value FROM kendall",
    "i4_kendall_tau_b_parts": f"WITH {_sql_metrics('part')} SELECT dataset, target, pair, round(value, {R6}) AS value FROM kendall",
    "i5_topk_jaccard": f"WITH {_sql_metrics()} SELECT dataset, target, pair, round(value, {R6}) AS value FROM jaccard",
    "i6_per_target_metrics": f"WITH {_sql_metrics()} SELECT dataset, target, metric, pair, round(value, {R6}) AS value FROM per_target",
    "i7_agreement_summary": f"WITH {_sql_metrics()} SELECT dataset, metric, pair, value FROM summary",
    "i7_agreement_summary_parts": f"WITH {_sql_metrics('part')} SELECT dataset, metric, pair, value FROM summary",
    "i9_summary_wide": _wide_sql(),
}


def _w5_sql():
    body = _sql_metrics()
    # replace the importance CTE by the target-less variant
    rest = body[body.index("ranks AS"):]
    return f"WITH {_W5_IMP},\n    {rest} SELECT dataset, target, metric, pair, round(value, {R6}) AS value FROM per_target"


ORACLES["w5_default_target"] = _w5_sql()
