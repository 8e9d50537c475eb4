"""Registered model-quality queries (G1-G5, F1, F5) and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as q
from ..sources.tables import Tables
from . import frames

R6 = 6


def _scored(spark, sf):
    return frames.scored_long(Tables(spark, sf))


def q_g2_accuracy_f1(spark, sf):
    s = _scored(spark, sf).where(F.col("split") == "test")
    a = q.accuracy(s, ["target"])
    f = q.weighted_f1(s, ["target"])
    return a.join(f, "target").select(
        "target", F.col("n").alias("n_test"), F.round("accuracy", R6).alias("accuracy"),
        F.round("f1_weighted", R6).alias("f1_weighted"))


def q_g3_auroc(spark, sf):
    s = _scored(spark, sf).where(F.col("split") == "test")
    return q.auroc(s, ["target"], score="z").select("target", F.round("auroc", R6).alias("auroc"))


def q_g5_averaged_row(spark, sf):
    s = _scored(spark, sf).withColumn("dataset", F.lit("order_risk")) \
        .withColumn("classifier", F.lit("FixedLogit"))
    key = ["dataset", "target", "classifier"]
    test = s.where(F.col("split") == "test")
    n_train = s.where(F.col("split") == "train").groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_train"))
    rows = q.metric_rows(test, key, score="z", n_train=n_train)
    return q.averaged_row(rows, ["dataset", "classifier"], "target", "Averaged across targets") \
        .select("dataset", "target", "classifier", "n_train", "n_test", "accuracy",
                "f1_weighted", "auroc")


def q_f1_class_ratio(spark, sf):
    s = _scored(spark, sf).where(F.col("split") == "train")
    return q.class_ratio(s, ["target"], "label").select("target", F.round("ratio", R6).alias("ratio"))


def q_f5_subset_accuracy(spark, sf):
    r = frames.order_risk_split(Tables(spark, sf))
    labels = ["has_R", "has_A", "has_N"]
    pr = r.select("split", *labels,
                  *[(frames.linear_margin(lb) >= 0).cast("int").alias(f"pred_{lb}") for lb in labels])
    test = pr.where(F.col("split") == "test")
    sub = q.subset_accuracy(test, ["split"], [(lb, f"pred_{lb}") for lb in labels])
    per = test.select(F.explode(F.array(*[F.struct(F.lit(lb).alias("label_name"),
                                                   (F.col(lb) == F.col(f"pred_{lb}")).cast("double").alias("ok"))
                                          for lb in labels])).alias("e")) \
        .groupBy("e.label_name").agg(F.avg("e.ok").alias("accuracy"))
    return per.select("label_name", F.round("accuracy", R6).alias("accuracy")) \
        .unionByName(sub.select(F.lit("ALL").alias("label_name"),
                                F.round("subset_accuracy", R6).alias("accuracy")))


QUERIES = {
    "g2_accuracy_f1": q_g2_accuracy_f1,
    "g3_auroc": q_g3_auroc,
    "g5_averaged_row": q_g5_averaged_row,
    "f1_class_ratio": q_f1_class_ratio,
    "f5_subset_accuracy": q_f5_subset_accuracy,
}

_F1_SQL = f"""
    conf AS (SELECT target, label AS l, prediction AS p, count(*) AS c FROM scored WHERE split = 'test' GROUP BY ALL),
    cls AS (SELECT target, l AS c FROM conf UNION SELECT target, p FROM conf),
    per AS (SELECT k.target, k.c,
                   coalesce((SELECT sum(c) FROM conf WHERE conf.target = k.target AND conf.l = k.c), 0) AS support,
                   coalesce((SELECT sum(c) FROM conf WHERE conf.target = k.target AND conf.l = k.c AND conf.p = k.c), 0) AS tp,
                   coalesce((SELECT sum(c) FROM conf WHERE conf.target = k.target AND conf.p = k.c), 0) AS predicted
            FROM cls k),
    f1 AS (SELECT target, sum(CASE WHEN support + predicted > 0 THEN 2.0 * tp / (support + predicted) ELSE 0.0 END * support)
                          / sum(support) AS f1_weighted FROM per GROUP BY target),
    acc AS (SELECT target, count(*) AS n_test, avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS accuracy
            FROM scored WHERE split = 'test' GROUP BY target),
    rnk AS (SELECT target, label, rank() OVER (PARTITION BY target ORDER BY z)
                   + (count(*) OVER (PARTITION BY target, z) - 1) / 2.0 AS r
            FROM scored WHERE split = 'test'),
    auc AS (SELECT target,
                   CASE WHEN sum(label) > 0 AND sum(1 - label) > 0 THEN
                        (sum(CASE WHEN label = 1 THEN r ELSE 0 END) - sum(label) * (sum(label) + 1) / 2.0)
                        / (sum(label) * sum(1 - label)) END AS auroc
            FROM rnk GROUP BY target)"""

ORACLES = {
    "g2_accuracy_f1": f"""WITH {frames.SQL_CTE_SCORED}, {_F1_SQL}
        SELECT a.target, a.n_test, round(a.accuracy, {R6}) AS accuracy, round(f.f1_weighted, {R6}) AS f1_weighted
        FROM acc a JOIN f1 f USING (target)""",
    "g3_auroc": f"""WITH {frames.SQL_CTE_SCORED}, {_F1_SQL}
        SELECT target, round(auroc, {R6}) AS auroc FROM auc""",
    "g5_averaged_row": f"""WITH {frames.SQL_CTE_SCORED}, {_F1_SQL},
        rows_ AS (SELECT 'order_risk' AS dataset, a.target, 'FixedLogit' AS classifier,
                         (SELECT count(*) FROM scored s WHERE s.split = 'train' AND s.target = a.target) AS n_train,
                         a.n_test, round(a.accuracy, 4) AS accuracy, round(f.f1_weighted, 4) AS f1_weighted,
                         round(u.auroc, 4) AS auroc
                  FROM acc a JOIN f1 f USING (target) JOIN auc u USING (target))
        SELECT * FROM rows_
        UNION ALL
        SELECT dataset, 'Averaged across targets', classifier, max(n_train), max(n_test),
               round(cast(sum(cast(round(accuracy * 10000) AS bigint)) AS double) / count(accuracy)) / 10000.0,
               round(cast(sum(cast(round(f1_weighted * 10000) AS bigint)) AS double) / count(f1_weighted)) / 10000.0,
               round(cast(sum(cast(round(auroc * 10000) AS bigint)) AS double) / count(auroc)) / 10000.0
        FROM rows_ GROUP BY dataset, classifier""",
    "f1_class_ratio": f"""WITH {frames.SQL_CTE_SCORED}
        SELECT target, round(CASE WHEN sum(label) > 0 THEN sum(1 - label) / sum(label) ELSE 1.0 END, {R6}) AS ratio
        FROM scored WHERE split = 'train' GROUP BY target""",
    "f5_subset_accuracy": f"""WITH order_risk_split AS ({frames.SQL_ORDER_RISK_SPLIT}),
        pr AS (SELECT has_R, has_A, has_N,
                      cast({frames.sql_linear_margin('has_R')} >= 0 AS integer) AS pred_has_R,
                      cast({frames.sql_linear_margin('has_A')} >= 0 AS integer) AS pred_has_A,
                      cast({frames.sql_linear_margin('has_N')} >= 0 AS integer) AS pred_has_N
               FROM order_risk_split WHERE split = 'test')
        SELECT 'has_R' AS label_name, round(avg(CASE WHEN has_R = pred_has_R THEN 1.0 ELSE 0.0 END), {R6}) AS accuracy FROM pr
        UNION ALL SELECT 'has_A', round(avg(CASE WHEN has_A = pred_has_A THEN 1.0 ELSE 0.0 END), {R6}) FROM pr
        UNION ALL SELECT 'has_N', round(avg(CASE WHEN has_N = pred_has_N THEN 1.0 ELSE 0.0 END), {R6}) FROM pr
        UNION ALL SELECT 'ALL', round(avg(CASE WHEN has_R = pred_has_R AND has_A = pred_has_A
                                                AND has_N = pred_has_N THEN 1.0 ELSE 0.0 END), {R6}) FROM pr""",
}
