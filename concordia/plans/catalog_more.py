"""Oversampling, exact ablation, contract skipping, hierarchical metrics, and
checkable properties of trained models, with DuckDB oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import TWO_32, sql_uhash32
from ..operators import agreement as ag
from ..operators import balance as bl
from ..operators import explain as ex
from ..operators import hierarchy as hy
from ..operators import models as md
from ..operators import neighbours as nb
from ..operators import quality as q
from ..operators import sample as sm
from ..operators import treeshap as ts
from ..session import materialize, scratch_path
from ..sources import sinks
from ..sources.tables import Tables
from . import catalog_agreement as ca
from . import catalog_explain as ce
from . import catalog_models as cm
from . import catalog_quality as cq
from . import frames

R6 = 6
DOC_FEATURES = ["n_chars", "n_spaces", "n_lines", "n_commas"]
DOC_P = len(DOC_FEATURES)


# ------------------------------------------------------------------- F6, S8
def _doc_quality(spark, sf):
    """Labelled documents: counts as features, quality as label, split by hash."""
    t = Tables(spark, sf)
    text = F.coalesce("text", F.lit(""))

    def count(mark):
        return (F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))).cast("double")

    rows = t.documents.join(t.labels, "doc_id").select(
        F.col("doc_id").alias("id"), F.array(F.col("n_chars").cast("double"), count(" "), count("\n"), count(",")).alias("x"),
        F.col("quality").cast("int").alias("label"), sm.hash_split("doc_id").alias("split"))
    rows = materialize(rows)
    return rows.where("split = 'train'").drop("split"), rows.where("split = 'test'").drop("split")


def q_f6_smote(spark, sf):
    train, _ = _doc_quality(spark, sf)
    made = bl.smote(train, DOC_P)
    return made.select("id", "base", "neighbour", "label",
                       *[F.round(F.element_at("x", j + 1), R6).alias(n) for j, n in enumerate(DOC_FEATURES)])


def q_f6_nearest_neighbours(spark, sf):
    """The five nearest rows of the same class of every late-risk train order."""
    train, _ = ce.split_frames(spark, sf)
    got = nb.nearest(train.where("label = 1").select("id", "x"), ce.P, bl.K_NEIGHBOURS)
    return got.select("id", "neighbour", "rank", F.round(F.sqrt("d"), 4).alias("distance"))


def q_s8_balanced_export(spark, sf):
    train, test = _doc_quality(spark, sf)
    path = scratch_path(spark, f"balanced-{uuid.uuid4().hex}")
    bl.balanced_export(train, test, DOC_P).write.parquet(path)
    back = spark.read.parquet(path)
    return back.groupBy("Set_Type", "label", "synthetic").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"),
        F.round(F.sum(F.element_at("x", 1)) / F.count(F.lit(1)), 4).alias("mean_chars"))


# -------------------------------------------------------------------- A5 exact
def q_a5_ablation_exact(spark, sf):
    """Exact expectation of marginal ablation for the median-split tree fitted on train."""
    train, test = ce.split_frames(spark, sf)
    tree = md.TreeScorer(ts.median_split_tree(train))
    a = ex.marginal_ablation_exact(tree, train, test, ce.FEATURES, tree.cuts(ce.P))
    return a.select("id", "feature", "feature_value", F.round("base_value", R6).alias("base_value"),
                    F.round("ablation_value", R6).alias("ablation_value"))


def q_a6_cumulative_exact(spark, sf):
    """Exact expectation of cumulative ablation for the same tree, masked in order of its exact marginal ablation."""
    train, test = ce.split_frames(spark, sf)
    nodes = ts.median_split_tree(train)
    tree = md.TreeScorer(nodes)
    marginal = ex.marginal_ablation_exact(tree, train, test, ce.FEATURES, tree.cuts(ce.P))
    c = ex.cumulative_ablation_exact(ts.compile_ensemble([nodes], [1.0], ce.P), train, test, ce.FEATURES, marginal)
    return c.select("id", "step", "feature", "feature_value",
                    *[F.round(k, R6).alias(k) for k in ("base_value", "original_prediction",
                                                         "current_prediction", "cum_ablation_value")])


# ------------------------------------------------------------------- S13, S14
def q_s13_contract_skip(spark, sf):
    wide = materialize(frames.importance_wide(Tables(spark, sf)))
    tables = {"whole": wide, "broken": wide.drop(ag.METHODS[1]), "extra": wide.withColumn("Note", F.lit(1))}
    long, skipped = ag.unpivot_valid(tables, target_col="Target")
    kept = long.groupBy("dataset").agg(F.count(F.lit(1)).alias("n")).withColumn("status", F.lit("kept"))
    left = spark.createDataFrame([(k, 0, "skipped") for k in skipped], "dataset string, n long, status string")
    return kept.unionByName(left).select("dataset", "status", "n")


def q_s14_summary_sink(spark, sf):
    wide = ca.q_i9_summary_wide(spark, sf)
    path = scratch_path(spark, f"summary-{uuid.uuid4().hex}")
    sinks.write_summary(wide, path)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in wide.schema.fields])
    return spark.read.option("header", True).schema(schema).csv(path)


# -------------------------------------------------------------- G5, two levels
def q_g5_hierarchical_rows(spark, sf):
    s = frames.scored_long(Tables(spark, sf)).where("split = 'test'") \
        .withColumns({"dataset": F.lit("order_risk"), "classifier": F.lit("FixedLogit")})
    rows = materialize(q.metric_rows(s, ["dataset", "target", "classifier"], score="z"))
    gates, parts = rows.where("target = 'y'"), rows.where("target IN ('has_R', 'has_A', 'has_N')")
    out = None
    for only in (True, False):
        part = q.hierarchical_rows(gates, parts, ["dataset", "classifier"], "target", "Specialists", average_only=only) \
            .withColumn("average_only", F.lit(int(only)))
        out = part if out is None else out.unionByName(part)
    return out.select("average_only", "dataset", "target", "classifier", "n_test", "accuracy", "f1_weighted", "auroc")


# ------------------------------------------------- properties of trained models
def q_f2_score_properties(spark, sf):
    """one row per test row and model; probability in range and agreeing with the prediction."""
    s = cm.q_f2_gbt_rf_scores(spark, sf)
    p, one = F.col("probability"), F.col("prediction") == 1
    return s.select("id", "model", p.between(0, 1).cast("int").alias("in_range"),
                    (F.when(p > 0.500001, one).when(p < 0.499999, ~one).otherwise(F.lit(True))).cast("int").alias("agrees"))


def q_f9_flow_properties(spark, sf):
    """F7-F9 with trained models: a row per test row and label; only gated rows are scored, and a label needs its gate."""
    s = cm.q_f9_hierarchical_models(spark, sf)
    gate = F.col("gate_pred") == 1
    ok = F.when(gate, F.col("score").between(0, 1) & ((F.col("final_pred") == 1) == (F.col("score") >= 0.4999995)) |
                F.col("score").between(0.499999, 0.500001)).otherwise(F.col("score").isNull() & (F.col("final_pred") == 0))
    return s.select("id", "category", "label", ok.cast("int").alias("ok"))


def q_f5_multi_output(spark, sf):
    """one boosted model per label; all labels right is no commoner than the hardest label right."""
    train, test = cm._labelled_frames(spark, sf)
    labels = ["has_R", "has_A", "has_N"]
    pred = materialize(hy.predict_per_label(hy.fit_per_label(train, labels, cm._fit_gbt), test)
                       .select("id", *labels, *[f"pred_{lb}" for lb in labels]))
    each = pred.agg(*[F.avg((F.col(lb) == F.col(f"pred_{lb}")).cast("double")).alias(lb) for lb in labels],
                    F.count(F.lit(1)).alias("n"))
    whole = q.subset_accuracy(pred.withColumn("k", F.lit(1)), ["k"], [(lb, f"pred_{lb}") for lb in labels])
    both = each.withColumn("k", F.lit(1)).join(whole, "k")  # one row each
    least = F.least(*[F.col(lb) for lb in labels])
    misses = sum((F.lit(1.0) - F.col(lb) for lb in labels), F.lit(0.0))
    return both.select("n", (F.col("subset_accuracy") <= least + 1e-12).cast("int").alias("at_most_least"),
                       (F.col("subset_accuracy") >= F.lit(1.0) - misses - 1e-12).cast("int").alias("at_least_union"))


def q_a1_model_additivity(spark, sf):
    """A1, A2 on trained models: base value plus a row's Shapley values gives the model's own output."""
    from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array
    train, test = ce.split_frames(spark, sf)
    tr = train.select(array_to_vector("x").alias("features"), F.col("label").cast("double").alias("label"))
    out = None
    for kind, clf in (("gbt", GBTClassifier(maxIter=10, maxDepth=4, seed=42)),
                      ("rf", RandomForestClassifier(numTrees=10, maxDepth=4, seed=42))):
        model = clf.fit(tr)
        s = ts.tree_shap(ts.compile_spark_model(spark, model, ce.P), test, ce.FEATURES)
        total = s.groupBy("id").agg(F.count(F.lit(1)).alias("n_features"),
                                    (F.first("base_value") + F.sum("shap_value")).alias("m"))
        own = model.transform(test.select("id", array_to_vector("x").alias("features"))) \
            .select("id", vector_to_array("probability")[1].alias("p"))
        got = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("m"))) if kind == "gbt" else F.col("m")
        part = total.join(own, "id").select("id", F.lit(kind).alias("model"), "n_features",
                                            (F.abs(got - F.col("p")) < 1e-6).cast("int").alias("additive"))
        out = part if out is None else out.unionByName(part)
    return out


QUERIES = {
    "f6_smote": q_f6_smote,
    "f6_nearest_neighbours": q_f6_nearest_neighbours,
    "s8_balanced_export": q_s8_balanced_export,
    "a5_ablation_exact": q_a5_ablation_exact,
    "a6_cumulative_exact": q_a6_cumulative_exact,
    "s13_contract_skip": q_s13_contract_skip,
    "s14_summary_sink": q_s14_summary_sink,
    "g5_hierarchical_rows": q_g5_hierarchical_rows,
    "f2_score_properties": q_f2_score_properties,
    "f9_flow_properties": q_f9_flow_properties,
    "f5_multi_output": q_f5_multi_output,
    "a1_model_additivity": q_a1_model_additivity,
}


# ----------------------------------------------------------------- oracles
def _smote_cte():
    k, x = bl.K_NEIGHBOURS, [f"x{j}" for j in range(DOC_P)]
    d = "0.0::DOUBLE" + "".join(f" + (a.x{j} - b.x{j}) * (a.x{j} - b.x{j})" for j in range(DOC_P))

    def marks(c):
        return f"(length(t) - length(replace(t, {c}, '')))::DOUBLE"

    return f"""dq AS (SELECT doc_id AS id, n_chars::DOUBLE AS x0, {marks("' '")} AS x1, {marks("chr(10)")} AS x2,
                  {marks("','")} AS x3, cast(quality AS integer) AS label,
                  CASE WHEN {sql_uhash32(42, 'doc_id')} < {int(0.3 * TWO_32)} THEN 'test' ELSE 'train' END AS split
           FROM (SELECT d.*, l.quality, coalesce(d.text, '') AS t FROM documents d JOIN labels l USING (doc_id))),
    tn AS (SELECT * FROM dq WHERE split = 'train'),
    cn AS (SELECT count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1, max(id) AS top FROM tn),
    pa AS (SELECT *, CASE WHEN n1 <= n0 THEN 1 ELSE 0 END AS minority, least(n0, n1) AS n, abs(n0 - n1) AS need FROM cn),
    mi AS (SELECT tn.* FROM tn, pa WHERE label = minority),
    nk AS (SELECT * FROM (SELECT a.id, b.id AS neighbour, {', '.join(f'b.{c} AS n{c}' for c in x)},
                  row_number() OVER (PARTITION BY a.id ORDER BY {d}, b.id) AS rank
           FROM mi a JOIN mi b ON a.id <> b.id) WHERE rank <= {k}),
    ba AS (SELECT *, row_number() OVER (ORDER BY id) AS r FROM mi),
    dr AS (SELECT i, {sql_uhash32('smote-row', 'i')} % n + 1 AS r, {sql_uhash32('smote-near', 'i')} AS pick,
                  {sql_uhash32('smote-step', 'i')} / {float(TWO_32)!r}::DOUBLE AS u
           FROM pa, range((SELECT need FROM pa)) s(i)),
    sy AS (SELECT pa.top + 1 + i AS id, ba.id AS base, nk.neighbour, pa.minority AS label,
                  {', '.join(f'ba.x{j} + u * (nx{j} - ba.x{j}) AS x{j}' for j in range(DOC_P))}
           FROM dr JOIN ba USING (r), pa JOIN nk ON nk.id = ba.id AND nk.rank = pick % least({k}, pa.n - 1) + 1)"""


def _tree_cte():
    """Thresholds and leaf values of the median-split tree, and its prediction as a function of x0 and x2."""
    body = ce._TREE_SQL
    return body[body.index("t0 AS"):body.index("    k AS")].rstrip().rstrip(",")


def _tree_pred(x0, x2):
    return f"CASE WHEN {x0} <= t0 AND {x2} <= t1 THEN v3 WHEN {x0} <= t0 THEN v4 WHEN {x0} <= t2 THEN v5 ELSE v6 END"


_A5_EXACT = f"""WITH {ce.BASE_CTE}, {_tree_cte()},
    base AS (SELECT avg({_tree_pred('x0', 'x2')}) AS base FROM tr, th, st),
    e0 AS (SELECT te.id, avg({_tree_pred('b.b0', 'te.x2')}) AS e FROM te, bg b, th, st GROUP BY te.id),
    e2 AS (SELECT te.id, avg({_tree_pred('te.x0', 'b.b2')}) AS e FROM te, bg b, th, st GROUP BY te.id),
    o AS (SELECT te.*, {_tree_pred('x0', 'x2')} AS orig FROM te, th, st)
    SELECT o.id, fn.feature, [{', '.join(f'o.x{k}' for k in range(ce.P))}][fn.j + 1] AS feature_value,
           round(base, {R6}) AS base_value,
           round(CASE fn.j WHEN 0 THEN abs(orig - e0.e) WHEN 2 THEN abs(orig - e2.e) ELSE 0.0 END, {R6}) AS ablation_value
    FROM o JOIN e0 USING (id) JOIN e2 USING (id), base, {ce.FEAT_SQL}"""


_A6_EXACT = f"""WITH {ce.BASE_CTE}, {_tree_cte()},
    base AS (SELECT avg({_tree_pred('x0', 'x2')}) AS base FROM tr, th, st),
    e0 AS (SELECT te.id, avg({_tree_pred('b.b0', 'te.x2')}) AS e FROM te, bg b, th, st GROUP BY te.id),
    e2 AS (SELECT te.id, avg({_tree_pred('te.x0', 'b.b2')}) AS e FROM te, bg b, th, st GROUP BY te.id),
    o AS (SELECT te.*, {_tree_pred('x0', 'x2')} AS orig, e0.e AS e0, e2.e AS e2
          FROM te JOIN e0 USING (id) JOIN e2 USING (id), th, st),
    mean AS (SELECT fn.feature, fn.j, avg(CASE fn.j WHEN 0 THEN abs(orig - e0) WHEN 2 THEN abs(orig - e2) ELSE 0.0 END) AS m
             FROM o, {ce.FEAT_SQL} GROUP BY ALL),
    ord AS (SELECT *, row_number() OVER (ORDER BY m, feature) AS step FROM mean),
    pos AS (SELECT max(step) FILTER (j = 0) AS s0, max(step) FILTER (j = 2) AS s2 FROM ord),
    cur AS (SELECT o.id, s.step, CASE WHEN s.step >= s0 AND s.step >= s2 THEN base WHEN s.step >= s0 THEN e0
                   WHEN s.step >= s2 THEN e2 ELSE orig END AS cur FROM o, pos, base, range({ce.P + 1}) s(step))
    SELECT o.id, ord.step, ord.feature, [{', '.join(f'o.x{k}' for k in range(ce.P))}][ord.j + 1] AS feature_value,
           round(base, {R6}) AS base_value, round(orig, {R6}) AS original_prediction, round(c.cur, {R6}) AS current_prediction,
           round(abs(c.cur - b.cur), {R6}) AS cum_ablation_value
    FROM o JOIN cur c ON c.id = o.id JOIN cur b ON b.id = o.id AND b.step = c.step - 1 JOIN ord ON ord.step = c.step, base"""


def _hier_sql():
    def mean(m):
        return f"round(cast(sum(cast(round({m} * 10000) AS bigint)) AS double) / count({m})) / 10000.0"

    rows = f"""r0 AS (SELECT 'order_risk' AS dataset, a.target, 'FixedLogit' AS classifier, a.n_test,
               round(a.accuracy, 4) AS accuracy, round(f.f1_weighted, 4) AS f1_weighted, round(u.auroc, 4) AS auroc
        FROM acc a JOIN f1 f USING (target) JOIN auc u USING (target) WHERE a.target IN ('y', 'has_R', 'has_A', 'has_N')),
    av AS (SELECT dataset, 'Specialists' AS target, classifier, max(n_test) AS n_test, {mean('accuracy')} AS accuracy,
                  {mean('f1_weighted')} AS f1_weighted, {mean('auroc')} AS auroc
           FROM r0 WHERE target <> 'y' GROUP BY dataset, classifier)"""
    return f"""WITH {frames.SQL_CTE_SCORED}, {cq._F1_SQL}, {rows}
    SELECT 1 AS average_only, * FROM r0 WHERE target = 'y' UNION ALL SELECT 1, * FROM av
    UNION ALL SELECT 0, * FROM r0 UNION ALL SELECT 0, * FROM av"""


ORACLES = {
    "f6_smote": f"""WITH {_smote_cte()}
        SELECT id, base, neighbour, label, {', '.join(f'round(x{j}, {R6}) AS {n}' for j, n in enumerate(DOC_FEATURES))} FROM sy""",
    "f6_nearest_neighbours": f"""WITH {ce.BASE_CTE}, mi AS (SELECT tr.* FROM tr JOIN ors ON ors.o_orderkey = tr.id WHERE ors.y = 1),
        pr AS (SELECT a.id, b.id AS neighbour, 0.0::DOUBLE{''.join(f' + (a.x{j} - b.x{j}) * (a.x{j} - b.x{j})' for j in range(ce.P))} AS d
               FROM mi a JOIN mi b ON a.id <> b.id)
        SELECT id, neighbour, rank, round(sqrt(d), 4) AS distance FROM (
            SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, neighbour) AS rank FROM pr) WHERE rank <= {bl.K_NEIGHBOURS}""",
    "s8_balanced_export": f"""WITH {_smote_cte()},
        al2 AS (SELECT 'Train' AS Set_Type, label, 0 AS synthetic, id, x0 FROM tn
                UNION ALL SELECT 'Train', label, 1, id, x0 FROM sy
                UNION ALL SELECT 'Test', label, 0, id, x0 FROM dq WHERE split = 'test')
        SELECT Set_Type, label, synthetic, count(*) AS n, count(DISTINCT id) AS ids, round(sum(x0) / count(*), 4) AS mean_chars
        FROM al2 GROUP BY ALL""",
    "a5_ablation_exact": _A5_EXACT,
    "a6_cumulative_exact": _A6_EXACT,
    "s13_contract_skip": f"""WITH imp AS ({frames.sql_importance_long()})
        SELECT d.dataset, 'kept' AS status, (SELECT count(*) FROM imp) AS n FROM (VALUES ('whole'), ('extra')) d(dataset)
        UNION ALL SELECT 'broken', 'skipped', 0""",
    "s14_summary_sink": ca.ORACLES["i9_summary_wide"],
    "g5_hierarchical_rows": _hier_sql(),
    "f2_score_properties": f"""WITH {ce.BASE_CTE}
        SELECT id, m.model, 1 AS in_range, 1 AS agrees FROM te, (VALUES ('gbt'), ('rf')) m(model)""",
    "f9_flow_properties": f"""WITH {ce.BASE_CTE}
        SELECT id, l.category, l.label, 1 AS ok FROM te, (VALUES {', '.join(
            f"('{c.name}', '{lb}')" for c in cm.CATEGORIES for lb in c.labels)}) l(category, label)""",
    "f5_multi_output": f"WITH {ce.BASE_CTE} SELECT count(*) AS n, 1 AS at_most_least, 1 AS at_least_union FROM te",
    "a1_model_additivity": f"""WITH {ce.BASE_CTE}
        SELECT id, m.model, {ce.P} AS n_features, 1 AS additive FROM te, (VALUES ('gbt'), ('rf')) m(model)""",
}
