"""Registered explainer / merge / report queries (A*, X5, J*, G6, V6) with oracles.

The explained model is the fixed logistic scorer of ``frames.LINEAR_MODELS``
so that SQL can evaluate the very same function; every test row of the
order frame is explained (no id subsets), against the whole train split.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import MIX_MOD, sql_draw_index, sql_uhash32
from ..operators import explain as ex
from ..operators import merge as mg
from ..operators import treeshap as ts
from ..operators.draws import draw_sums
from ..operators.models import LinearLogit, features_array
from ..session import materialize, written
from ..sources.tables import Tables
from . import frames

R6 = 6
N_DRAWS = 50
FEATURES = frames.ORDER_NUMERIC
P = len(FEATURES)
SEED_A5 = "ablation"
SEED_A6 = "cumulative"


def model_for(target: str) -> LinearLogit:
    b, w = frames.LINEAR_MODELS[target]
    return LinearLogit(b, tuple(w))


def split_frames(spark, sf, label="y"):
    # a column a feature takes less disk
    base = frames.order_risk_written(
        Tables(spark, sf), F.col("o_orderkey").alias("id"), "split", *[F.col(c).cast("double").alias(c) for c in FEATURES],
        F.col(label).alias("label")).select("id", "split", features_array(FEATURES).alias("x"), "label")
    # files are read by few tasks: the rows to explain are spread, so explainers work on even parts where they lie
    return base.where(F.col("split") == "train"), materialize(ex.spread(base.where(F.col("split") == "test")))


def _ablation(spark, sf, target="y", background=None, tt=None):
    train, test = tt or split_frames(spark, sf)
    return ex.marginal_ablation(model_for(target), train, test, FEATURES, N_DRAWS, SEED_A5,
                                background=background)


def q_x5_background_draws(spark, sf):
    train, test = split_frames(spark, sf)
    bg, n = ex.number_background(train)
    got = draw_sums(bg, n, test, P, N_DRAWS, SEED_A5)
    # rows of one id count together
    each = got.groupBy("id").agg(F.count(F.lit(1)).alias("n"), *[
        F.sum(F.col(c)[j]).alias(f"{c}{j}") for c in ("drawn", "missing", "places") for j in range(P)])
    return each.select("id", F.explode(F.array(*[F.struct(
        F.lit(j).alias("j"), F.when(F.col(f"missing{j}") < F.col("n") * N_DRAWS, F.round(f"drawn{j}", R6)).alias("drawn_sum"),
        F.col(f"places{j}").cast("bigint").alias("bidx_sum")) for j in range(P)])).alias("r")).select("id", "r.*")


def q_a5_ablation_sampled(spark, sf):
    a = _ablation(spark, sf)
    return a.select("id", "feature", "feature_value", F.round("base_value", R6).alias("base_value"),
                    F.round("ablation_value", R6).alias("ablation_value"))


def q_a7_least_to_most(spark, sf):
    return ex.least_to_most(_ablation(spark, sf)).select(
        "feature", F.round("mean_ablation", R6).alias("mean_ablation"), "step")


def _cumulative(spark, sf):
    train, test = split_frames(spark, sf)
    bgn = ex.number_background(train)
    a = _ablation(spark, sf, background=bgn, tt=(train, test))
    return ex.cumulative_ablation(model_for("y"), train, test, FEATURES, a, N_DRAWS, SEED_A6,
                                  background=bgn), a


def q_a6_cumulative_ablation(spark, sf):
    c, _ = _cumulative(spark, sf)
    return c.select("id", "step", "feature", "feature_value",
                    *[F.round(k, R6).alias(k) for k in ("base_value", "original_prediction",
                                                         "current_prediction", "cum_ablation_value")])


def q_a8_multi_target_attributions(spark, sf):
    train, test = split_frames(spark, sf)
    all_targets = ex.marginal_ablation_targets({t: model_for(t) for t in ("has_R", "has_A", "has_N")}, train, test,
                                               FEATURES, N_DRAWS, SEED_A5)
    return all_targets.select("target_context", "id", "feature", F.round("ablation_value", R6).alias("ablation_value"))


def q_a1_linear_shapley(spark, sf):
    train, test = split_frames(spark, sf)
    s = ex.linear_shap(model_for("y"), train, test, FEATURES)
    return s.select("id", "feature", "feature_value", F.round("base_value", R6).alias("base_value"),
                    F.round("shap_value", R6).alias("shap_value"))


def _merged(spark, sf, with_cum=True, lime=None, tt=None):
    """``lime``: function of the train rows giving one that adds the surrogate's columns to wide rows, or None."""
    train, test = tt or split_frames(spark, sf)
    bgn = ex.number_background(train)
    abl = ex.marginal_ablation(model_for("y"), train, test, FEATURES, N_DRAWS, SEED_A5, background=bgn, wide=True)
    lime = lime(train) if lime else None
    if not with_cum:
        shap = ex.linear_shap(model_for("y"), train, test, FEATURES, wide=True)
        return mg.merge_attributions(shap=shap, ablation=abl, target_context="y", wide=FEATURES)
    abl = written(abl)  # read twice (order of the steps, rows): computed once
    order = ex.long_form(abl, FEATURES, ["ablation_value"])

    def explain(rows):
        cum = ex.cumulative_ablation(model_for("y"), train, rows, FEATURES, order, N_DRAWS, SEED_A6, background=bgn, wide=True,
                                     keep=["ablation_value"])
        got = ex.linear_shap(model_for("y"), train, cum.withColumnRenamed("feature_value", "x"), FEATURES, wide=True,
                             keep=["ablation_value", *mg.CUMULATIVE])
        return lime(got) if lime else got

    # a row's ablation goes through the cumulative draws and the surrogate with it: nothing is joined
    rows = mg.merge_along(explain, abl.select("id", F.col("feature_value").alias("x"), "ablation_value"))
    return mg.by_feature(rows, None, "y", FEATURES)


def _r6_merged(m):
    return m.select(*[F.round(c, R6).alias(c) if c not in ("id", "Target_Context", "feature") else F.col(c)
                      for c in m.columns])


def q_j4_missing_source_defaults(spark, sf):
    return _r6_merged(_merged(spark, sf, with_cum=False))


def q_v6_ablation_curve(spark, sf):
    pts = mg.ablation_curve(_merged(spark, sf), max_features=20)
    return pts.select("x_step", "feature", *[F.round(k, R6).alias(k) for k in
                                             ("mean_ablation", "mean_jump", "y")])


def q_v7_curve_annotations(spark, sf):
    ann = mg.curve_annotations(mg.ablation_curve(_merged(spark, sf), max_features=20), top_k=5)
    return ann.select("x_step", "feature", *[F.round(k, R6).alias(k) for k in
                                             ("mean_jump", "y_before", "y_after")],
                      "direction", "top_rank", "shown")


def q_a1_tree_shapley(spark, sf):
    """Path-dependent tree Shapley values of a median-split tree fitted on
    the train split, for every test row (exact SQL oracle)."""
    train, test = split_frames(spark, sf)
    ens = ts.compile_ensemble([ts.median_split_tree(train)], [1.0], P)
    s = ts.tree_shap(ens, test, FEATURES)
    return s.select("id", "feature", "feature_value", F.round("base_value", R6).alias("base_value"),
                    F.round("shap_value", R6).alias("shap_value"))


def _spark_tree_shap(spark, sf, kind):
    from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
    from pyspark.ml.functions import array_to_vector
    train, test = split_frames(spark, sf)
    tr = train.select(array_to_vector("x").alias("features"), F.col("label").cast("double").alias("label"))
    clf = GBTClassifier(maxIter=10, maxDepth=4, seed=42) if kind == "gbt" else \
        RandomForestClassifier(numTrees=10, maxDepth=4, seed=42)
    model = clf.fit(tr)
    ens = ts.compile_spark_model(spark, model, P)
    s = ts.tree_shap(ens, test, FEATURES)
    return s.select("id", "feature", "feature_value", F.round("base_value", R6).alias("base_value"),
                    F.round("shap_value", R6).alias("shap_value"))


def q_a1_tree_shapley_gbt(spark, sf):
    return _spark_tree_shap(spark, sf, "gbt")


def q_a1_tree_shapley_rf(spark, sf):
    return _spark_tree_shap(spark, sf, "rf")


QUERIES = {
    "a1_tree_shapley": q_a1_tree_shapley,
    "a1_tree_shapley_gbt": q_a1_tree_shapley_gbt,
    "a1_tree_shapley_rf": q_a1_tree_shapley_rf,
    "x5_background_draws": q_x5_background_draws,
    "a1_linear_shapley": q_a1_linear_shapley,
    "a5_ablation_sampled": q_a5_ablation_sampled,
    "a7_least_to_most": q_a7_least_to_most,
    "a6_cumulative_ablation": q_a6_cumulative_ablation,
    "a8_multi_target_attributions": q_a8_multi_target_attributions,
    "j4_missing_source_defaults": q_j4_missing_source_defaults,
    "v6_ablation_curve": q_v6_ablation_curve,
    "v7_curve_annotations": q_v7_curve_annotations,
}

# ----------------------------------------------------------------- oracles
_X = ", ".join(f"{c}::DOUBLE AS x{k}" for k, c in enumerate(FEATURES))
_B = ", ".join(f"x{k} AS b{k}" for k in range(P))
FEAT_SQL = "(VALUES " + ", ".join(f"({k}, '{c}')" for k, c in enumerate(FEATURES)) + ") fn(j, feature)"


def _prob(target, cols):
    b, w = frames.LINEAR_MODELS[target]
    z = f"{float(b)!r}::DOUBLE" + "".join(f" + {float(wi)!r}::DOUBLE * ({c})" for wi, c in zip(w, cols))
    return f"(1.0::DOUBLE / (1.0::DOUBLE + exp(-({z}))))"


BASE_CTE = f"""ors AS ({frames.SQL_ORDER_RISK_SPLIT}),
    tr AS (SELECT o_orderkey AS id, {_X} FROM ors WHERE split = 'train'),
    te AS (SELECT o_orderkey AS id, {_X} FROM ors WHERE split = 'test'),
    bg AS (SELECT row_number() OVER (ORDER BY id) - 1 AS bidx, {_B} FROM tr),
    nb AS (SELECT count(*) AS n FROM tr)"""


def _a5_cte(target="y", name="a5", draws=None, te="te"):
    cols = [f"CASE WHEN dr.j = {k} THEN bg.b{k} ELSE dr.x{k} END" for k in range(P)]
    te_cols = [f"x{k}" for k in range(P)]
    tr_cols = [f"x{k}" for k in range(P)]
    return f"""{name}_dr AS (SELECT t.*, j.j, d.d,
                  {sql_draw_index('t.rs', 'd.d', 'j.j', 'nb.n')} AS bidx
           FROM (SELECT *, {sql_uhash32(SEED_A5, 'id')} % {MIX_MOD} AS rs FROM {te}) t,
                range({P}) j(j), range({draws or N_DRAWS}) d(d), nb),
    {name}_pt AS (SELECT dr.id, dr.j, {_prob(target, cols)} AS pred FROM {name}_dr dr JOIN bg USING (bidx)),
    {name}_avg AS (SELECT id, j, avg(pred) AS avg_pred FROM {name}_pt GROUP BY ALL),
    {name}_orig AS (SELECT id, {_prob(target, te_cols)} AS orig, {', '.join(te_cols)} FROM {te}),
    {name}_base AS (SELECT avg({_prob(target, tr_cols)}) AS base FROM tr),
    {name} AS (SELECT a.id, fn.feature,
                  [{', '.join(f'o.x{k}' for k in range(P))}][a.j + 1] AS feature_value,
                  b.base AS base_value, abs(o.orig - a.avg_pred) AS ablation_value
           FROM {name}_avg a JOIN {name}_orig o USING (id) JOIN {FEAT_SQL} USING (j), {name}_base b)"""


def _a7_cte(name="a7", of="a5"):
    return f"""{name} AS (SELECT feature, avg(ablation_value) AS mean_ablation,
                  row_number() OVER (ORDER BY avg(ablation_value), feature) AS step
           FROM {of} GROUP BY feature)"""


_A7_CTE = _a7_cte()


def _a6_cte(target="y", name="a6", a7="a7", a5="a5", draws=None, te="te"):
    ranks = ", ".join(f"(SELECT step FROM {a7} WHERE feature = '{c}') AS r{k}" for k, c in enumerate(FEATURES))
    cols = [f"CASE WHEN rk.r{k} <= dr.s THEN bg.b{k} ELSE dr.x{k} END" for k in range(P)]
    return f"""{name}_rk AS (SELECT {ranks}),
    {name}_dr AS (SELECT t.*, s.s, d.d, {sql_draw_index('t.rs', 'd.d', 's.s', 'nb.n')} AS bidx
              FROM (SELECT *, {sql_uhash32(SEED_A6, 'id')} % {MIX_MOD} AS rs FROM {te}) t,
                   range(1, {P + 1}) s(s), range({draws or N_DRAWS}) d(d), nb),
    {name}_pt AS (SELECT dr.id, dr.s, {_prob(target, cols)} AS pred FROM {name}_dr dr JOIN bg USING (bidx), {name}_rk rk),
    {name}_cur AS (SELECT id, s, avg(pred) AS current_prediction FROM {name}_pt GROUP BY ALL),
    {name} AS (SELECT c.id, c.s AS step, a.feature,
                  [{', '.join(f'o.x{k}' for k in range(P))}][fn.j + 1] AS feature_value,
                  b.base AS base_value, o.orig AS original_prediction, c.current_prediction,
                  abs(coalesce(lag(c.current_prediction) OVER (PARTITION BY c.id ORDER BY c.s), o.orig)
                      - c.current_prediction) AS cum_ablation_value
           FROM {name}_cur c JOIN {a5}_orig o USING (id) JOIN {a7} a ON a.step = c.s
           JOIN {FEAT_SQL} ON fn.feature = a.feature, {a5}_base b)"""


def _shap_cte(target="y", name="shap", te="te"):
    b, w = frames.LINEAR_MODELS[target]
    means = ", ".join(f"avg(x{k}) AS m{k}" for k in range(P))
    base = f"{float(b)!r}::DOUBLE" + "".join(f" + {float(wi)!r}::DOUBLE * m{k}" for k, wi in enumerate(w))
    wl = "[" + ", ".join(f"{float(wi)!r}::DOUBLE" for wi in w) + "]"
    ml = "[" + ", ".join(f"m.m{k}" for k in range(P)) + "]"
    xl = "[" + ", ".join(f"te.x{k}" for k in range(P)) + "]"
    return f"""{name}_mu AS (SELECT {means} FROM tr),
    {name} AS (SELECT te.id, fn.feature, ({xl})[fn.j + 1] AS feature_value, {base.replace('m', 'm.m')} AS base_value,
                    ({wl})[fn.j + 1] * (({xl})[fn.j + 1] - ({ml})[fn.j + 1]) AS shap_value
             FROM {te} te, {name}_mu m, {FEAT_SQL})"""


def _merged_sql(with_cum=True, with_lime=False):
    lime = "l.lime_value" if with_lime else "0.0::DOUBLE AS lime_value"
    lime_base = "l.base_value_lime" if with_lime else "NULL::DOUBLE AS base_value_lime"
    lime_join = f"LEFT JOIN (SELECT * FROM lime JOIN {FEAT_SQL} USING (j)) l ON l.id = s.id AND l.feature = s.feature" \
        if with_lime else ""
    cum_cols = ("coalesce(c.cum_ablation_value, NULL) AS cum_ablation_value, c.original_prediction, "
                "c.current_prediction") if with_cum else \
        "0.0::DOUBLE AS cum_ablation_value, NULL::DOUBLE AS original_prediction, NULL::DOUBLE AS current_prediction"
    cum_join = "LEFT JOIN a6 c ON c.id = s.id AND c.feature = s.feature" if with_cum else ""
    return f"""merged AS (SELECT s.id, 'y' AS Target_Context, s.feature, s.feature_value, s.shap_value,
                  {lime}, a.ablation_value, {cum_cols},
                  s.base_value AS base_value_shap, {lime_base}
           FROM shap s LEFT JOIN a5 a ON a.id = s.id AND a.feature = s.feature {cum_join} {lime_join})"""


def _round_all(cols):
    return ", ".join(f"round({c}, {R6}) AS {c}" for c in cols)


_CURVE_BODY = """per AS (SELECT feature, avg(ablation_value) AS mean_ablation, avg(cum_ablation_value) AS mean_jump,
                       avg(current_prediction) AS y FROM merged GROUP BY feature),
        top AS (SELECT *, row_number() OVER (ORDER BY mean_ablation DESC, feature DESC) AS rd FROM per),
        curve AS (SELECT row_number() OVER (ORDER BY mean_ablation, feature) AS x_step, feature, mean_ablation,
                         mean_jump, y FROM top WHERE rd <= 20
                  UNION ALL SELECT 0, 'Original', NULL::DOUBLE, NULL::DOUBLE, avg(original_prediction) FROM merged)"""

MERGED_NUM = ["feature_value", "shap_value", "lime_value", "ablation_value", "cum_ablation_value",
              "original_prediction", "current_prediction", "base_value_shap", "base_value_lime"]

_CURVE = (f"{BASE_CTE}, {_a5_cte()}, {_A7_CTE}, {_a6_cte()}, {_shap_cte()}, {_merged_sql()}, "
          + _CURVE_BODY)

_TREE_SQL = f"""WITH {BASE_CTE},
    t0 AS (SELECT quantile_cont(x0, 0.5) AS t0 FROM tr),
    t12 AS (SELECT quantile_cont(CASE WHEN x0 <= t0 THEN x2 END, 0.5) AS t1,
                   quantile_cont(CASE WHEN x0 > t0 THEN x0 END, 0.5) AS t2 FROM tr, t0),
    th AS (SELECT * FROM t0, t12),
    lf AS (SELECT CASE WHEN x0 <= t0 AND x2 <= t1 THEN 3 WHEN x0 <= t0 THEN 4
                       WHEN x0 <= t2 THEN 5 ELSE 6 END AS leaf, count(*) AS n,
                  avg(CASE WHEN ors.y = 1 THEN 1.0 ELSE 0.0 END) AS v
           FROM tr JOIN ors ON ors.o_orderkey = tr.id, th GROUP BY 1),
    st AS (SELECT coalesce(max(CASE WHEN leaf = 3 THEN n END), 0)::DOUBLE AS n3,
                  coalesce(max(CASE WHEN leaf = 4 THEN n END), 0)::DOUBLE AS n4,
                  coalesce(max(CASE WHEN leaf = 5 THEN n END), 0)::DOUBLE AS n5,
                  coalesce(max(CASE WHEN leaf = 6 THEN n END), 0)::DOUBLE AS n6,
                  coalesce(max(CASE WHEN leaf = 3 THEN v END), 0) AS v3,
                  coalesce(max(CASE WHEN leaf = 4 THEN v END), 0) AS v4,
                  coalesce(max(CASE WHEN leaf = 5 THEN v END), 0) AS v5,
                  coalesce(max(CASE WHEN leaf = 6 THEN v END), 0) AS v6 FROM lf),
    k AS (SELECT *, n3 + n4 + n5 + n6 AS nn, n3 + n4 AS nl, n5 + n6 AS nr FROM st),
    phi AS (SELECT te.id,
        -- leaf 3: x0 in (-inf, t0], x2 in (-inf, t1]; leaf 4: x0 in (-inf, t0], x2 in (t1, inf)
        v3 * ((CASE WHEN x0 <= t0 THEN 1 ELSE 0 END) - nl / nn) * ((n3 / nl) + (CASE WHEN x2 <= t1 THEN 1 ELSE 0 END)) / 2
      + v4 * ((CASE WHEN x0 <= t0 THEN 1 ELSE 0 END) - nl / nn) * ((n4 / nl) + (CASE WHEN x2 > t1 THEN 1 ELSE 0 END)) / 2
      -- leaf 5: x0 in (t0, t2] (merged repeated feature); leaf 6: x0 in (t2, inf)
      + v5 * ((CASE WHEN x0 > t0 AND x0 <= t2 THEN 1 ELSE 0 END) - (nr / nn) * (n5 / nr))
      + v6 * ((CASE WHEN x0 > t2 THEN 1 ELSE 0 END) - (nr / nn) * (n6 / nr)) AS phi0,
        v3 * ((CASE WHEN x2 <= t1 THEN 1 ELSE 0 END) - n3 / nl) * ((nl / nn) + (CASE WHEN x0 <= t0 THEN 1 ELSE 0 END)) / 2
      + v4 * ((CASE WHEN x2 > t1 THEN 1 ELSE 0 END) - n4 / nl) * ((nl / nn) + (CASE WHEN x0 <= t0 THEN 1 ELSE 0 END)) / 2 AS phi2,
        (v3 * n3 + v4 * n4 + v5 * n5 + v6 * n6) / nn AS base,
        [{', '.join(f'te.x{k}' for k in range(P))}] AS xs
      FROM te, th, k)
    SELECT id, fn.feature, xs[fn.j + 1] AS feature_value, round(base, {R6}) AS base_value,
           round(CASE fn.j WHEN 0 THEN phi0 WHEN 2 THEN phi2 ELSE 0.0 END, {R6}) AS shap_value
    FROM phi, {FEAT_SQL}"""

ORACLES = {
    "a1_tree_shapley": _TREE_SQL,
    "x5_background_draws": f"""WITH {BASE_CTE}, {_a5_cte()}
        SELECT dr.id, dr.j, round(sum([{', '.join(f'bg.b{k}' for k in range(P))}][dr.j + 1]), {R6}) AS drawn_sum,
               sum(dr.bidx) AS bidx_sum
        FROM a5_dr dr JOIN bg USING (bidx) GROUP BY ALL""",
    "a1_linear_shapley": f"""WITH {BASE_CTE}, {_shap_cte()}
        SELECT id, feature, feature_value, round(base_value, {R6}) AS base_value,
               round(shap_value, {R6}) AS shap_value FROM shap""",
    "a5_ablation_sampled": f"""WITH {BASE_CTE}, {_a5_cte()}
        SELECT id, feature, feature_value, round(base_value, {R6}) AS base_value,
               round(ablation_value, {R6}) AS ablation_value FROM a5""",
    "a7_least_to_most": f"""WITH {BASE_CTE}, {_a5_cte()}, {_A7_CTE}
        SELECT feature, round(mean_ablation, {R6}) AS mean_ablation, step FROM a7""",
    "a6_cumulative_ablation": f"""WITH {BASE_CTE}, {_a5_cte()}, {_A7_CTE}, {_a6_cte()}
        SELECT id, step, feature, feature_value, round(base_value, {R6}) AS base_value,
               round(original_prediction, {R6}) AS original_prediction,
               round(current_prediction, {R6}) AS current_prediction,
               round(cum_ablation_value, {R6}) AS cum_ablation_value FROM a6""",
    "a8_multi_target_attributions": f"""WITH {BASE_CTE}, {_a5_cte('has_R', 'ar')}, {_a5_cte('has_A', 'aa')},
        {_a5_cte('has_N', 'an')}
        SELECT 'has_R' AS target_context, id, feature, round(ablation_value, {R6}) AS ablation_value FROM ar
        UNION ALL SELECT 'has_A', id, feature, round(ablation_value, {R6}) FROM aa
        UNION ALL SELECT 'has_N', id, feature, round(ablation_value, {R6}) FROM an""",
    "j4_missing_source_defaults": f"""WITH {BASE_CTE}, {_a5_cte()}, {_shap_cte()}, {_merged_sql(False)}
        SELECT id, Target_Context, feature, {_round_all(MERGED_NUM)} FROM merged""",
    "v6_ablation_curve": f"""WITH {_CURVE}
        SELECT x_step, feature, round(mean_ablation, {R6}) AS mean_ablation, round(mean_jump, {R6}) AS mean_jump,
               round(y, {R6}) AS y FROM curve""",
    "v7_curve_annotations": f"""WITH {_CURVE},
        c2 AS (SELECT *, lag(y) OVER (ORDER BY x_step) AS y_before FROM curve),
        c3 AS (SELECT *, row_number() OVER (ORDER BY mean_jump DESC, x_step) AS r FROM c2 WHERE x_step > 0)
        SELECT x_step, feature, round(mean_jump, {R6}) AS mean_jump, round(y_before, {R6}) AS y_before,
               round(y, {R6}) AS y_after, CASE WHEN y <= y_before THEN 'down' ELSE 'up' END AS direction,
               CASE WHEN r <= 5 THEN r END AS top_rank, cast(r <= 5 OR mean_jump >= 0.001 AS integer) AS shown
        FROM c3""",
}
