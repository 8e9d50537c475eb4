"""Ablation under draws: in the row, by background blocks, and as exploded draws give the same values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from concordia.operators import draws
from concordia.operators import explain as ex
from concordia.operators.models import LinearLogit

P, NAMES = 3, list("abc")


class SparkOnly:
    def __init__(self, inner):
        self.inner = inner

    def predict(self, df, arr_col, out="pred"):
        return self.inner.predict(df, arr_col, out)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rng.normal(size=(300, P)))],
                               "id long, x array<double>").repartition(4).checkpoint()
    return df.where("id < 230"), df.where("id >= 230")


MODEL = LinearLogit(0.2, (1.0, -2.0, 0.5))
OTHER = LinearLogit(-0.1, (0.1, 0.7, 3.0))


def values(df, column):
    return {(r["id"], r["feature"]): (r["feature_value"], r["base_value"], r[column]) for r in df.collect()}


def same(a, b):
    assert a.keys() == b.keys() and a
    for k in a:
        assert a[k] == pytest.approx(b[k], abs=1e-12)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("visitors,cells", [(1 << 14, 1 << 20), (9, 30)])
def test_marginal_and_cumulative(spark, data, monkeypatch, visitors, cells):
    train, test = data
    monkeypatch.setattr(draws, "VISITORS", visitors)
    monkeypatch.setattr(draws, "BLOCK_CELLS", cells)
    bg, n = ex.number_background(train)
    given = (bg.checkpoint(), n)
    old = ex.marginal_ablation(SparkOnly(MODEL), train, test, NAMES, 20)
    small = ex.marginal_ablation(MODEL, train, test, NAMES, 20, background=given)
    large = ex.marginal_ablation(MODEL, train, test, NAMES, 20, broadcast_bytes=0, background=given)
    same(values(old, "ablation_value"), values(small, "ablation_value"))
    same(values(old, "ablation_value"), values(large, "ablation_value"))
    assert "Exchange" not in plan_of(small) and "Join" not in plan_of(large)
    runs = [ex.cumulative_ablation(m, train, test, NAMES, old, 20, broadcast_bytes=b, background=given)
            for m, b in ((SparkOnly(MODEL), ex.BROADCAST_BYTES), (MODEL, ex.BROADCAST_BYTES), (MODEL, 0))]
    for column in ("cum_ablation_value", "current_prediction", "original_prediction", "step"):
        same(values(runs[0], column), values(runs[1], column))
        same(values(runs[0], column), values(runs[2], column))
    assert "Exchange" not in plan_of(runs[1]) and "Join" not in plan_of(runs[2])


def test_several_targets_equal_one_by_one(spark, data):
    train, test = data
    both = {"m": MODEL, "o": OTHER}
    marginal = ex.marginal_ablation_targets(both, train, test, NAMES, 15)
    cumulative = ex.cumulative_ablation_targets(both, train, test, NAMES, marginal, 15)
    for t, model in both.items():
        one = ex.marginal_ablation(model, train, test, NAMES, 15)
        same(values(marginal.where(F.col("target_context") == t), "ablation_value"), values(one, "ablation_value"))
        same(values(cumulative.where(F.col("target_context") == t), "cum_ablation_value"),
             values(ex.cumulative_ablation(model, train, test, NAMES, one, 15), "cum_ablation_value"))


def test_surrogates_of_several_targets_equal_one_by_one(spark, data):
    from concordia.operators import lime as lm
    from concordia.operators import merge as mg

    train, test = data
    both = {"m": MODEL, "o": OTHER}
    fitted = lm.fit(train, P)
    together = lm.lime_weights_targets(both, train, test, NAMES, 200, fitted=fitted)
    for t, model in both.items():
        same(values(together.where(F.col("target_context") == t), "lime_value"),
             values(lm.lime_weights(model, train, test, NAMES, 200, fitted=fitted), "lime_value"))
    merged = mg.attributions_targets(both, {t: ex.linear_shap(m, train, test, NAMES) for t, m in both.items()},
                                     train, test, NAMES, 15, 200)
    assert merged.count() == 2 * 70 * P and merged.where(
        "shap_value IS NULL OR lime_value IS NULL OR ablation_value IS NULL OR cum_ablation_value IS NULL").count() == 0


def test_no_rows(spark, data):
    train, test = data
    for size in (0, 1 << 20):
        assert ex.marginal_ablation(MODEL, train, test.where("id < 0"), NAMES, 5, broadcast_bytes=size).collect() == []


def test_large_background_moves_no_visits(spark, data, monkeypatch):
    """Rows stay where they lie, whatever the number of blocks: neither visits nor their sums are exchanged."""
    train, test = data
    monkeypatch.setattr(draws, "BLOCK_CELLS", 30)
    plan = plan_of(ex.marginal_ablation(MODEL, train, test, NAMES, 20, broadcast_bytes=0))
    assert not [w for w in ("Exchange", "Aggregate", "Group", "Join") if w in plan]


def test_draw_sums_equal_exploded_draws(spark, data, monkeypatch):
    """Batches and blocks smaller than the table; nulls in the background are not summed; NaN is a value."""
    train, test = data
    monkeypatch.setattr(draws, "VISITORS", 9)
    monkeypatch.setattr(draws, "BLOCK_CELLS", 60)
    bg, n = ex.number_background(train)
    bg = bg.withColumn("x", F.expr("transform(x, (v, j) -> CASE WHEN j = 1 AND bidx % 3 = 0 THEN null "
                                   "WHEN j = 2 AND bidx = 5 THEN double('NaN') ELSE v END)")).checkpoint()
    got = {r["id"]: r for r in draws.draw_sums(bg, n, test, P, 20, "s").collect()}
    long = ex.marginal_draws(test, P, 20, n, "s").join(bg.select("bidx", F.posexplode("x").alias("j", "v")), ["j", "bidx"])
    want = long.groupBy("id", "j").agg(F.sum("v").alias("v"), F.sum(F.col("v").isNull().cast("int")).alias("m"),
                                       F.sum("bidx").alias("b")).collect()
    assert len(want) == len(got) * P == 70 * P
    for r in want:
        row = got[r["id"]]
        assert row["drawn"][r["j"]] == pytest.approx(r["v"], abs=1e-9, nan_ok=True)
        assert (row["missing"][r["j"]], row["places"][r["j"]]) == (r["m"], r["b"])


def test_background_is_dealt_once_and_cut_where_it_lies(spark, data, monkeypatch):
    """Numbers in id order without another exchange; blocks of any length, a background in no order too, give the same."""
    train, test = data
    bg, n = ex.number_background(train)
    assert n == 230 and not [w for w in ("Exchange", "Window", "Join") if w in plan_of(bg)]
    ids = train.groupBy("x").agg(F.min("id").alias("id"))
    assert all(r["bidx"] == r["id"] for r in bg.join(ids, "x").collect())
    small = ex.marginal_ablation(MODEL, train, test, NAMES, 20, background=(bg, n))
    monkeypatch.setattr(draws, "BLOCK_CELLS", 30)
    for given in (bg, bg.coalesce(1), bg.repartition(5, F.col("bidx") % 7), bg.orderBy(F.col("bidx").desc())):
        large = ex.marginal_ablation(MODEL, train, test, NAMES, 20, broadcast_bytes=0, background=(given, n))
        same(values(small, "ablation_value"), values(large, "ablation_value"))


def test_wide_tables_merge_as_long_ones(spark, data):
    """Joined on the id and spread by feature afterwards: the rows of the long join, for repeated and null ids too."""
    from concordia.operators import merge as mg

    train, test = data
    odd = test.where("id < 242").union(test.where("id IN (232, 233)").select(*[
        F.transform("x", lambda v: v + 1.0).alias(c) if c == "x" else F.col(c) for c in test.columns])) \
        .union(test.where("id = 235").withColumn("id", F.lit(None).cast(test.schema["id"].dataType)).select(test.columns))
    odd = odd.union(odd.where("id = 237")).checkpoint()
    bg = ex.number_background(train)

    def merged(wide):
        abl = ex.marginal_ablation(MODEL, train, odd, NAMES, 5, background=bg, wide=wide).checkpoint()
        cum = ex.cumulative_ablation(MODEL, train, odd, NAMES, ex.long_form(abl, NAMES, ["ablation_value"]) if wide else abl, 5,
                                     background=bg, wide=wide)
        shap = ex.linear_shap(MODEL, train, odd, NAMES, wide=wide)
        return [mg.merge_attributions(shap=shap, ablation=a, cumulative=c, target_context="y", wide=NAMES if wide else None)
                for a, c in ((abl, cum), (abl, None), (None, None))]

    for got, want in zip(merged(True), merged(False)):
        assert got.columns == want.columns and got.dtypes == want.dtypes
        rows = [sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in f.collect()), key=str) for f in (got, want)]
        assert rows[0] == rows[1] and len(rows[0]) >= P * odd.count()


def _odd_rows(test):
    """Rows with repeated and null ids among others."""
    odd = test.where("id < 242").union(test.where("id IN (232, 233)").select(*[
        F.transform("x", lambda v: v + 1.0).alias(c) if c == "x" else F.col(c) for c in test.columns]))
    return odd.union(test.where("id IN (235, 236)").withColumn("id", F.lit(None).cast(test.schema["id"].dataType)).select(test.columns))


@pytest.mark.parametrize("rows, limit", [("odd", 1 << 20), ("odd", 0), ("once", 0)])
def test_a_merge_along_the_rows_gives_the_joined_rows(spark, data, rows, limit):
    """Nothing is joined for ids that come once; repeated and null ids are merged as the joins do."""
    from concordia.operators import merge as mg

    train, test = data
    test = _odd_rows(test).checkpoint() if rows == "odd" else test.where("id < 260")
    bg = ex.number_background(train)
    abl = ex.marginal_ablation(MODEL, train, test, NAMES, 5, broadcast_bytes=limit, background=bg, wide=True).checkpoint()
    order = ex.long_form(abl, NAMES, ["ablation_value"])

    def cumulative(rows, keep=()):
        return ex.cumulative_ablation(MODEL, train, rows, NAMES, order, 5, broadcast_bytes=limit, background=bg, wide=True, keep=keep)

    def explain(rows):
        return ex.linear_shap(MODEL, train, cumulative(rows, ["ablation_value"]).withColumnRenamed("feature_value", "x"), NAMES,
                              wide=True, keep=["ablation_value", *mg.CUMULATIVE])

    got = mg.by_feature(mg.merge_along(explain, abl.select("id", F.col("feature_value").alias("x"), "ablation_value")), None, "y", NAMES)
    want = mg.merge_attributions(shap=ex.linear_shap(MODEL, train, test, NAMES, wide=True), ablation=abl, cumulative=cumulative(test),
                                 target_context="y", wide=NAMES)
    assert got.dtypes == want.dtypes
    a, b = (sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in f.collect()), key=str) for f in (got, want))
    assert a == b and len(a) >= P * test.count()
    if rows == "once":
        assert "Join" not in plan_of(got)


def test_a_merge_deals_a_row_an_id(spark, data):
    """Features are spread above the joins, so that what is shuffled is a row an id and not one a feature."""
    from concordia.operators import merge as mg

    train, test = data
    abl = ex.marginal_ablation(MODEL, train, test, NAMES, 5, wide=True)
    plan = mg.merge_attributions(shap=ex.linear_shap(MODEL, train, test, NAMES, wide=True), ablation=abl, wide=NAMES) \
        ._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and plan.index("Generate") < plan.index("Join")


def test_written_frames_leave_no_shuffle_behind(spark, data, tmp_path):
    """Read back as they were, nulls and NaN too; from a table, without the shuffles that made it; the session's setting is kept."""
    from concordia.session import CLEANUP, written

    train, _ = data
    rows = train.select("id", F.when(F.col("id") % 3 > 0, F.lit(float("nan"))).alias("v"), "x").repartition(4, "id")
    before = spark.conf.get(CLEANUP, None)
    got = written(rows)
    assert spark.conf.get(CLEANUP, None) == before and got.dtypes == rows.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, rows.collect()))
    assert "FileScan parquet" in plan_of(got) and "Exchange" not in plan_of(got)


def test_explainers_share_the_blocks_of_a_background(spark, data, monkeypatch):
    """Two passes over one background cut and write its blocks once."""
    train, test = data
    monkeypatch.setattr(draws, "BLOCK_CELLS", 30)
    bg, n = ex.number_background(train)
    abl = ex.marginal_ablation(MODEL, train, test, NAMES, 5, broadcast_bytes=0, background=(bg, n))
    (first,) = draws._BLOCKS[bg].values()
    ex.cumulative_ablation(MODEL, train, test, NAMES, abl, 5, broadcast_bytes=0, background=(bg, n))
    (second,) = draws._BLOCKS[bg].values()
    assert first[0] is second[0]


def test_the_driver_holds_no_background_of_several_mb(spark, data, monkeypatch):
    _, test = data
    n = 200_000
    bg = spark.range(n).select(F.col("id").alias("bidx"), F.array(*[(F.col("id") % (5 + k)).cast("double") for k in range(P)]).alias("x"))
    plans = [(np.eye(P), lambda x: x.sum(axis=1))]

    def means(limit):
        got = draws.draw_means(plans, bg, n, test, P, range(P), 4, "s", limit)
        return {r["id"]: r["means"] for r in got.collect()}

    monkeypatch.setattr(draws, "DRIVER_BYTES", 1 << 30, raising=False)
    whole = means(1 << 30)
    monkeypatch.undo()

    def collected(*args):
        raise AssertionError("the driver holds the background")

    monkeypatch.setattr(draws, "_in_rows", collected)
    blocks = means(64 << 20)
    assert blocks.keys() == whole.keys() and all(blocks[k] == pytest.approx(whole[k], abs=1e-9) for k in whole)
