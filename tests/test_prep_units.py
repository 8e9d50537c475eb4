"""Hand-made edge cases for cleaning, encoding, sampling and quality."""

import pytest
from pyspark.sql import functions as F

from concordia.operators import clean as cl
from concordia.operators import encode as en
from concordia.operators import quality as q
from concordia.operators import sample as sm


def test_null_tokens_exact_match(spark):
    df = spark.createDataFrame([("?",), (" ?",), ("NA",), ("",), ("null",), ("x",)], "a string")
    got = [r["a"] for r in cl.normalize_null_tokens(df).collect()]
    assert got == [None, " ?", None, None, None, "x"]


def test_code_groups_edges(spark):
    codes = ["250.83", "459.5", "459", "785", "V45", "E850", "abc", None, "2500", "800", "140", "239.9", "630"]
    df = spark.createDataFrame([(c,) for c in codes], "c string")
    got = [r["g"] for r in df.select(cl.code_group("c").alias("g")).collect()]
    assert got == ["Diabetes", "Other", "Circulatory", "Circulatory", "Other", "Other", "Other", "Other",
                   "Diabetes", "Injury", "Neoplasms", "Other", "Other"]


def test_filters_keep_null_like_pandas(spark):
    df = spark.createDataFrame([("train", "Unknown/Invalid", "11"), ("train", None, None),
                                ("train", "F", "3"), ("test", "Unknown/Invalid", "11")],
                               "split string, g string, d string")
    out = cl.filter_not_in_train(cl.filter_not_equal_train(df, "g", "Unknown/Invalid"), "d", [11, 13])
    assert out.count() == 3


def test_imputer_thresholds_and_mode_ties(spark):
    rows = [("1", "b", None), ("2", "a", None), ("x", "b", "1"), ("3", "a", "2")]
    df = spark.createDataFrame(rows, "n string, c string, half string")
    fit = en.fit_imputer(df, ["n", "c", "half"])
    assert fit.promoted == ["n"]                  # 1/4 unparsable < 0.5; half: 2/4 is not < 0.5
    assert "half" in fit.kept                     # null share exactly 0.5 is kept (drop only > 0.5)
    assert fit.means["n"] == pytest.approx(2.0)   # 'x' -> NULL -> filled with the mean
    assert fit.modes["c"] == "a"                  # tie -> smallest


def test_one_hot_train_levels_and_null(spark):
    train = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    test = spark.createDataFrame([("b",), ("z",), (None,)], "k string")
    lv = en.fit_levels(train, ["k"])
    out = en.one_hot(test, lv, drop_first=True)
    assert out.columns == ["k_b", "k_c"]
    assert [tuple(r) for r in out.collect()] == [(1, 0), (0, 0), (0, 0)]


def test_correlated_drop_is_not_greedy(spark):
    rows = [(float(i), float(i) + (0.3 if i % 2 else -0.3), float(i) * 2 + (1.0 if i % 3 == 0 else 0.0), 1.0)
            for i in range(30)]
    df = spark.createDataFrame(rows, "a double, b double, c double, k double")
    kept = en.fit_correlated_drop(df, ["a", "b", "c", "k"], 0.9)
    assert kept == ["a", "k"]   # b and c dropped (c also correlates with dropped b); constant kept


def test_quantile_bins_duplicates_and_min_distinct(spark):
    vals = [0.0] * 10 + [1.0, 2.0, 3.0]       # 4 distinct -> untouched
    vals2 = [0.0] * 8 + list(range(1, 12))     # duplicate lower edges
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(vals + [3.0] * 6, vals2)], "u double, v double")
    fit = en.fit_quantile_bins(df, ["u", "v"])
    assert "u" not in fit.edges
    labels = {r["v"] for r in en.apply_quantile_bins(df, fit).collect()}
    assert labels <= set(en.BIN_LABELS)
    assert len(fit.edges["v"]) - 1 == len(labels)


def test_stratified_split_exact_total(spark):
    rows = [(i, "A" if i % 3 else "B") for i in range(1, 101)]
    df = spark.createDataFrame(rows, "id long, y string")
    s = sm.stratified_split(df, "id", "y")
    assert s.where(F.col("split") == "test").count() == 30


def test_auroc_one_class_is_null_and_ties(spark):
    df = spark.createDataFrame([("g", 1, 0.5), ("g", 1, 0.7), ("h", 1, 0.5), ("h", 0, 0.5), ("h", 0, 0.1)],
                               "k string, label int, score double")
    got = {r["k"]: r["auroc"] for r in q.auroc(df, ["k"]).collect()}
    assert got["g"] is None
    assert got["h"] == pytest.approx(0.75)


def test_weighted_f1_zero_division(spark):
    df = spark.createDataFrame([("g", 0, 1), ("g", 0, 1), ("g", 1, 1)], "k string, label int, prediction int")
    f1 = q.weighted_f1(df, ["k"]).first()["f1_weighted"]
    # class 0: tp 0 -> f1 0 (weight 2/3); class 1: tp 1, support 1, predicted 3 -> 0.5 (weight 1/3)
    assert f1 == pytest.approx(0.5 / 3)
