"""Cases that used to fail: booleans, dotted names, odd numbers, large groups, class-level joins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from concordia.functions.quantiles import exact_quantiles, modes
from concordia.operators import agreement, clean, encode, sample


def test_quantiles_equal_interpolation(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=501), np.repeat(0.25, 300)])
    df = spark.createDataFrame([(float(v), int(i % 7), None) for i, v in enumerate(x)], "`a.b` double, k int, n double")
    probs = (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)
    got = exact_quantiles(df, ["a.b", "k", "n"], probs)
    assert np.allclose(got["a.b"][1], np.quantile(x, probs)) and got["a.b"][0] == len(set(x))
    assert np.allclose(got["k"][1], np.quantile(np.arange(801) % 7, probs)) and got["n"] == (0, None)
    assert exact_quantiles(df, [], probs) == {}


def test_modes_keep_types_and_break_ties_low(spark):
    df = spark.createDataFrame([(True, "b", None), (True, "a", None), (False, None, None)], "f boolean, `s.1` string, n string")
    assert modes(df, ["f", "s.1", "n"]) == {"f": True, "s.1": "a", "n": None}


def test_imputer_fills_booleans_by_mode(spark):
    df = spark.createDataFrame([(True, 1.0), (None, None), (True, 3.0), (False, 2.0)], "`f.1` boolean, x double")
    fitted = encode.fit_imputer(df, ["f.1", "x"])
    got = encode.apply_imputer(df, fitted).collect()
    assert [r["f.1"] for r in got] == [True, True, True, False] and got[1]["x"] == 2.0


def test_dotted_names_pass_through_the_chain(spark):
    df = spark.createDataFrame([(float(i % 3), i) for i in range(30)], "f double, y int")
    wide = encode.one_hot(df, encode.fit_levels(df, ["f"]))
    assert wide.columns == ["f_0.0", "f_1.0", "f_2.0", "y"]
    assert encode.fit_correlated_drop(wide, wide.columns, 0.9) == wide.columns
    bins = encode.fit_quantile_bins(wide, wide.columns, min_distinct=10)
    assert set(bins.edges) == {"y"} and encode.apply_quantile_bins(wide, bins).columns == wide.columns
    part = wide.drop("f_1.0")
    got = clean.align_columns(part, wide.select("`f_0.0`", "`f_1.0`"), keep=["y"])
    assert got.columns == ["y", "f_0.0", "f_1.0"] and got.schema["f_1.0"].dataType == wide.schema["f_1.0"].dataType


def test_sparse_one_hot_has_no_level_limit(spark):
    df = spark.range(30_000).select("id", F.concat(F.lit("v"), F.col("id") % 20_000).alias("c.x"))
    levels = encode.level_table(df, ["c.x"], drop_first=True)
    assert levels.count() == 19_999
    assert encode.one_hot_long(df, "id", ["c.x"], levels).count() == 30_000 - 2


def test_numbers_are_read_as_numbers_only(spark):
    rows = [("1d",), ("1f",), ("3000000000",), (" 2.5 ",), ("1e3",), ("NaN",), (".5",), ("x",), (None,)]
    df = spark.createDataFrame(rows, "v string")
    got = [r[0] for r in df.select(clean.try_double("v")).collect()]
    assert got[:2] == [None, None] and got[2:5] == [3e9, 2.5, 1000.0] and got[5] != got[5] and got[6:] == [0.5, None, None]
    big = df.where("v = '3000000000'")
    assert clean.apply_target_types(big, clean.fit_target_types(big, ["v"])).first()["v"] == 3_000_000_000
    with pytest.raises(ValueError, match="target columns"):
        clean.require_columns(df, ["w"], "target columns")


def test_row_ids_of_several_keys_are_unique(spark):
    df = spark.range(500).select((F.col("id") % 25).alias("a"), F.floor(F.col("id") / 25).alias("b"))
    got = clean.with_row_id(df, ["a", "b"])
    assert sorted(r["id"] for r in got.collect()) == list(range(1, 501))


def test_spearman_of_three_million_attributes(spark):
    n = 3_000_000
    points = spark.range(n).select(F.lit("d").alias("dataset"), F.lit("t").alias("target"), F.lit("p").alias("pair"),
                                   (F.col("id") + 1).alias("xr"), (F.lit(n) - F.col("id")).alias("yr"))
    assert agreement.spearman(points).first()["value"] == pytest.approx(-1.0, abs=1e-12)


def test_downsample_and_split_without_funnel(spark):
    df = spark.range(1000).withColumn("y", (F.col("id") % 2).cast("int"))
    assert sample.exact_downsample(df, "id", 137).distinct().count() == 137
    assert sample.exact_downsample(df, "id", 5000).count() == 1000
    s = sample.stratified_split(df, "id", "y")
    assert {(r["y"], r["count"]) for r in s.where("split = 'test'").groupBy("y").count().collect()} == {(0, 150), (1, 150)}


@pytest.mark.parametrize("bits", [3, 12])
def test_kendall_over_many_blocks_equals_pairs(spark, monkeypatch, bits):
    monkeypatch.setattr(agreement, "BLOCK_BITS", bits)
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 40, 260).astype(float), rng.integers(0, 25, 260).astype(float)
    y[:90] = 7.0  # a heavily tied value
    rows = [("d", "t", "p", f"a{i}", float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))]
    points = spark.createDataFrame(rows, "dataset string, target string, pair string, attribute string, xv double, yv double")
    s = (np.sign(x[:, None] - x) * np.sign(y[:, None] - y)).sum() / 2
    n0 = 260 * 259 / 2
    n1, n2 = ((np.bincount(v.astype(int)) * (np.bincount(v.astype(int)) - 1)).sum() / 2 for v in (x, y))
    got = agreement.kendall_tau_b(points).first()["value"]
    assert got == pytest.approx(s / np.sqrt((n0 - n1) * (n0 - n2)), abs=1e-12)


def test_correlations_of_wide_frames(spark):
    from conftest import SF01

    emb = spark.read.parquet(f"{SF01}/embeddings.parquet")
    dim = len(emb.first()["embedding"])
    cols = [f"e.{i}" for i in range(dim)] + ["const", "copy"]
    wide = emb.select(*[F.col("embedding")[i].alias(f"e.{i}") for i in range(dim)], F.lit(0.1).alias("const"),
                      (F.col("embedding")[3] * -2 + 5).alias("copy"))
    got = {(r["i"], r["j"]): r["r"] for r in encode.correlation_table(wide, cols).collect()}
    x = np.array([r["embedding"] for r in emb.collect()], dtype=float)
    want = np.corrcoef(x.T)
    assert len(got) == (dim + 2) * (dim + 1) // 2
    assert all(abs(got[i, j] - want[i, j]) < 1e-9 for i in range(dim) for j in range(i + 1, dim))
    assert got[3, dim + 1] == pytest.approx(-1.0, abs=1e-6) and all(got[i, dim] is None for i in range(dim))
    assert encode.fit_correlated_drop(wide, cols, 0.9) == cols[:-1]
    bins = encode.fit_quantile_bins(wide, cols)
    assert len(bins.edges) == dim + 1 and "const" not in bins.edges
    assert np.allclose(bins.edges["e.5"], np.quantile(x[:, 5], (0, .25, .5, .75, 1)))
    gaps = spark.createDataFrame([(1.0, 2.0), (2.0, None), (3.0, 6.5), (None, 1.0), (4.0, 7.0)], "a double, b double")
    assert encode.correlation_table(gaps, ["a", "b"]).first()["r"] == pytest.approx(np.corrcoef([1, 3, 4], [2, 6.5, 7])[0, 1])
