"""Files by their ending, models without probabilities, the curve's axis, exports."""

import pytest
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from concordia.operators import hierarchy as hy
from concordia.operators import merge as mg
from concordia.operators.models import SparkMLScorer
from concordia.sources.arff import write_arff
from concordia.sources.files import load_file


def test_files_by_ending(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5, "a"), (2, None, "b")], "id int, v double, c string")
    df.write.option("header", True).csv(str(tmp_path / "t.csv"))
    df.write.parquet(str(tmp_path / "t.parquet"))
    df.write.json(str(tmp_path / "t.json"))
    write_arff(df, str(tmp_path / "t.arff"))
    for kind in ("csv", "parquet", "json", "arff"):
        rows = load_file(spark, str(tmp_path / f"t.{kind}")).selectExpr("cast(id AS int)", "cast(v AS double)", "cast(c AS string)").collect()
        assert sorted(map(tuple, rows)) == [(1, 2.5, "a"), (2, None, "b")]
    for name in ("t.xml", "t", "t.csv.bak"):
        with pytest.raises(ValueError, match="unsupported format"):
            load_file(spark, str(tmp_path / name))


def test_a_model_without_probabilities_gives_its_class(spark):
    rows = [([float(i), float(i % 3)], int(i > 20)) for i in range(40)]
    train = spark.createDataFrame(rows, "x array<double>, label int")
    model = LinearSVC(maxIter=20).fit(train.select(array_to_vector("x").alias("features"), "label"))
    scorer = SparkMLScorer(model)
    got = scorer.predict(train, "x").collect()
    assert {r["pred"] for r in got} == {0.0, 1.0}
    assert sum(r["pred"] == r["label"] for r in got) >= 36
    assert scorer.array_fn(spark) is None


def test_axis_of_a_curve(spark):
    curve = spark.createDataFrame([("a", 0, 0.03), ("a", 1, 0.4), ("b", 0, 0.5), ("b", 1, 0.2)], "g string, x_step int, y double")
    got = {r["g"]: (r["y_low"], r["y_high"]) for r in mg.curve_axis(curve, group=["g"]).collect()}
    assert got["a"] == (0.0, pytest.approx(0.46)) and got["b"] == (pytest.approx(0.14), pytest.approx(0.56))
    assert mg.curve_axis(curve.drop("g")).first()["y_low"] == 0.0


def test_unified_export_of_a_category_without_specialists(spark, tmp_path):
    cats = [hy.Category("one", ["p", "q"])]
    train = spark.createDataFrame([(1, [0.1], 1, 0), (2, [0.2], 0, 0)], "id long, x array<double>, p int, q int") \
        .withColumn("Gatekeeper_one_Score", F.lit(0.9))
    test = train.withColumn("id", F.col("id") + 10)
    predictions = hy.specialist_predictions(train, test, cats, None)  # one gated train row: no specialists
    got = hy.unified_export(train, test, cats, predictions, str(tmp_path / "out")).collect()
    assert sorted((r["id"], r["Set_Type"], r["pred_p"], r["pred_q"]) for r in got) == [
        (1, "Train", None, None), (2, "Train", None, None), (11, "Test", 0, 0), (12, "Test", 0, 0)]


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_sparse_one_hot(spark, limit):
    from concordia.operators import encode as en

    rows = [(1, "b", 3.0), (2, "a", None), (3, None, 1.0), (4, "c", 3.0), (5, None, None), (6, "zz", 9.0)]
    df = spark.createDataFrame(rows, "id long, `k.1` string, v double").withColumn("level", F.lit("x"))
    index = en.level_index(df.where("id < 6"), ["k.1", "v"])
    assert sorted(map(tuple, index.collect()), key=lambda r: r[2]) == [
        ("k.1", "a", 0), ("k.1", "b", 1), ("k.1", "c", 2), ("v", "1.0", 3), ("v", "3.0", 4)]
    got = en.one_hot_sparse(df, "id", ["k.1", "v"], index, broadcast_bytes=limit)
    assert got.columns == [*df.columns, "onehot"]
    assert {r["id"]: (r["onehot"]["size"], r["onehot"]["indices"]) for r in got.collect()} == {
        1: (5, [1, 4]), 2: (5, [0]), 3: (5, [3]), 4: (5, [2, 4]), 5: (5, []), 6: (5, [])}


def test_a_failed_rerun_leaves_the_old_table(spark, tmp_path):
    from concordia.sources import sinks

    path = str(tmp_path / "metrics")
    with pytest.raises(ValueError, match="no version"):
        sinks.read_table(spark, path)
    first = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.6), (None, 1, 0.7), ("b", 1, 0.8)], "k string, t int, v double")
    sinks.overwrite_keys(first, path, ["k"])
    sinks.overwrite_keys(spark.createDataFrame([("a", 9, 0.1), (None, 2, 0.2), ("c", 1, 0.3)], "k string, t int, v double"), path, ["k"])
    want = [("a", 9, 0.1), ("b", 1, 0.8), ("c", 1, 0.3), (None, 2, 0.2)]
    held = sinks.read_table(spark, path)
    assert sorted(map(tuple, held.collect()), key=str) == sorted(want, key=str)
    broken = spark.createDataFrame([("b", 1, 1.0)], "k string, t int, v double") \
        .withColumn("v", F.when(F.col("t") == 1, F.raise_error(F.lit("lost")).cast("double")))
    with pytest.raises(Exception, match="lost"):
        sinks.overwrite_keys(broken, path, ["k"])
    assert sinks.current_version(spark, path)[0] == 2
    assert sorted(map(tuple, sinks.read_table(spark, path).collect()), key=str) == sorted(want, key=str)
    # a reader that began before the next commit keeps its version
    sinks.commit_table(first, path)
    assert sorted(map(tuple, held.collect()), key=str) == sorted(want, key=str)
    assert sinks.read_table(spark, path).count() == 4 and sinks.current_version(spark, path)[0] == 3


def test_line_stats_shuffle_once(spark, tmp_path):
    """Suppliers are counted in the one shuffle of the lines; repeated ones once, nulls not."""
    from concordia.plans import frames
    from concordia.sources.tables import Tables

    rows = [(1, 7, 2.0, 1.5, 0.1, 0.02, "R"), (1, 7, 3.0, 2.5, 0.3, 0.04, "N"), (1, None, 1.0, 1.0, 0.0, 0.0, "N"),
            (1, 8, 1.0, 1.0, 0.0, 0.0, "N"), (2, None, 4.0, 1.0, 0.0, 0.0, "A")]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, "
                          "l_tax double, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = frames.line_stats(Tables(spark, str(tmp_path)))
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert dict(got.dtypes)["n_supp"] == "bigint"
    assert sorted(map(tuple, got.select("l_orderkey", "n_lines", "n_supp", "price_sum", "has_R", "has_A").collect())) == \
        [(1, 4, 2, 6.0, 1, 0), (2, 1, 0, 1.0, 0, 1)]


def test_large_order_frames_are_written_in_slices(spark, tmp_path, monkeypatch):
    """Slice by slice the rows of the whole, null and repeated keys and orders without lines too; a slice reads its own only."""
    from pyspark.sql import functions as F

    from concordia.plans import frames
    from concordia.sources.tables import Tables

    line = [(k, s, float(s or 0), 1.25 * (s or 3), 0.1, 0.02, "RAN"[(s or 0) % 3]) for k in [*range(40), None] for s in (k, 7, 7, None)]
    order = [(k, (k or 0) % 5, "F" if (k or 0) % 2 else "O", 10.0 + (k or 0), "1-URGENT") for k in [*range(50), 3, None]]
    spark.createDataFrame(line, "l_orderkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, "
                          "l_tax double, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame(order, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string") \
        .write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(0, "A"), (1, "B"), (1, "C"), (2, None)], "c_custkey long, c_mktsegment string") \
        .write.parquet(str(tmp_path / "customer.parquet"))
    t = Tables(spark, str(tmp_path))
    whole = frames.order_risk_split(t)
    want = sorted(map(str, whole.collect()))
    parts = [frames.line_stats(t, k).count() for k in range(frames.SLICES)]
    assert sum(parts) == 41 and max(parts) < 41
    for least in (1, 10_000):
        monkeypatch.setattr(frames, "SLICED_LINES", least)
        got = frames.order_risk_written(t, *whole.columns)
        assert got.dtypes == whole.dtypes and sorted(map(str, got.collect())) == want
        assert "FileScan parquet" in got._jdf.queryExecution().executedPlan().toString()


def test_curve_reads_the_merged_rows_once(spark):
    """Steps and start come from one pass: means over the rows, nulls left out, none without values."""
    from pyspark.sql import functions as F

    rows = [("a", 0.1, 0.2, 0.5, 0.4), ("a", 0.3, 0.2, 0.7, None), ("b", 0.5, 0.1, 0.6, 0.9), ("b", 0.7, 0.3, 0.8, 0.2)]
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    schema = "feature string, ablation_value double, cum_ablation_value double, current_prediction double, original_prediction double"
    got = mg.ablation_curve(spark.createDataFrame(rows, schema).mapInArrow(look, schema)).collect()
    assert seen.value == len(rows)
    start = next(r for r in got if r["x_step"] == 0)
    assert start["feature"] == "Original" and start["y"] == pytest.approx(0.5)
    assert [r["feature"] for r in sorted(got, key=lambda r: r["x_step"])] == ["Original", "a", "b"]
    empty = spark.createDataFrame(rows, schema).withColumn("original_prediction", F.lit(None).cast("double"))
    assert next(r["y"] for r in mg.ablation_curve(empty).collect() if r["x_step"] == 0) is None


def _counted(spark, rows, schema):
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return spark.createDataFrame(rows, schema).mapInArrow(look, schema), seen


def test_gate_scores_are_worked_out_once(spark):
    """Later gates and whoever reads the scored rows do not score, or read the train rows, again."""
    from concordia.operators.models import LinearLogit

    rows = [(i, [float(i)], i % 2, i % 3 == 0) for i in range(12)]
    train, seen = _counted(spark, [(i, x, a, int(b)) for i, x, a, b in rows], "id long, x array<double>, a int, b int")

    def fit(labelled, label):
        for _ in range(3):
            assert labelled.agg(F.sum(label)).first()[0] > 0
        return LinearLogit(0.1, (0.5, 1.0)[:len(labelled.first()["x"])])

    gates, scored = hy.fit_gates(train, [hy.Category("one", ["a"]), hy.Category("two", ["b"])], fit)
    after_first = seen.value
    got = [r for _ in range(2) for r in scored.collect()]
    assert seen.value == after_first and len(got) == 2 * len(rows)
    tr, _ = hy.append_gate_scores(train, train, [hy.Category("one", ["a"]), hy.Category("two", ["b"])], gates)
    assert sorted(map(tuple, got[:12])) == sorted(map(tuple, tr.select(scored.columns).collect()))


def test_class_weights_are_counted_once(spark):
    from concordia.operators import models as md

    train, seen = _counted(spark, [(i, int(i < 3)) for i in range(12)], "id long, y int")
    weighted = md.balance_weights(train, "y")
    assert seen.value == 12
    for _ in range(2):
        assert {(r["y"], r["weight"]) for r in weighted.collect()} == {(1, 3.0), (0, 1.0)}
    assert seen.value == 36
