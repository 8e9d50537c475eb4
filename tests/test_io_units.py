"""Sources, sinks and the local surrogate on hand-made inputs."""

import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from concordia.operators import lime as lm
from concordia.operators.models import LinearLogit
from concordia.sources import arff, sinks


def test_arff_header_and_missing(spark):
    d = tempfile.mkdtemp(prefix="arff-test-")
    path = os.path.join(d, "t.arff")
    with open(path, "w") as fh:
        fh.write("% comment\n@relation t\n@attribute 'a b' numeric\n@attribute c {x,y}\n"
                 "@attribute n REAL\n\n@data\n1.5,x,2\n?,y,3\n")
    df = arff.read_arff(spark, path)
    assert df.columns == ["a b", "c", "n"]
    rows = [tuple(r) for r in df.collect()]
    assert rows == [(1.5, "x", 2.0), (None, "y", 3.0)]


def test_arff_round_trips_quotes_and_marks(spark):
    rows = [(1.0, "it's"), (2.0, "a'b,c"), (3.0, "100%"), (4.0, "me@x"), (5.0, "back\\slash"), (None, None), (6.0, "'q'")]
    path = os.path.join(tempfile.mkdtemp(prefix="arff-test-"), "t")
    arff.write_arff(spark.createDataFrame(rows, "n double, s string"), path)
    got = [tuple(r) for r in arff.read_arff(spark, path).collect()]
    assert sorted(got, key=str) == sorted(rows, key=str)


def test_metrics_sink_appends_and_reads_the_newest_run(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="metrics-test-"), "t")
    cols = "dataset string, target string, classifier string, run int, acc double"
    sinks.write_metrics(spark.createDataFrame([("d", "t", "c", 1, 0.5), ("d", "u", "c", 1, 0.1)], cols), path)
    sinks.write_metrics(spark.createDataFrame([("d", "t", "c", 2, 0.4)], cols), path)
    got = {(r["target"], r["run"], r["acc"]) for r in sinks.read_metrics(spark, path).collect()}
    assert got == {("t", 2, 0.4), ("u", 1, 0.1)}


def test_dynamic_overwrite_leaves_the_session_alone(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="attr-test-"), "t")
    key = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(key)
    rows = lambda d, v: spark.createDataFrame([(d, "t", v)], "dataset string, target_context string, v int")
    sinks.write_attributions(rows("a", 1).unionByName(rows("b", 1)), path)
    sinks.write_attributions(rows("a", 2), path)
    assert {(r["dataset"], r["v"]) for r in sinks.read_attributions(spark, path).collect()} == {("a", 2), ("b", 1)}
    assert spark.conf.get(key) == before


def test_latest_per_key_keeps_newest_run(spark):
    df = spark.createDataFrame([("d", "t", 1, 0.5), ("d", "t", 2, 0.7), ("d", "u", 1, 0.1)],
                               "dataset string, target string, run int, acc double")
    got = {(r["target"], r["run"], r["acc"]) for r in sinks.latest_per_key(df, ["dataset", "target"], "run").collect()}
    assert got == {("t", 2, 0.7), ("u", 1, 0.1)}


def test_lime_recovers_sign_and_order_of_a_linear_model(spark):
    rng = np.random.RandomState(0)
    train = spark.createDataFrame([(i, [float(v) for v in rng.normal(size=3)]) for i in range(400)],
                                  "id long, x array<double>")
    test = spark.createDataFrame([(1000 + i, [float(v) for v in rng.normal(size=3)]) for i in range(20)],
                                 "id long, x array<double>")
    model = LinearLogit(0.0, (3.0, -1.0, 0.0))
    w = lm.lime_weights(model, train, test, ["a", "b", "c"], num_samples=2000)
    mean = {r["feature"]: r["m"] for r in w.groupBy("feature").agg(F.avg(F.abs("lime_value")).alias("m")).collect()}
    assert mean["a"] > mean["b"] > mean["c"]
    assert mean["c"] < mean["b"] / 3   # unused feature: only sampling noise
    assert w.count() == 60


def test_validate_numeric_lists_offending_columns(spark):
    from concordia.operators.clean import validate_numeric
    df = spark.createDataFrame([(1.0, "a", 2)], "x double, s string, k int")
    with pytest.raises(ValueError, match=r"\['s'\]"):
        validate_numeric(df, "frame")
    validate_numeric(df.drop("s"), "frame")


def test_specialists_skipped_below_guard(spark):
    from concordia.operators import hierarchy as hy
    rows = [(i, [float(i)], 1 if i < 3 else 0) for i in range(10)]
    train = spark.createDataFrame(rows, "id long, x array<double>, lab int")
    test = spark.createDataFrame([(100, [1.0])], "id long, x array<double>")
    cats = [hy.Category("c", ["lab"])]
    gate = {"c": LinearLogit(5.0, (0.0,))}
    tr, te = hy.append_gate_scores(train, test, cats, gate)
    out = hy.specialist_predictions(tr, te, cats, lambda c, lab, pos: LinearLogit(0.0, (1.0,)))
    # only 3 positive train rows: no specialist is fitted, the test row stays
    assert [tuple(r) for r in out.collect()] == [(100, "c", "lab", 1, None, 0)]
