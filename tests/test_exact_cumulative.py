"""Exact cumulative ablation of tree ensembles against averages over the whole background."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector

from concordia.operators import explain as ex
from concordia.operators import treeshap as ts
from concordia.operators.models import forest_fn

P, NAMES = 4, list("abcd")


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(260, P)), 1)  # ties at thresholds
    y = (x[:, 0] * x[:, 1] + x[:, 2] > 0).astype(int)
    df = spark.createDataFrame([(i, r.tolist(), int(t)) for i, (r, t) in enumerate(zip(x, y))],
                               "id long, x array<double>, label int").repartition(4).checkpoint()
    return x, df.where("id < 200"), df.where("id >= 200")


@pytest.mark.parametrize("kind,cells", [("rf", 1 << 20), ("gbt", 50)])
def test_equals_the_mean_over_all_background_rows(spark, data, kind, cells):
    x, train, test = data
    vectors = train.withColumn("features", array_to_vector("x"))
    model = (RandomForestClassifier(numTrees=5, maxDepth=4, seed=2) if kind == "rf" else
             GBTClassifier(maxIter=3, maxDepth=3, seed=2)).fit(vectors)
    trees, weights = ts.nodes_from_spark_model(spark, model, kind)
    scale = 2.0 if kind == "gbt" else 1.0
    score = forest_fn(trees, [scale * w for w in weights], logistic=False)
    ablation = spark.createDataFrame([(0, n, v) for n, v in zip(NAMES, (0.3, 0.1, 0.3, 0.2))],
                                     "id long, feature string, ablation_value double")
    order = [1, 3, 0, 2]  # least to most, ties by name
    got = {(r["id"], r["step"]): r for r in ex.cumulative_ablation_exact(
        ts.compile_ensemble(trees, weights, P, scale), train, test, NAMES, ablation, cells=cells).collect()}
    assert len(got) == 60 * P
    for i in range(200, 260):
        previous = score(x[i:i + 1])[0]
        for s in range(1, P + 1):
            rows = np.repeat(x[i:i + 1], 200, axis=0)
            rows[:, order[:s]] = x[:200, order[:s]]
            want = score(rows).mean()
            r = got[i, s]
            assert (r["feature"], r["feature_value"]) == (NAMES[order[s - 1]], x[i, order[s - 1]])
            assert r["current_prediction"] == pytest.approx(want, abs=1e-9)
            assert r["cum_ablation_value"] == pytest.approx(abs(previous - want), abs=1e-9)
            assert r["original_prediction"] == pytest.approx(score(x[i:i + 1])[0], abs=1e-9)
            assert r["base_value"] == pytest.approx(score(x[:200]).mean(), abs=1e-9)
            previous = want


def test_no_rows(spark, data):
    _, train, test = data
    nodes = ts.median_split_tree(train)
    ablation = spark.createDataFrame([(0, n, 0.0) for n in NAMES], "id long, feature string, ablation_value double")
    ens = ts.compile_ensemble([nodes], [1.0], P)
    assert ex.cumulative_ablation_exact(ens, train, test.where("id < 0"), NAMES, ablation).collect() == []
