"""Explainer invariants: tree-SHAP additivity and brute force, ablation edge cases."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from concordia.operators import explain as ex
from concordia.operators import treeshap as ts
from concordia.operators.models import LinearLogit
from concordia.plans import catalog_explain as ce
from concordia.plans import catalog_lime as cl

from conftest import SF001


@pytest.fixture(scope="module")
def frames(spark):
    return ce.split_frames(spark, SF001)


@pytest.mark.parametrize("kind", ["gbt", "rf"])
def test_tree_shap_additivity(spark, frames, kind):
    train, test = frames
    tr = train.select(array_to_vector("x").alias("features"), F.col("label").cast("double").alias("label"))
    clf = GBTClassifier(maxIter=5, maxDepth=3, seed=1) if kind == "gbt" else \
        RandomForestClassifier(numTrees=5, maxDepth=3, seed=1)
    model = clf.fit(tr)
    ens = ts.compile_spark_model(spark, model, ce.P)
    sh = ts.tree_shap(ens, test, ce.FEATURES)
    tot = sh.groupBy("id").agg((F.first("base_value") + F.sum("shap_value")).alias("tot"))
    sc = model.transform(test.select("id", array_to_vector("x").alias("features")))
    ref = sc.select("id", (2 * vector_to_array("rawPrediction")[1]).alias("ref")) if kind == "gbt" else \
        sc.select("id", vector_to_array("probability")[1].alias("ref"))
    diff = tot.join(ref, "id").agg(F.max(F.abs(F.col("tot") - F.col("ref")))).first()[0]
    assert diff < 1e-9


def _brute_path_dependent(nodes, x, p):
    """Shapley values of v(S) = path-dependent expectation, by subset enumeration."""
    def v(S, nid=0):
        n = nodes[nid]
        if n.left < 0:
            return n.value
        if n.feature in S:
            return v(S, n.left if x[n.feature] <= n.threshold else n.right)
        cl, cr = nodes[n.left].cover, nodes[n.right].cover
        return (cl * v(S, n.left) + cr * v(S, n.right)) / n.cover
    phi = np.zeros(p)
    for i in range(p):
        others = [k for k in range(p) if k != i]
        for r in range(p):
            for S in itertools.combinations(others, r):
                w = math.factorial(len(S)) * math.factorial(p - len(S) - 1) / math.factorial(p)
                phi[i] += w * (v(set(S) | {i}) - v(set(S)))
    return phi, v(set())


def test_tree_shap_equals_brute_force_with_repeated_feature(spark):
    N = ts.Node
    nodes = {0: N(0, 0, 100, 1, 2, 0, 5.0), 1: N(1, 0, 60, 3, 4, 1, 2.0), 2: N(2, 0, 40, 5, 6, 0, 8.0),
             3: N(3, 1.0, 25, -1, -1, -1, 0), 4: N(4, -2.0, 35, -1, -1, -1, 0),
             5: N(5, 3.0, 10, -1, -1, -1, 0), 6: N(6, 0.5, 30, -1, -1, -1, 0)}
    ens = ts.compile_ensemble([nodes], [1.0], 3)
    xs = [[4.0, 1.0, 0.0], [6.0, 3.0, 1.0], [9.0, 0.0, 2.0], [5.0, 2.0, 3.0]]
    test = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "id long, x array<double>")
    got = {(r["id"], r["feature"]): r["shap_value"] for r in ts.tree_shap(ens, test, ["a", "b", "c"]).collect()}
    for i, x in enumerate(xs):
        phi, base = _brute_path_dependent(nodes, x, 3)
        assert ens.base_value == pytest.approx(base)
        for k, name in enumerate(["a", "b", "c"]):
            assert got[(i, name)] == pytest.approx(phi[k], abs=1e-12)
    # feature c is on no path: exactly zero
    assert all(got[(i, "c")] == 0.0 for i in range(len(xs)))


def test_ablation_of_unused_feature_is_zero(spark, frames):
    train, test = frames
    model = LinearLogit(0.1, (0.2, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0))
    a = ex.marginal_ablation(model, train, test, ce.FEATURES, n_draws=5)
    unused = a.where(F.col("feature") != ce.FEATURES[0]).agg(F.max("ablation_value")).first()[0]
    assert unused == pytest.approx(0.0, abs=1e-12)


def test_cumulative_final_step_near_train_mean(spark, frames):
    train, test = frames
    model = ce.model_for("y")
    bgn = ex.number_background(train)
    a = ex.marginal_ablation(model, train, test, ce.FEATURES, n_draws=10, background=bgn)
    c = ex.cumulative_ablation(model, train, test, ce.FEATURES, a, n_draws=10, background=bgn)
    last = c.where(F.col("step") == ce.P).agg(F.avg("current_prediction"), F.first("base_value")).first()
    assert abs(last[0] - last[1]) < 0.05


def test_tree_shap_of_a_hundred_trees_needs_no_shuffle(spark):
    rng = np.random.default_rng(0)
    p, trees = 6, []
    for _ in range(100):  # complete trees of depth 6
        nodes = {}
        for i in range(127):
            inner = i < 63
            nodes[i] = ts.Node(i, float(rng.normal()), float(2 ** (6 - int(np.log2(i + 1)))), 2 * i + 1 if inner else -1,
                               2 * i + 2 if inner else -1, int(rng.integers(p)) if inner else -1, float(rng.normal()))
        trees.append(nodes)
    ens = ts.compile_ensemble(trees, [0.01] * 100, p)
    rows = [(i, [float(v) for v in rng.normal(size=p)]) for i in range(40)]
    df = ts.tree_shap(ens, spark.createDataFrame(rows, "id long, x array<double>"), [f"f{k}" for k in range(p)])
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in df.collect():
        got[r["id"]] = got.get(r["id"], ens.base_value) + r["shap_value"]

    def output(x):
        total = 0.0
        for nodes in trees:
            i = 0
            while nodes[i].left >= 0:
                i = nodes[i].left if x[nodes[i].feature] <= nodes[i].threshold else nodes[i].right
            total += 0.01 * nodes[i].value
        return total

    assert all(abs(got[i] - output(x)) < 1e-9 for i, x in rows)


def test_merged_surrogate_equals_the_registered_weights(spark):
    """The merge explains a row as ``a3_lime_weights`` does: same perturbations, same values."""
    merged = {(r.id, r.feature): r.lime_value for r in cl.q_j1_merge_attributions(spark, SF001).collect()}
    weights = {(r.id, r.feature): r.lime_value for r in cl.q_a3_lime_weights(spark, SF001).collect()}
    assert merged and merged == weights


def test_median_split_tree_without_a_column_in_one_buffer(spark, frames, monkeypatch):
    train, _ = frames
    x = np.array([r.x for r in train.select("x").collect()])
    t0 = np.median(x[:, 0])
    want = [t0, np.median(x[x[:, 0] <= t0, 2]), np.median(x[x[:, 0] > t0, 0])]

    def refuse(*_):
        raise AssertionError("percentile keeps every distinct value in one task")

    monkeypatch.setattr(ts.F, "percentile", refuse)
    nodes = ts.median_split_tree(train)
    assert np.allclose([nodes[i].threshold for i in range(3)], want, rtol=1e-12)
