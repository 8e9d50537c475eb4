"""Exact nearest neighbours against all pairs; oversampling of several classes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from concordia.operators import balance as bl
from concordia.operators import neighbours as nb

SCHEMA = "id long, x array<double>"


def brute(ids, x, k):
    out = set()
    for i, q in zip(ids, x):
        d = np.zeros(len(x))
        for j in range(x.shape[1]):
            d += (q[j] - x[:, j]) ** 2
        order = [m for m in np.lexsort((ids, d)) if ids[m] != i][:k]
        out |= {(int(i), r + 1, int(ids[m]), float(d[m])) for r, m in enumerate(order)}
    return out


def run(spark, ids, x, k, **params):
    rows = spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x)], SCHEMA).repartition(5)
    return {(r["id"], r["rank"], r["neighbour"], r["d"]) for r in nb.nearest(rows, x.shape[1], k, **params).collect()}


def test_five_thousand_rows_of_seven_columns(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(size=(5000, 7))
    x[:2000] = rng.normal(scale=0.02, size=(2000, 7))  # a crowded corner
    ids = rng.permutation(5000) * 3
    assert run(spark, ids, x, 5) == brute(ids, x, 5)


@pytest.mark.parametrize("pivots,block", [(1, 7), (9, 16), (200, 4096)])
def test_copies_ties_and_small_blocks(spark, pivots, block):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 4, size=(300, 3)).astype(float)  # many equal vectors and equal distances
    x[:100] = 1.0
    ids = rng.permutation(300)
    assert run(spark, ids, x, 4, pivots=pivots, block=block) == brute(ids, x, 4)


def test_fewer_rows_than_neighbours_and_none(spark):
    x = np.array([[0.0, 1.0], [0.0, 3.0], [5.0, 1.0]])
    assert run(spark, [4, 2, 9], x, 5) == brute([4, 2, 9], x, 5)
    assert run(spark, [4], x[:1], 5) == set()
    empty = spark.createDataFrame([], SCHEMA)
    assert nb.nearest(empty, 2, 5).collect() == []
    odd = spark.createDataFrame([(1, None), (2, [None, 1.0]), (3, [1.0, 1.0]), (4, [1.0, 2.0])], SCHEMA)
    assert sorted((r["id"], r["neighbour"]) for r in nb.nearest(odd, 2, 5).collect()) == [(3, 4), (4, 3)]


def classes(spark, sizes):
    rng = np.random.default_rng(6)
    rows, i = [], 0
    for label, n in sizes.items():
        for _ in range(n):
            rows.append((i, [float(v) for v in rng.normal(size=2) + 10 * len(str(label))], label))
            i += 1
    return rows


def test_every_smaller_class_grows_to_the_largest(spark):
    rows = classes(spark, {0: 40, 1: 7, 2: 25, 3: 1, 5: 40})
    train = spark.createDataFrame(rows, "id long, x array<double>, label int")
    made = bl.smote(train, 2).collect()
    count = {c: sum(r["label"] == c for r in made) for c in range(6)}
    assert count == {0: 0, 1: 33, 2: 15, 3: 0, 4: 0, 5: 0}
    assert sorted(r["id"] for r in made) == list(range(len(rows), len(rows) + 48))
    x = {i: np.array(v) for i, v, _ in rows}
    label = {i: c for i, _, c in rows}
    near = brute([i for i in x if label[i] == 1], np.array([x[i] for i in x if label[i] == 1]), 5) | \
        brute([i for i in x if label[i] == 2], np.array([x[i] for i in x if label[i] == 2]), 5)
    pairs = {(a, b) for a, _, b, _ in near}
    for r in made:
        assert label[r["base"]] == label[r["neighbour"]] == r["label"] and (r["base"], r["neighbour"]) in pairs
        step = (np.array(r["x"]) - x[r["base"]]) / (x[r["neighbour"]] - x[r["base"]])
        assert step == pytest.approx(step[0]) and 0 <= step[0] <= 1


def test_text_labels_and_missing_labels(spark):
    rows = classes(spark, {"a": 6, "b": 3, None: 9})
    made = bl.smote(spark.createDataFrame(rows, "id long, x array<double>, label string"), 2).collect()
    assert [r["label"] for r in made] == ["b"] * 3


def test_balanced_export_skips_several_targets(spark):
    rows = [(i, [float(i)], i % 3 == 0, i % 2) for i in range(12)]
    train = spark.createDataFrame(rows, "id long, x array<double>, a boolean, b int")
    assert bl.balanced_export(train, train, 1, ["a", "b"]) is None
    one = bl.balanced_export(train, train.limit(0), 1, ["a"])
    assert one.where("Set_Type = 'Train'").groupBy("a").count().select(F.countDistinct("count")).first()[0] == 1


def test_too_many_labels(spark):
    train = spark.range(1200).select("id", F.array(F.col("id").cast("double")).alias("x"), F.col("id").alias("label"))
    with pytest.raises(ValueError, match="more than 1000"):
        bl.smote(train, 1)
