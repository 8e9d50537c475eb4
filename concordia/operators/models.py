"""Scorers: the model interface the explainers call, plus Spark ML training.

A scorer turns a DataFrame holding a feature array column into the same
DataFrame with a ``pred`` column (positive-class probability). Two kinds:

* :class:`LinearLogit` - a closed-form logistic model evaluated as a column
  expression (whole-stage codegen, no model object);
* :class:`SparkMLScorer` - any fitted ``pyspark.ml`` classifier / pipeline;
  the array becomes a vector with ``array_to_vector`` and ``model.transform``
  scores it, all on the JVM.

``array_fn`` gives the same model as a function of a NumPy matrix, for
explainers that build perturbed rows inside a task (None: no such form). The
functions are closures over plain arrays, so workers need no package.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize


@dataclass(frozen=True)
class LinearLogit:
    intercept: float
    weights: tuple

    def margin(self, arr: Column) -> Column:
        z = F.lit(float(self.intercept))
        for k, w in enumerate(self.weights):
            z = z + F.lit(float(w)) * F.element_at(arr, k + 1)
        return z

    def prob(self, arr: Column) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-self.margin(arr)))

    def predict(self, df: DataFrame, arr_col: str, out: str = "pred") -> DataFrame:
        return df.withColumn(out, self.prob(F.col(arr_col)))

    def array_fn(self, spark=None):
        import numpy as np

        weights, intercept = np.array(self.weights, float), float(self.intercept)

        def score(x):
            return 1.0 / (1.0 + np.exp(-(x @ weights + intercept)))

        return score


class SparkMLScorer:
    """Wrap a fitted Spark ML model that reads a ``features`` vector."""

    def __init__(self, model, features_col: str = "features", positive_index: int = 1):
        self.model = model
        self.features_col = features_col
        self.positive_index = positive_index

    def predict(self, df: DataFrame, arr_col: str, out: str = "pred") -> DataFrame:
        keep = df.columns
        v = df.withColumn(self.features_col, array_to_vector(F.col(arr_col)))
        scored = self.model.transform(v)
        if "probability" in scored.columns:
            p = vector_to_array("probability")[self.positive_index]
        else:  # fallback: class prediction
            p = F.col("prediction").cast("double")
        return scored.select(*[F.col(c) for c in keep], p.alias(out))

    def array_fn(self, spark=None):
        """Boosted trees and forests from their node tables; None for other models."""
        from .treeshap import nodes_from_spark_model

        name = type(self.model).__name__
        if spark is None or name not in ("GBTClassificationModel", "RandomForestClassificationModel"):
            return None
        kind = "gbt" if name.startswith("GBT") else "rf"
        trees, weights = nodes_from_spark_model(spark, self.model, kind)
        return forest_fn(trees, weights, logistic=kind == "gbt")


def forest_fn(trees: Sequence, weights: Sequence[float], logistic: bool):
    """Weighted sum of trees as a function of a matrix; ``logistic``: as 1 / (1 + exp(-2 sum))."""
    import numpy as np

    tables = []
    for (nodes, root), weight in zip(trees, weights):
        at = {i: k for k, i in enumerate([root] + [i for i in nodes if i != root])}
        cols = [[], [], [], [], []]
        for i, k in at.items():
            n = nodes[i]
            leaf = n.left < 0
            for c, v in zip(cols, (0 if leaf else n.feature, n.threshold, k if leaf else at[n.left],
                                   k if leaf else at[n.right], weight * n.value)):
                c.append(v)
        depth, level = 0, [root]
        while level := [c for i in level if nodes[i].left >= 0 for c in (nodes[i].left, nodes[i].right)]:
            depth += 1
        tables.append((depth, *(np.array(c, t) for c, t in zip(cols, (int, float, int, int, float)))))

    def score(x):
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for depth, feature, threshold, left, right, value in tables:
            at = np.zeros(len(x), int)
            for _ in range(depth):
                at = np.where(x[rows, feature[at]] <= threshold[at], left[at], right[at])
            total += value[at]
        return 1.0 / (1.0 + np.exp(-2.0 * total)) if logistic else total

    return score


class TreeScorer:
    """One decision tree (a node table) as a column expression over the feature array."""

    def __init__(self, nodes: dict, root: int = 0):
        self.nodes, self.root = nodes, root

    def cuts(self, p: int) -> list[list[float]]:
        """Each feature's thresholds, ascending."""
        return [sorted({n.threshold for n in self.nodes.values() if n.left >= 0 and n.feature == j}) for j in range(p)]

    def predict(self, df: DataFrame, arr_col: str, out: str = "pred") -> DataFrame:
        def at(i):
            n = self.nodes[i]
            if n.left < 0:
                return F.lit(float(n.value))
            return F.when(F.element_at(arr_col, n.feature + 1) <= F.lit(float(n.threshold)), at(n.left)).otherwise(at(n.right))

        return df.withColumn(out, at(self.root))

    def array_fn(self, spark=None):
        return forest_fn([(self.nodes, self.root)], [1.0], logistic=False)


def features_array(cols: Sequence[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in cols])


# ------------------------------------------------------------------ F1 .. F3
def balance_weights(df: DataFrame, label: str, mode: str = "ratio", out: str = "weight") -> DataFrame:
    """F1 ratio weight for positives (boosted trees) or class-balanced
    n / (k * n_c) weights (forests), from one grouped count."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("__nc"))
    if mode == "ratio":
        n0 = F.sum(F.when(F.col(label) == 0, F.col("__nc")).otherwise(0)).over(_all())
        n1 = F.sum(F.when(F.col(label) == 1, F.col("__nc")).otherwise(0)).over(_all())
        w = counts.select(label, F.when(F.col(label) == 1,
                                        F.when(n1 > 0, n0 / n1).otherwise(1.0)).otherwise(1.0).alias(out))
    else:
        n = F.sum("__nc").over(_all())
        k = F.count(F.lit(1)).over(_all())
        w = counts.select(label, (n / (k * F.col("__nc"))).alias(out))
    # one row a class, counted once and not in every pass of training; without the broadcast the train rows would be
    # dealt by their few label values
    return df.join(F.broadcast(materialize(w)), label)


def _all():
    from pyspark.sql import Window
    return Window.partitionBy()


def train_classifier(train: DataFrame, feature_cols: Sequence[str], label: str, kind: str = "gbt",
                     seed: int = 42, weight_col: str | None = None, **params):
    """assemble + fit a GBT or random forest in one Pipeline."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    asm = VectorAssembler(inputCols=list(feature_cols), outputCol="features", handleInvalid="keep")
    if kind == "gbt":
        clf = GBTClassifier(labelCol=label, featuresCol="features", seed=seed,
                            maxIter=params.get("maxIter", 20), maxDepth=params.get("maxDepth", 4))
    else:
        clf = RandomForestClassifier(labelCol=label, featuresCol="features", seed=seed,
                                     numTrees=params.get("numTrees", 20), maxDepth=params.get("maxDepth", 5))
    if weight_col:
        clf = clf.setWeightCol(weight_col)
    return Pipeline(stages=[asm, clf]).fit(train)
