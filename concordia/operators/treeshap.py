"""Path-dependent tree Shapley values (A1, A2) evaluated as a Spark job.

A fitted tree ensemble is compiled into a list of *leaves*. For every leaf
the root->leaf path is merged per feature into an interval (lo, hi] and a
cover ratio z (product of child/parent cover along the path). Given the
d path features of a leaf, the leaf's Shapley contribution to a row depends
on the row only through the pattern o in {0,1}^d (o_k = lo_k < x_k <= hi_k):

    phi_k = v * (o_k - z_k) * sum_{S in F minus k} |S|!(d-|S|-1)!/d! * prod_S o * prod_rest z

so each leaf carries a 2^d x d table of contributions, computed once from
the model (bounded by model size, not by data). A row's values depend on that
row and the tables only, so they are computed where the row is, for batches of
rows at once (``mapInArrow``): no shuffle, and the tables travel as one
broadcast value instead of plan literals.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles
from ..session import scratch_path


@dataclass
class Node:
    id: int
    value: float
    cover: float
    left: int
    right: int
    feature: int
    threshold: float


@dataclass
class Leaf:
    features: list
    lo: list
    hi: list
    z: list
    value: float


def _shapley_weights(d: int) -> np.ndarray:
    return np.array([math.factorial(s) * math.factorial(d - s - 1) / math.factorial(d) for s in range(d)])


def leaf_contributions(leaf: Leaf) -> np.ndarray:
    """(2^d, d) table: contribution of each path feature for every pattern."""
    d = len(leaf.features)
    out = np.zeros((1 << d, d))
    if d == 0:
        return out
    w = _shapley_weights(d)
    z = np.array(leaf.z, dtype=float)
    for pat in range(1 << d):
        o = np.array([(pat >> k) & 1 for k in range(d)], dtype=float)
        for k in range(d):
            poly = np.array([1.0])  # coefficients in t of prod_{i != k} (z_i + o_i t)
            for i in range(d):
                if i != k:
                    poly = np.convolve(poly, np.array([z[i], o[i]]))
            out[pat, k] = leaf.value * (o[k] - z[k]) * float(np.dot(w[: len(poly)], poly))
    return out


def leaves_of_tree(nodes: dict[int, Node], root: int = 0) -> tuple[list[Leaf], float]:
    """Root->leaf paths merged per feature; also the tree's expected value."""
    leaves: list[Leaf] = []
    expected = 0.0
    root_cover = nodes[root].cover
    stack = [(root, {}, 1.0)]
    while stack:
        nid, path, _ = stack.pop()
        n = nodes[nid]
        if n.left < 0:
            feats = sorted(path)
            leaves.append(Leaf(feats, [path[f][0] for f in feats], [path[f][1] for f in feats],
                               [path[f][2] for f in feats], n.value))
            expected += n.value * n.cover / root_cover
            continue
        for child, is_left in ((n.left, True), (n.right, False)):
            c = nodes[child]
            lo, hi, z = path.get(n.feature, (-math.inf, math.inf, 1.0))
            if is_left:
                hi = min(hi, n.threshold)
            else:
                lo = max(lo, n.threshold)
            ratio = c.cover / n.cover if n.cover > 0 else 0.0
            p2 = dict(path)
            p2[n.feature] = (lo, hi, z * ratio)
            stack.append((child, p2, 0.0))
    return leaves, expected


@dataclass
class CompiledEnsemble:
    leaves: list           # (Leaf, contributions, weight)
    base_value: float
    n_features: int


def compile_ensemble(trees: Sequence[dict[int, Node]], weights: Sequence[float], n_features: int,
                     scale: float = 1.0) -> CompiledEnsemble:
    out, base = [], 0.0
    for tree, w in zip(trees, weights):
        nodes, root = tree if isinstance(tree, tuple) else (tree, 0)
        lv, ev = leaves_of_tree(nodes, root)
        base += scale * w * ev
        for leaf in lv:
            out.append((leaf, scale * w * leaf_contributions(leaf), scale * w))
    return CompiledEnsemble(out, base, n_features)


# ------------------------------------------------------------ Spark ML models
def nodes_from_spark_model(spark: SparkSession, model, kind: str) -> tuple[list[dict], list[float]]:
    """Read the node table Spark ML writes for a tree ensemble (bounded by
    model size) and return per-tree node dicts and tree weights."""
    path = scratch_path(spark, f"model-{uuid.uuid4().hex}")
    model.write().overwrite().save(path)
    rows = spark.read.parquet(f"{path}/data").select(
        "treeID", "nodeData.id", "nodeData.prediction", "nodeData.impurityStats",
        "nodeData.leftChild", "nodeData.rightChild", "nodeData.split.featureIndex",
        "nodeData.split.leftCategoriesOrThreshold").collect()
    trees: dict[int, dict[int, Node]] = {}
    for r in rows:
        stats = list(r["impurityStats"])
        if kind == "gbt":
            value, cover = float(r["prediction"]), float(stats[0])
        else:  # classification forest: normalised class-1 share, cover = total weight
            tot = float(sum(stats))
            value = float(stats[1]) / tot if tot > 0 and len(stats) > 1 else 0.0
            cover = tot
        thr = r["leftCategoriesOrThreshold"]
        trees.setdefault(r["treeID"], {})[r["id"]] = Node(
            r["id"], value, cover, r["leftChild"], r["rightChild"],
            r["featureIndex"], float(thr[0]) if thr else 0.0)
    ids = sorted(trees)
    if kind == "gbt":
        weights = list(model.treeWeights)
    else:
        weights = [1.0 / len(ids)] * len(ids)
    # nodes of a tree are keyed by id; the root is the node no child points to
    out = []
    for t in ids:
        nodes = trees[t]
        children = {n.left for n in nodes.values()} | {n.right for n in nodes.values()}
        root = [i for i in nodes if i not in children][0]
        out.append((nodes, root))
    return out, weights


def compile_spark_model(spark: SparkSession, model, n_features: int) -> CompiledEnsemble:
    """GBT: margin in log-odds units (2F, Spark's probability is sigmoid(2F));
    random forest: probability units."""
    kind = "gbt" if hasattr(model, "treeWeights") and model.__class__.__name__.startswith("GBT") else "rf"
    trees, weights = nodes_from_spark_model(spark, model, kind)
    return compile_ensemble(trees, weights, n_features, scale=2.0 if kind == "gbt" else 1.0)


# ----------------------------------------------------------- Spark evaluation
def _tables(ens: CompiledEnsemble) -> list[tuple]:
    """Leaves by path length: ``(features, lo, hi, contributions)``, each with one row a leaf."""
    by_depth: dict[int, list] = {}
    for leaf, contrib, _ in ens.leaves:
        if leaf.features:
            by_depth.setdefault(len(leaf.features), []).append((leaf, contrib))
    return [(np.array([leaf.features for leaf, _ in group]), np.array([leaf.lo for leaf, _ in group], dtype=float),
             np.array([leaf.hi for leaf, _ in group], dtype=float), np.stack([c for _, c in group]))
            for _, group in sorted(by_depth.items())]


def tree_shap(ens: CompiledEnsemble, test: DataFrame, feature_names: Sequence[str],
              cells: int = 1 << 21) -> DataFrame:
    """(id, feature, feature_value, base_value, shap_value) for every row and feature.

    ``cells`` bounds the (rows x leaves) block evaluated at once.
    """
    p = len(feature_names)
    shared = test.sparkSession.sparkContext.broadcast(_tables(ens))

    def run(batches):
        tables = shared.value
        widest = max([1] + [len(t[0]) for t in tables])
        for b in batches:
            if b.num_rows == 0:
                continue
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)[:, :p]
            phi = np.zeros((b.num_rows, p))
            step = max(1, cells // widest)
            for at in range(0, b.num_rows, step):
                rows = x[at:at + step]
                for features, lo, hi, contrib in tables:
                    leaves, d = features.shape
                    pattern = np.zeros((len(rows), leaves), dtype=np.int64)
                    for k in range(d):
                        v = rows[:, features[:, k]]
                        pattern += ((lo[:, k] < v) & (v <= hi[:, k])).astype(np.int64) << k
                    for k in range(d):
                        onto = np.zeros((leaves, p))
                        onto[np.arange(leaves), features[:, k]] = 1.0
                        phi[at:at + step] += contrib[np.arange(leaves)[None, :], pattern, k] @ onto
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), p))),
                 pa.array(np.tile(np.arange(p, dtype=np.int32), b.num_rows)),
                 pa.array(x.ravel()), pa.array(phi.ravel())], names=["id", "j", "feature_value", "shap_value"])

    kind = test.schema["id"].dataType.simpleString()
    long = test.select("id", F.col("x").cast("array<double>").alias("x")) \
        .mapInArrow(run, f"id {kind}, j int, feature_value double, shap_value double")
    names = F.array(*[F.lit(n) for n in feature_names])
    return long.select("id", F.element_at(names, F.col("j") + 1).alias("feature"), "feature_value",
                       F.lit(float(ens.base_value)).alias("base_value"), "shap_value")


# ------------------------------------------------------- a data-derived tree
def median_split_tree(train: DataFrame, label: str = "label") -> dict[int, Node]:
    """A depth-2 regression tree grown by median splits, its medians taken from
    grouped counts (no task holds a column's distinct values):

    root: x[0] <= median(x[0]); left child: x[2] <= median of x[2] on the
    left rows; right child: x[0] again, at the median of x[0] on the right
    rows (a repeated feature). Leaf value = mean label, cover = row count.
    """
    x0, x2 = F.element_at("x", 1), F.element_at("x", 3)

    def medians(**of):
        got = exact_quantiles(train.select(*[c.alias(name) for name, c in of.items()]), list(of), (0.5,))
        return [got[name][1][0] if got[name][1] else None for name in of]

    t0, = medians(t0=x0)
    left = x0 <= F.lit(t0)
    t1, t2 = medians(t1=F.when(left, x2), t2=F.when(~left, x0))
    leaf = F.when(left & (x2 <= F.lit(t1)), 3).when(left, 4) \
        .when(x0 <= F.lit(t2), 5).otherwise(6)
    stats = {row["leaf"]: (row["n"], row["v"]) for row in
             train.groupBy(leaf.alias("leaf")).agg(F.count(F.lit(1)).alias("n"),
                                                   F.avg(F.col(label).cast("double")).alias("v")).collect()}

    def n(i):
        return float(stats.get(i, (0, 0.0))[0])

    def v(i):
        return float(stats.get(i, (0, 0.0))[1] or 0.0)

    nodes = {
        0: Node(0, 0.0, n(3) + n(4) + n(5) + n(6), 1, 2, 0, float(t0)),
        1: Node(1, 0.0, n(3) + n(4), 3, 4, 2, float(t1)),
        2: Node(2, 0.0, n(5) + n(6), 5, 6, 0, float(t2)),
    }
    for i in (3, 4, 5, 6):
        nodes[i] = Node(i, v(i), n(i), -1, -1, -1, 0.0)
    return nodes
