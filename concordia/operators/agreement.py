"""Explainer agreement: unique ranks, Spearman, Kendall tau-b, top-K Jaccard.

Everything works on the long importance table

    importance(dataset, target, attribute, method, value)

so that any number of datasets, targets and methods is processed by one job,
keyed by ``(dataset, target, pair)``. No step funnels a group through one
task and no step forms all attribute pairs: Kendall's tau-b is computed with
a dyadic dominance count (n log n rows per group) instead of a pair join.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordering import written_row_number
from ..session import dropping, written

# Method names, method pairs and their report labels, metric
# names, the default target label and the summary's total-row label.
METHODS = ["Rulex", "SHAP", "LIME", "Ablation"]
PAIRS = [
    ("Rulex", "SHAP", "Rulex-SHAP"),
    ("Rulex", "LIME", "Rulex-LIME"),
    ("SHAP", "LIME", "SHAP-LIME"),
    ("Rulex", "Ablation", "Rulex-Ablat"),
    ("SHAP", "Ablation", "SHAP-Ablat"),
    ("LIME", "Ablation", "LIME-Ablat"),
]
METRICS = ["Spearman", "Kendall", "Jaccard"]
SINGLE_TARGET = "Single_Target"
TOTAL_ROW = "TOTAL AVERAGE"
TOP_K = 5

GROUP = ["dataset", "target"]


def metric_column_name(metric: str, pair: str) -> str:
    """snake_case wide-table column, e.g. ``spearman_rulex_shap``."""
    return f"{metric}_{pair}".lower().replace("-", "_")


def pairs_frame(spark: SparkSession, pairs=PAIRS) -> DataFrame:
    # a fixed list of method pairs: constant size, safe to broadcast
    return F.broadcast(spark.createDataFrame(list(pairs), "m1 string, m2 string, pair string"))


# ---------------------------------------------------------------- I1, W5, S13
def check_contract(df: DataFrame, methods: Sequence[str] = METHODS,
                   attribute_col: str = "Attribute") -> None:
    """Strict column contract on a wide importance table (schema only, no job)."""
    missing = [c for c in [attribute_col, *methods] if c not in df.columns]
    if missing:
        raise ValueError(f"importance table is missing required columns: {missing}")


def unpivot_valid(tables: dict, methods: Sequence[str] = METHODS, **params) -> tuple[DataFrame | None, dict[str, str]]:
    """Unpivot every dataset's importance table that keeps the contract.

    Returns the stacked long table (None when none does) and a message for
    each dataset left out; one bad table never fails the others.
    """
    out, skipped = None, {}
    for name, wide in tables.items():
        try:
            check_contract(wide, methods)
        except ValueError as e:
            skipped[name] = str(e)
            continue
        part = unpivot_importance(wide, methods, dataset=name, **params)
        out = part if out is None else out.unionByName(part)
    return out, skipped


def unpivot_importance(wide: DataFrame, methods: Sequence[str] = METHODS,
                       attribute_col: str = "Attribute", target_col: str = "Target",
                       dataset_col: str = "dataset", dataset: str | None = None) -> DataFrame:
    """Wide (dataset, [Target], Attribute, <methods>) -> long importance table.

    A missing target column becomes the constant ``Single_Target`` group;
    extra columns (cumulative ablation, predictions, constants) are ignored.
    """
    check_contract(wide, methods, attribute_col)
    ds = F.lit(dataset) if dataset is not None else F.col(dataset_col)
    tgt = F.coalesce(F.col(target_col).cast("string"), F.lit(SINGLE_TARGET)) \
        if target_col in wide.columns else F.lit(SINGLE_TARGET)
    base = wide.select(ds.cast("string").alias("dataset"), tgt.alias("target"),
                       F.col(attribute_col).cast("string").alias("attribute"),
                       *[F.col(m).cast("double").alias(m) for m in methods])
    return base.unpivot(["dataset", "target", "attribute"], list(methods), "method", "value")


# ---------------------------------------------------------------------- W1, I2
def unique_ranks(imp: DataFrame, tie_col: str | None = None) -> DataFrame:
    """Unique descending rank per (dataset, target, method).

    Ties are broken by ``tie_col`` ascending (default: the attribute name);
    a golden mode may pass a small noise column that is *added* to the value
    first, reproducing rank-with-noise behaviour.
    """
    df = imp
    if tie_col is not None and tie_col != "attribute":
        df = df.withColumn("__rank_value", F.col("value") + F.col(tie_col))
    else:
        df = df.withColumn("__rank_value", F.col("value"))
    ranked = written_row_number(df, [F.col("__rank_value").desc(), F.col("attribute").asc()],
                                partition_cols=GROUP + ["method"], out="rank")
    return ranked.drop("__rank_value")


def paired_points(ranks: DataFrame, pairs=PAIRS) -> DataFrame:
    """(dataset, target, pair, attribute, xr, yr, xv, yv) for every method pair."""
    spark = ranks.sparkSession
    p = pairs_frame(spark, pairs)
    # dealt once for both sides, so the methods are compared beside the join's keys and not among them
    dealt = ranks.select(*GROUP, "attribute", "method", "rank", "value").repartition(*GROUP, "attribute")
    a = dealt.select(*GROUP, "attribute", F.col("method").alias("m1"),
                     F.col("rank").alias("xr"), F.col("value").alias("xv")).join(p, "m1")
    b = dealt.select(*[F.col(c).alias(f"__{c}") for c in (*GROUP, "attribute")], F.col("method").alias("__m2"),
                     F.col("rank").alias("yr"), F.col("value").alias("yv"))
    same = F.array_contains(F.array("m2"), F.col("__m2"))
    for c in (*GROUP, "attribute"):
        same = same & (F.col(c) == F.col(f"__{c}"))
    return a.join(b, same).select(*GROUP, "pair", "attribute", "xr", "yr", "xv", "yv")


# -------------------------------------------------------------------------- I3
def spearman(points: DataFrame) -> DataFrame:
    """Pearson correlation of the unique ranks; NULL for groups of one attribute.

    Both rank vectors are permutations of 1..n, so the correlation equals
    1 - 6*sum(d^2) / (n(n^2-1)), evaluated from exact integer sums with one
    division: the same double in every engine, whatever the summation order.
    """
    n = F.count(F.lit(1))
    # n^3 and the sum of squares leave 64 bits above some two million attributes: exact decimals
    gap = (F.col("xr") - F.col("yr")).cast("decimal(18,0)")
    d2 = F.sum((gap * gap).cast("decimal(28,0)"))
    wide = n.cast("decimal(12,0)")
    den = ((wide * wide - 1).cast("decimal(25,0)") * wide).cast("double")
    rho = F.when(n >= 2, F.lit(1.0) - (F.lit(6.0) * d2.cast("double")) / den)
    return points.groupBy(*GROUP, "pair").agg(rho.alias("value")) \
        .withColumn("metric", F.lit("Spearman"))


# -------------------------------------------------------------------------- I4
#: Neighbouring ranks counted within one block (2^12 rows at most), and blocks of a strip of the grid.
BLOCK_BITS = 12
STRIP = 64
#: Slices of the groups that many points are counted in, and the points from which on they are.
SLICES = 8
SLICED_POINTS = 32_000_000


def _dominance_total(points: DataFrame, key: Sequence[str]) -> DataFrame:
    """Per group: number of ordered point pairs (i, j) with x_j < x_i and y_j < y_i.

    Points are numbered twice, by (y ascending, x descending) and by (x
    ascending, first number descending), so the pairs are those that ascend in
    both numbers, and ties form none. Both numbers are cut into blocks. A pair
    either lies in one block of y, or in different blocks of y and one block of
    x, or in different blocks of both. The first two kinds are counted inside a
    block at once, the third on the grid of counts of (y block, x block), a
    strip of y blocks in a task. No point is exploded.
    """
    key = list(key)
    numbered = written_row_number(points.select(*key, "x", "y"), [F.col("y").asc(), F.col("x").desc()], partition_cols=key, out="__n") \
        .select(*key, "x", (F.col("__n") - 1).alias("yr"))
    # a null counts as NaN in x, above every number
    last = F.coalesce(F.col("x").cast("double"), F.lit(float("nan")))
    numbered = numbered.withColumn("x", last)
    pts = written_row_number(numbered, [F.col("x").asc(), F.col("yr").desc()], partition_cols=key, out="__n") \
        .select(*key, "yr", (F.col("__n") - 1).alias("xr"))

    def ascending(first, second):
        """Pairs in ascending order of both (``first`` unique)."""
        import numpy as np

        v, total = second[first.argsort()], 0
        for at in range(0, len(v), 256):
            part = v[at:at + 256]
            total += int((v[None, at + len(part):] > part[:, None]).sum())
            total += int(np.triu(part[None, :] > part[:, None], 1).sum())
        return total

    def counter(bits):
        def count(_, t):
            import pyarrow as pa

            total = ascending(t["xr"].to_numpy(), t["yr"].to_numpy() >> bits)
            return pa.table({**{k: t[k].slice(0, 1) for k in key}, "dom": pa.array([total], pa.int64())})

        return count

    types = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    schema = ", ".join([f"`{k}` {types[k]}" for k in key] + ["dom long"])
    blocks = pts.select(*key, "xr", "yr", F.shiftright("yr", BLOCK_BITS).alias("yb"), F.shiftright("xr", BLOCK_BITS).alias("xb"))
    within = blocks.select(*key, "yb", "xr", "yr").groupBy(*key, "yb").applyInArrow(counter(0), schema)
    largest = pts.groupBy(*key).agg(F.max("yr").alias("top")).where(F.col("top") >= 1 << BLOCK_BITS)
    if largest.isEmpty():  # every group is one block
        return within.groupBy(*key).agg(F.sum("dom").alias("dom"))
    large = blocks.join(largest.select(*key), key, "left_semi")
    beside = large.select(*key, "xb", "xr", "yr").groupBy(*key, "xb").applyInArrow(counter(BLOCK_BITS), schema)
    grid = written(large.groupBy(*key, "yb", "xb").agg(F.count(F.lit(1)).alias("c"))
                   .withColumn("strip", F.floor(F.col("yb") / STRIP).cast("long")))
    # what lies below a strip, for every strip that comes after and every block of x: a row a strip, in the order of strips
    strips = grid.groupBy(*key, "xb", "strip").agg(F.sum("c").alias("c"))
    steps = grid.groupBy(*key).agg(F.max("strip").alias("last"))
    below = strips.join(steps, key).groupBy(*key, "xb", "last").agg(F.collect_list(F.struct("strip", "c")).alias("of")) \
        .select(*key, "xb", "of", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("strip")) \
        .select(*key, "xb", "strip", F.expr("aggregate(filter(of, s -> s.strip < strip), 0L, (a, s) -> a + s.c)").alias("c"))

    def strip(cells, under):
        import numpy as np
        import pyarrow as pa

        xb = under.column("__b_xb").to_numpy()
        held = np.zeros(int(xb.max()) + 1, np.int64)
        held[xb] = under.column("__b_c").to_numpy()
        yb, at, n = (cells.column(c).to_numpy() for c in ("yb", "xb", "c"))
        order, total = yb.argsort(kind="stable"), 0
        for one in np.split(order, np.flatnonzero(np.diff(yb[order])) + 1):
            upto = np.cumsum(held) - held
            total += int((n[one] * upto[at[one]]).sum())
            held[at[one]] += n[one]
        return pa.table({**{k: cells[k].slice(0, 1) for k in key}, "dom": pa.array([total], pa.int64())})

    below = below.toDF(*[f"__b_{c}" for c in below.columns])  # names of its own, as both sides come from the grid
    between = grid.groupBy(*key, "strip").cogroup(below.groupBy(*[f"__b_{k}" for k in key], "__b_strip")).applyInArrow(strip, schema)
    return within.unionByName(beside).unionByName(between).groupBy(*key).agg(F.sum("dom").alias("dom"))


def kendall_tau_b(points: DataFrame, x: str = "xv", y: str = "yv",
                  key: Sequence[str] = ("dataset", "target", "pair")) -> DataFrame:
    """Kendall tau-b on raw values; NaN cases (constant side, n < 2) -> 0.

    S = 2*C - (n0 - n1) + (n2 - n3) with C the dominance count, n0 all pairs,
    n1/n2 pairs tied in x/y and n3 pairs tied in both.
    """
    key = list(key)
    # read by every count below: written once, and without the attributes, which no count needs
    pts = written(points.select(*key, F.col(x).alias("x"), F.col(y).alias("y")))
    if pts.count() < SLICED_POINTS:
        return _tau_b(pts, key)
    # a slice of the groups after another: what its counts deal out and write is on disk at a time
    parts = []
    for k in range(SLICES):
        with dropping(pts.sparkSession):
            parts.append(written(_tau_b(pts.where(F.pmod(F.hash(*key), F.lit(SLICES)) == k), key), kept=True))
    return reduce(DataFrame.unionByName, parts)


def _tau_b(pts: DataFrame, key: Sequence[str]) -> DataFrame:
    """:func:`kendall_tau_b` of written points (key, x, y)."""

    def tie_pairs(cols, name):
        return pts.groupBy(*key, *cols).count().groupBy(*key).agg(
            F.sum(F.col("count") * (F.col("count") - 1) / 2).alias(name))

    sizes = pts.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    n1 = tie_pairs(["x"], "n1")
    n2 = tie_pairs(["y"], "n2")
    n3 = tie_pairs(["x", "y"], "n3")
    dom = _dominance_total(pts, key)
    t = sizes.join(n1, key).join(n2, key).join(n3, key).join(dom, key, "left") \
        .withColumn("n0", F.col("n") * (F.col("n") - 1) / 2) \
        .withColumn("dom", F.coalesce("dom", F.lit(0)))
    s = 2 * F.col("dom") - (F.col("n0") - F.col("n1")) + (F.col("n2") - F.col("n3"))
    den = F.sqrt((F.col("n0") - F.col("n1")) * (F.col("n0") - F.col("n2")))
    tau = F.coalesce(F.try_divide(s, F.when(den > 0, den)), F.lit(0.0))
    return t.select(*key, tau.alias("value")).withColumn("metric", F.lit("Kendall"))


# ------------------------------------------------------------------ W2, J8, I5
def top_k_sets(ranks: DataFrame, k: int = TOP_K) -> DataFrame:
    """Attributes of the k best ranks per (dataset, target, method)."""
    return ranks.where(F.col("rank") <= k).select(*GROUP, "method", "attribute", "rank")


def jaccard_top_k(ranks: DataFrame, k: int = TOP_K, pairs=PAIRS) -> DataFrame:
    spark = ranks.sparkSession
    p = pairs_frame(spark, pairs)
    top = top_k_sets(ranks, k)
    sizes = top.groupBy(*GROUP, "method").agg(F.count(F.lit(1)).alias("size"))
    a = top.select(*GROUP, F.col("method").alias("m1"), "attribute")
    b = top.select(*GROUP, F.col("method").alias("m2"), "attribute")
    inter = a.join(p, "m1").join(b, GROUP + ["m2", "attribute"]) \
        .groupBy(*GROUP, "pair").agg(F.count(F.lit(1)).alias("inter"))
    groups = ranks.select(*GROUP, "method").distinct().join(p, F.col("method") == F.col("m1")) \
        .select(*GROUP, "m1", "m2", "pair")
    sa = sizes.select(*GROUP, F.col("method").alias("m1"), F.col("size").alias("sa"))
    sb = sizes.select(*GROUP, F.col("method").alias("m2"), F.col("size").alias("sb"))
    j = groups.join(sa, GROUP + ["m1"], "left").join(sb, GROUP + ["m2"], "left") \
        .join(inter, GROUP + ["pair"], "left")
    union = F.coalesce("sa", F.lit(0)) + F.coalesce("sb", F.lit(0)) - F.coalesce("inter", F.lit(0))
    val = F.when(union > 0, F.coalesce("inter", F.lit(0)) / union).otherwise(F.lit(0.0))
    return j.select(*GROUP, "pair", val.cast("double").alias("value")) \
        .withColumn("metric", F.lit("Jaccard"))


# ------------------------------------------------------------------- I6 .. I9
def agreement_per_target(imp: DataFrame, k: int = TOP_K, tie_col: str | None = None,
                         pairs=PAIRS) -> DataFrame:
    """All metrics for every (dataset, target, pair): long (.., metric, pair, value)."""
    # ranks are written by their numbering; paired points feed two metrics, which need no attribute
    ranks = unique_ranks(imp, tie_col)
    pts = written(paired_points(ranks, pairs).drop("attribute"))
    cols = [*GROUP, "metric", "pair", "value"]
    return spearman(pts).select(*cols) \
        .unionByName(kendall_tau_b(pts).select(*cols)) \
        .unionByName(jaccard_top_k(ranks, k, pairs).select(*cols))


def _ordered_mean(col: str):
    """Mean of the non-NULL values summed in ascending order (deterministic
    across partitionings; the list is one value per target, i.e. small)."""
    vals = F.array_sort(F.collect_list(col))
    total = F.aggregate(vals, F.lit(0.0), lambda a, b: a + b)
    return F.when(F.size(vals) > 0, total / F.size(vals))


def dataset_means(per_target: DataFrame) -> DataFrame:
    """Mean over targets per dataset, rounded half-even to 2 dp (NULLs skipped)."""
    return per_target.groupBy("dataset", "metric", "pair") \
        .agg(F.bround(_ordered_mean("value"), 2).alias("value"))


def with_total_row(per_dataset: DataFrame) -> DataFrame:
    """Append ``TOTAL AVERAGE``: mean of the already rounded dataset rows,
    rounded again. The rounded rows are exact cents, so they are summed as
    integers and divided once."""
    cents = F.sum(F.round(F.col("value") * 100).cast("bigint"))
    mean = cents.cast("double") / (F.lit(100.0) * F.count("value"))
    total = per_dataset.groupBy("metric", "pair") \
        .agg(F.bround(mean, 2).alias("value")) \
        .withColumn("dataset", F.lit(TOTAL_ROW))
    return per_dataset.unionByName(total)


def summary_wide(summary_long: DataFrame, pairs=PAIRS) -> DataFrame:
    """One row per dataset with 18 metric columns (fixed pivot list, no extra job)."""
    names = [metric_column_name(m, p[2]) for m in METRICS for p in pairs]
    keyed = summary_long.withColumn(
        "__col", F.lower(F.regexp_replace(F.concat_ws("_", "metric", "pair"), "-", "_")))
    return keyed.groupBy("dataset").pivot("__col", names).agg(F.first("value"))


def agreement_summary(imp: DataFrame, k: int = TOP_K, tie_col: str | None = None,
                      wide: bool = True) -> DataFrame:
    per_target = agreement_per_target(imp, k, tie_col)
    summary = with_total_row(dataset_means(per_target))
    return summary_wide(summary) if wide else summary
