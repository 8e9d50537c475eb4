"""Fit-on-train / apply-to-both transforms: imputation (H1-H4), one-hot and
label encoding (N1-N3), correlated-feature drop (C1), quantile labels (D1).

Fitting runs one aggregate over the training rows and returns a small,
immutable object (levels, means, modes, edges); applying is a single
``select`` of column expressions, so it never shuffles.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import quoted
from ..functions.ordering import row_number
from ..functions.quantiles import exact_quantiles, modes
from .clean import try_double

# Discretisation labels, in order.
BIN_LABELS = ["Low", "Mid", "High", "VeryHigh"]


def _is_string(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.StringType)


def _is_numeric(df: DataFrame, c: str) -> bool:
    """Booleans are categorical: they are filled by their mode."""
    return isinstance(df.schema[c].dataType, T.NumericType)


# ------------------------------------------------------------------ H1 .. H4
@dataclass(frozen=True)
class FittedImputer:
    columns: list[str]
    promoted: list[str]
    kept: list[str]
    means: dict = field(default_factory=dict)
    modes: dict = field(default_factory=dict)


def imputer_decisions(train: DataFrame, cols: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Per-column decision table computed in one aggregate (H1, H2).

    unparsable_share: share of NULL-or-unparsable values of a string column;
    null_share: share of NULLs after promotion. promote iff share < threshold,
    keep iff null_share <= threshold.
    """
    exprs = []
    for c in cols:
        if _is_string(train, c):
            exprs.append(F.avg(try_double(c).isNull().cast("double")).alias(f"u__{c}"))
        else:
            exprs.append(F.lit(None).cast("double").alias(f"u__{c}"))
        exprs.append(F.avg(quoted(c).isNull().cast("double")).alias(f"n__{c}"))
    row = train.agg(*exprs)
    long = row.select(F.inline(F.array(*[F.struct(
        F.lit(i).alias("position"), F.lit(c).alias("column"), quoted(f"u__{c}").alias("unparsable_share"),
        quoted(f"n__{c}").alias("raw_null_share")) for i, c in enumerate(cols)])))
    promoted = F.coalesce(F.col("unparsable_share") < threshold, F.lit(False))
    null_share = F.when(promoted, F.col("unparsable_share")).otherwise(F.col("raw_null_share"))
    return long.select("position", "column", "unparsable_share",
                       null_share.alias("null_share"), promoted.alias("promoted"),
                       (null_share <= threshold).alias("kept"))


def fit_imputer(train: DataFrame, cols: Sequence[str], threshold: float = 0.5) -> FittedImputer:
    dec = imputer_decisions(train, cols, threshold).collect()  # one row per column
    promoted = [r["column"] for r in dec if r["promoted"]]
    kept = [r["column"] for r in sorted(dec, key=lambda r: r["position"]) if r["kept"]]
    promoted_df = _promote(train, promoted)
    num = [c for c in kept if _is_numeric(promoted_df, c)]
    cat = [c for c in kept if c not in num]
    stats = promoted_df.agg(*[F.avg(quoted(c)).alias(f"m__{c}") for c in num]).first() if num else None
    means = {c: stats[f"m__{c}"] for c in num}
    return FittedImputer(list(cols), promoted, kept, means, modes(promoted_df, cat))


def _promote(df: DataFrame, promoted: Sequence[str]) -> DataFrame:
    ps = set(promoted)
    return df.select(*[try_double(c).alias(c) if c in ps else quoted(c) for c in df.columns])


def apply_imputer(df: DataFrame, fitted: FittedImputer, passthrough: Sequence[str] = ()) -> DataFrame:
    """Promote, keep the train survivors (train order), fill mean / mode."""
    p = _promote(df, [c for c in fitted.promoted if c in df.columns])
    out = [quoted(c) for c in passthrough]
    for c in fitted.kept:
        src = quoted(c) if c in p.columns else F.lit(None)
        if c in fitted.means:
            fill = fitted.means[c]
            out.append(F.coalesce(src.cast("double"), F.lit(fill).cast("double")).alias(c))
        else:
            fill = fitted.modes.get(c)
            out.append(F.coalesce(src, F.lit(fill)).alias(c))
    return p.select(*out)


# ------------------------------------------------------------------ N1, N2
def level_table(train: DataFrame, cols: Sequence[str], drop_first: bool = False) -> DataFrame:
    """Fitted levels as a table ``(column, level)``, whatever their number: distinct non-NULL
    train values as text, without the least one of each column when ``drop_first``."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), quoted(c).cast("string").alias("level")) for c in cols])
    levels = train.select(F.explode(cells).alias("c")).select("c.column", "c.level").where("level IS NOT NULL").distinct()
    if not drop_first:
        return levels
    least = levels.groupBy("column").agg(F.min("level").alias("least"))  # one row a column
    return levels.join(F.broadcast(least), "column").where("level > least").select("column", "level")


def one_hot_long(df: DataFrame, id_col: str, cols: Sequence[str], levels: DataFrame) -> DataFrame:
    """Sparse one-hot, one row ``(id, column, level)`` per 1: no wide frame, so any number of levels."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), quoted(c).cast("string").alias("level")) for c in cols])
    return df.select(quoted(id_col), F.explode(cells).alias("c")).select(quoted(id_col), "c.column", "c.level") \
        .join(levels, ["column", "level"], "left_semi").select(quoted(id_col), "column", "level")


def level_index(train: DataFrame, cols: Sequence[str], drop_first: bool = False) -> DataFrame:
    """``(column, level, slot)``: the levels of :func:`level_table` numbered from 0, column after column in the given order
    and in order of the level; ranked by distributed prefix sums, so nothing of it reaches the driver."""
    levels = level_table(train, cols, drop_first)
    place = F.element_at(F.create_map(*[v for i, c in enumerate(cols) for v in (F.lit(c), F.lit(i))]), F.col("column"))
    return row_number(levels.withColumn("__at", place), [F.col("__at").asc(), F.col("level").asc()], out="__rn") \
        .select("column", "level", (F.col("__rn") - 1).alias("slot"))


def one_hot_sparse(df: DataFrame, id_col: str, cols: Sequence[str], index: DataFrame, out: str = "onehot",
                   broadcast_bytes: int = 32 << 20) -> DataFrame:
    """``df`` with one sparse vector column ``struct<size, indices>`` for all of ``cols``: the slots that are 1, ascending.

    NULL and unseen levels have no slot. An index of checked size is broadcast
    and joined per column, without a shuffle; a larger one is joined on
    (column, level) and a row's slots, at most one a column, are put together by
    ``id_col``, which must be unique.
    """
    row = index.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("column") + F.octet_length("level") + 24).alias("bytes")).first()
    size = F.lit(row["n"]).cast("long").alias("size")
    names = [quoted(c) for c in df.columns]
    if (row["bytes"] or 0) <= broadcast_bytes:
        got = df
        for i, c in enumerate(cols):
            one = index.where(F.col("column") == c).select(F.col("level").alias("__level"), F.col("slot").alias(f"__s{i}"))
            got = got.join(F.broadcast(one), quoted(c).cast("string") == F.col("__level"), "left").drop("__level")
        found = F.array_compact(F.array(*[F.col(f"__s{i}") for i in range(len(cols))]))
        return got.select(*names, F.struct(size, found.alias("indices")).alias(out))
    cells = F.array(*[F.struct(F.lit(c).alias("column"), quoted(c).cast("string").alias("level")) for c in cols])
    slots = df.select(quoted(id_col).alias("__id"), F.explode(cells).alias("c")).select("__id", "c.column", "c.level") \
        .join(index, ["column", "level"]).groupBy("__id").agg(F.sort_array(F.collect_list("slot")).alias("__slots"))
    none = F.array().cast("array<bigint>")
    return df.join(slots, quoted(id_col) == F.col("__id"), "left") \
        .select(*names, F.struct(size, F.coalesce("__slots", none).alias("indices")).alias(out))


def fit_levels(train: DataFrame, cols: Sequence[str]) -> dict[str, list]:
    """Sorted distinct non-NULL train levels per column, for the wide form: one column a level.

    A wide frame's schema is built on the driver, so its levels are too; for
    columns of many levels use :func:`level_index` and :func:`one_hot_sparse`.
    """
    return {c: sorted(r[0] for r in train.select(quoted(c)).where(quoted(c).isNotNull()).distinct().collect()) for c in cols}


def one_hot(df: DataFrame, levels: dict[str, list], drop_first: bool = False,
            prefix: dict[str, str] | None = None) -> DataFrame:
    """Replace each column by ``<prefix>_<level>`` 0/1 columns; NULL -> all zeros."""
    prefix = prefix or {}
    out = []
    for c in df.columns:
        if c not in levels:
            out.append(quoted(c))
            continue
        lv = levels[c][1:] if drop_first else levels[c]
        for v in lv:
            out.append(F.when(quoted(c) == F.lit(v), 1).otherwise(0).alias(f"{prefix.get(c, c)}_{v}"))
    return df.select(*out)


# ---------------------------------------------------------------------- N3
def label_codes(train: DataFrame, col: str, out: str = "code") -> DataFrame:
    """Distinct train classes sorted by value -> 0..k-1 (distributed ranking)."""
    d = train.select(F.col(col).alias("value")).where(F.col("value").isNotNull()).distinct()
    return row_number(d, [F.col("value").asc()], out="__rn") \
        .select("value", (F.col("__rn") - 1).cast("int").alias(out))


def apply_label_codes(df: DataFrame, col: str, codes: DataFrame, out: str = "code",
                      strict: bool = True) -> DataFrame:
    """Join the code table (AQE broadcasts it when its runtime size is small);
    unseen labels are an error when ``strict``."""
    j = df.join(codes.withColumnRenamed("value", "__v"),
                F.col(col) == F.col("__v"), "left").drop("__v")
    if strict:
        j = j.withColumn(out, F.when(F.col(out).isNull() & F.col(col).isNotNull(),
                                     F.raise_error(F.concat(F.lit("unseen label: "), F.col(col).cast("string"))))
                         .otherwise(F.col(out)))
    return j


# ---------------------------------------------------------------------- C1
def correlation_table(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """All column pairs i<j with the null-safe Pearson r ``(i, j, r)``, over rows where both are present.

    One pass for means and magnitudes; then every partition forms one set of
    centred p x p moment matrices and passes on p(p-1)/2 rows, whatever its
    size, which are summed per pair. The plan doesn't grow with p. r is NULL
    where a side is constant.
    """
    p = len(cols)
    spark = train.sparkSession
    if p < 2:
        return spark.createDataFrame([], "i int, j int, r double")
    x = [quoted(c).cast("double") for c in cols]
    first = train.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(x)],
                      *[F.max(F.abs(v)).alias(f"a{i}") for i, v in enumerate(x)]).first()
    mean = [first[f"m{i}"] or 0.0 for i in range(p)]
    # deviations below this are rounding of the mean, not spread
    least = [(1e-12 * (first[f"a{i}"] or 0.0)) ** 2 for i in range(p)]

    def moments(batches):
        import numpy as np
        import pyarrow as pa

        centre, total = np.array(mean), None
        for b in batches:
            v = np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in b.columns], axis=1)
            here = ~np.isnan(v)
            d, m = np.where(here, v - centre, 0.0), here.astype(np.float64)
            part = np.stack([m.T @ m, d.T @ m, (d * d).T @ m, d.T @ d])
            total = part if total is None else total + part
        if total is not None:
            i, j = np.triu_indices(p, 1)
            n, s, ss, sp = total
            yield pa.RecordBatch.from_arrays(
                [pa.array(k) for k in (i.astype(np.int32), j.astype(np.int32), n[i, j], s[i, j], s[j, i], ss[i, j], ss[j, i], sp[i, j])],
                names=["i", "j", "n", "si", "sj", "qi", "qj", "c"])

    parts = train.select(*[v.alias(f"c{i}") for i, v in enumerate(x)]).mapInArrow(
        moments, "i int, j int, n double, si double, sj double, qi double, qj double, c double")
    t = parts.groupBy("i", "j").agg(*[F.sum(k).alias(k) for k in ("n", "si", "sj", "qi", "qj", "c")])
    floor = F.array(*[F.lit(v) for v in least])

    def spread(q, s):
        return F.col(q) / F.col("n") - (F.col(s) / F.col("n")) * (F.col(s) / F.col("n"))

    t = t.where("n > 0").withColumns({"vi": spread("qi", "si"), "vj": spread("qj", "sj")})
    ok = (F.col("vi") > F.element_at(floor, F.col("i") + 1)) & (F.col("vj") > F.element_at(floor, F.col("j") + 1))
    cov = F.col("c") / F.col("n") - (F.col("si") / F.col("n")) * (F.col("sj") / F.col("n"))
    return t.select("i", "j", F.when(ok, cov / F.sqrt(F.col("vi") * F.col("vj"))).alias("r"))


def correlated_drop_table(train: DataFrame, cols: Sequence[str], threshold: float = 0.9) -> DataFrame:
    """(position, column, max_earlier_abs_r, kept): drop j if ANY earlier i has
    |r| > threshold (dropped columns still count); undefined r never drops."""
    spark = train.sparkSession
    names = spark.createDataFrame([(k, c) for k, c in enumerate(cols)], "position int, `column` string")
    ct = correlation_table(train, cols)
    mx = ct.groupBy(F.col("j").alias("position")).agg(F.max(F.abs("r")).alias("max_earlier_abs_r"))
    return F.broadcast(names).join(mx, "position", "left").select(
        "position", "column", "max_earlier_abs_r",
        (~F.coalesce(F.col("max_earlier_abs_r") > threshold, F.lit(False))).alias("kept"))


def fit_correlated_drop(train: DataFrame, cols: Sequence[str], threshold: float = 0.9) -> list[str]:
    rows = correlated_drop_table(train, cols, threshold).collect()
    return [r["column"] for r in sorted(rows, key=lambda r: r["position"]) if r["kept"]]


# ---------------------------------------------------------------------- D1
@dataclass(frozen=True)
class FittedBins:
    edges: dict  # column -> sorted unique quantile edges (incl. min and max)


def fit_quantile_bins(train: DataFrame, cols: Sequence[str], min_distinct: int = 10) -> FittedBins:
    """Columns with more than ``min_distinct`` distinct train values get 4
    quantile bins (linear interpolation), duplicate edges dropped; columns
    left with fewer than 2 bins stay untouched."""
    edges = {}
    for c, (distinct, q) in exact_quantiles(train, cols, (0.0, 0.25, 0.5, 0.75, 1.0)).items():
        if distinct <= min_distinct or q is None:
            continue
        u = sorted(set(float(x) for x in q))
        if len(u) - 1 >= 2:
            edges[c] = u
    return FittedBins(edges)


def bin_label(col, edges: Sequence[float]) -> Column:
    """Right-closed bins with open outer edges; NULL stays NULL."""
    inner = edges[1:-1]
    labels = BIN_LABELS[: len(edges) - 1]
    x = quoted(col) if isinstance(col, str) else col
    e = F.when(x.isNull(), F.lit(None).cast("string"))
    for edge, lab in zip(inner, labels):
        e = e.when(x <= F.lit(float(edge)), F.lit(lab))
    return e.otherwise(F.lit(labels[-1]))


def apply_quantile_bins(df: DataFrame, fitted: FittedBins) -> DataFrame:
    return df.select(*[bin_label(c, fitted.edges[c]).alias(c) if c in fitted.edges else quoted(c)
                       for c in df.columns])
