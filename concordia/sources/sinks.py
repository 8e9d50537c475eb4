"""Sources and sinks around the attribution tables.

Tables are written partitioned by their keys instead of one file per
dataset/target; re-runs overwrite only their own partitions (dynamic
partition overwrite) and presentation order is applied at read time.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import quoted
from ..functions.ordering import row_number


# ------------------------------------------------------------------ S6, S7, J7
def rule_miner_export(train: DataFrame, test: DataFrame, path: str | None = None,
                      fmt: str = "parquet", mode: str = "overwrite") -> DataFrame:
    """Train and test rows with targets and a ``Set_Type`` column, one frame."""
    out = train.withColumn("Set_Type", F.lit("Train")) \
        .unionByName(test.withColumn("Set_Type", F.lit("Test")), allowMissingColumns=True)
    if path:
        w = out.write.mode(mode).format(fmt)
        if fmt == "csv":
            w = w.option("header", True)
        w.save(path)
    return out


# -------------------------------------------------------------------- S9, W4
def presentation_order(attr: DataFrame, out: str = "seq") -> DataFrame:
    """Sequence number in (id, lower(feature)) order, computed distributed."""
    return row_number(attr, [F.col("id").asc(), F.lower("feature").asc(), F.col("feature").asc()], out=out)


def write_attributions(df: DataFrame, path: str, partition_cols: Sequence[str] = ("dataset", "target_context"),
                       fmt: str = "parquet") -> None:
    """One table partitioned by (dataset, target_context); only the
    partitions present in ``df`` are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_cols).format(fmt).save(path)


def read_attributions(spark, path: str, fmt: str = "parquet") -> DataFrame:
    """The partition columns replace the per-file context names."""
    return spark.read.format(fmt).load(path)


# ------------------------------------------------------------------------ S12
def latest_per_key(df: DataFrame, keys: Sequence[str], order_col: str) -> DataFrame:
    """Keep the newest row per key (re-runs appended to a metrics table):
    a grouped max over a struct, no window over the whole key."""
    others = [c for c in df.columns if c not in keys]
    best = F.max(F.struct(F.col(order_col), *[F.col(c) for c in others if c != order_col]))
    return df.groupBy(*keys).agg(best.alias("__b")).select(
        *keys, F.col(f"__b.{order_col}").alias(order_col),
        *[F.col(f"__b.{c}").alias(c) for c in others if c != order_col])


def write_metrics(rows: DataFrame, path: str, keys: Sequence[str] = ("dataset", "target", "classifier"),
                  run_col: str = "run", fmt: str = "parquet") -> None:
    """Append a run's metric rows; :func:`read_metrics` keeps each key's newest run."""
    rows.select(*keys, run_col, *[c for c in rows.columns if c not in keys and c != run_col]) \
        .write.mode("append").format(fmt).save(path)


def read_metrics(spark, path: str, keys: Sequence[str] = ("dataset", "target", "classifier"),
                 run_col: str = "run", fmt: str = "parquet") -> DataFrame:
    return latest_per_key(spark.read.format(fmt).load(path), keys, run_col)


# ------------------------------------------------- S12, S14: versioned tables
def current_version(spark, path: str) -> tuple[int, str | None]:
    """``(number, folder)`` of a versioned table's current version; (0, None) before the first."""
    try:
        row = spark.read.parquet(f"{path}/pointers").agg(F.max(F.struct("number", "version")).alias("p")).first()["p"]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, None
    return row["number"], row["version"]


def commit_table(df: DataFrame, path: str) -> str:
    """Write ``df`` as a table's new version: staged in a folder of its own, then made current by one pointer row.

    Readers follow the newest pointer, which is written last and as one file:
    they see the old version or the whole new one, and a run that fails before
    leaves the old one current. One writer at a time.
    """
    spark = df.sparkSession
    number, _ = current_version(spark, path)
    version = uuid.uuid4().hex
    df.write.parquet(f"{path}/versions/{version}")
    spark.createDataFrame([(number + 1, version)], "number long, version string").coalesce(1) \
        .write.mode("append").parquet(f"{path}/pointers")
    return version


def read_table(spark, path: str) -> DataFrame:
    """A versioned table as it is now."""
    version = current_version(spark, path)[1]
    if version is None:
        raise ValueError(f"no version of {path} has been committed")
    return spark.read.parquet(f"{path}/versions/{version}")


def overwrite_keys(rows: DataFrame, path: str, keys: Sequence[str]) -> str:
    """Replace a versioned table's rows of the keys in ``rows`` and keep all others, in one commit.

    Keys are compared null-safe; rows of one key are replaced together.
    """
    spark = rows.sparkSession
    if current_version(spark, path)[1] is None:
        return commit_table(rows, path)
    old = read_table(spark, path)
    new = rows.select(*[quoted(k).alias(f"__k{i}") for i, k in enumerate(keys)]).distinct()
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & quoted(k).eqNullSafe(F.col(f"__k{i}"))
    return commit_table(old.join(new, same, "left_anti").unionByName(rows.select(*[quoted(c) for c in old.columns])), path)


# ------------------------------------------------------------------------ S14
def write_summary(summary_wide: DataFrame, path: str, fmt: str = "csv") -> None:
    w = summary_wide.coalesce(1).write.mode("overwrite").format(fmt)  # one row per dataset
    if fmt == "csv":
        w = w.option("header", True)
    w.save(path)
