"""Oversampling of smaller classes (F6) and the balanced export.

Synthetic rows lie between a row and one of its k nearest rows of the same
class; neighbours are exact (:mod:`.neighbours`). Every class smaller than the
largest one is brought to its size. Every draw comes from the portable hash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import TWO_32, uhash32
from ..functions.ordering import row_number
from ..session import materialize
from .neighbours import nearest

K_NEIGHBOURS = 5
#: A label column with more values is no class label.
MAX_CLASSES = 1000


def class_sizes(train: DataFrame, label: str) -> dict:
    """Rows of every class (labels that are not null), smallest label first."""
    counts = train.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n")).limit(MAX_CLASSES + 1).collect()
    if len(counts) > MAX_CLASSES:
        raise ValueError(f"{label} has more than {MAX_CLASSES} values")
    return {r[label]: r["n"] for r in sorted(counts, key=lambda r: r[label])}


def smote(train: DataFrame, p: int, label: str = "label", k: int = K_NEIGHBOURS, seed: str = "smote") -> DataFrame:
    """``(id, x, label, base, neighbour)``: synthetic rows that bring every class to the size of the largest.

    Ids are fresh: they continue after the largest train id, class by class in
    order of the label. A class of one row stays as it is; so do even classes.
    """
    sizes = class_sizes(train, label)
    kind = train.schema[label].dataType
    spark = train.sparkSession
    out = spark.createDataFrame([], "id long, x array<double>") \
        .select("id", "x", F.lit(None).cast(kind).alias(label), *[F.lit(None).cast("long").alias(c) for c in ("base", "neighbour")])
    goal, done = max(sizes.values(), default=0), 0
    top = train.agg(F.max("id")).first()[0]
    for value, n in sizes.items():
        need = goal - n
        if n < 2 or need == 0:
            continue
        rows = materialize(train.where(F.col(label) == F.lit(value)).select("id", "x"))
        near = materialize(nearest(rows, p, k))
        bases = row_number(rows, [F.col("id").asc()], out="r")
        draws = spark.range(done, done + need).select(
            F.col("id").alias("i"), (uhash32(f"{seed}-row", "id") % F.lit(n) + 1).alias("r"),
            uhash32(f"{seed}-near", "id").alias("pick"), (uhash32(f"{seed}-step", "id") / F.lit(float(TWO_32))).alias("u"))
        chosen = draws.join(bases, "r").withColumn("rank", (F.col("pick") % F.lit(min(k, n - 1)) + 1).cast("int"))
        ends = rows.select(F.col("id").alias("neighbour"), F.col("x").alias("nx"))
        out = out.unionByName(chosen.join(near, ["id", "rank"]).join(ends, "neighbour").select(
            (F.lit(top) + 1 + F.col("i")).alias("id"),
            F.zip_with("x", "nx", lambda a, b: a + F.col("u") * (b - a)).alias("x"),
            F.lit(value).cast(kind).alias(label), F.col("id").alias("base"), "neighbour"))
        done += need
    return out


def balanced_export(train: DataFrame, test: DataFrame, p: int, label: str | Sequence[str] = "label",
                    **params) -> DataFrame | None:
    """Train, its synthetic rows and test in one frame with ``Set_Type`` and ``synthetic``.

    None for several labels: they have no common balance, and the export is skipped.
    """
    if not isinstance(label, str):
        if len(label) != 1:
            return None
        label = label[0]
    columns = ["id", "x", label]
    real = train.select(*columns).withColumns({"Set_Type": F.lit("Train"), "synthetic": F.lit(0)})
    made = smote(train, p, label, **params).select(*columns).withColumns({"Set_Type": F.lit("Train"), "synthetic": F.lit(1)})
    held = test.select(*columns).withColumns({"Set_Type": F.lit("Test"), "synthetic": F.lit(0)})
    return real.unionByName(made).unionByName(held)
