"""The rows of smallest hash, exactly so many a group, without sorting the table.

The n-th smallest hash of every group is found by refining ranges: a pass counts
the hashes of a range in at most 4,096 slots (partial aggregates), the slot that
holds the n-th one is the next range, and after three passes a range is one
hash. Then one comparison a row tells the chosen ones. Only the groups and
hashes are written once for the passes, no rows; rows are ranked only among
those that share the very last hash, if not all of them are wanted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .hashing import uhash32
from .names import quoted
from .ordering import row_number

HASH_BITS = 32
SLOT_BITS = 12
#: A column with more values is no class label; one row a value reaches the driver.
MAX_GROUPS = 10_000


def group_sizes(hashes: DataFrame) -> dict:
    """Rows of every group (``__g``), null a group of its own."""
    rows = hashes.groupBy("__g").agg(F.count(F.lit(1)).alias("n")).limit(MAX_GROUPS + 1).collect()
    if len(rows) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups")
    return {r["__g"]: r["n"] for r in rows}


def _thresholds(hashes: DataFrame, need: dict, kind: T.DataType) -> dict:
    """Per group ``(n-th smallest hash, rows with that hash that are wanted, rows with it)``."""
    spark = hashes.sparkSession
    schema = T.StructType([T.StructField("__k", kind), T.StructField("prefix", T.LongType()), T.StructField("left", T.LongType())])
    state, done = {g: (0, n, 0) for g, n in need.items()}, 0
    while done < HASH_BITS and state:
        step = min(SLOT_BITS, HASH_BITS - done)
        shift = HASH_BITS - done - step
        # one row a group, at most MAX_GROUPS
        now = F.broadcast(spark.createDataFrame([(g, p, n) for g, (p, n, _) in state.items()], schema))
        inside = hashes.join(now, F.col("__g").eqNullSafe(F.col("__k")) & (F.shiftright("__h", shift + step) == F.col("prefix")))
        slots = inside.groupBy("__g", "left", F.shiftright("__h", shift).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
        # 4,096 rows a group at most
        upto = F.sum("n").over(Window.partitionBy("__g").orderBy("slot"))
        found = slots.withColumn("upto", upto).where((F.col("upto") >= F.col("left")) & (F.col("upto") - F.col("n") < F.col("left")))
        state = {r["__g"]: (r["slot"], r["left"] - (r["upto"] - r["n"]), r["n"]) for r in found.collect()}
        done += step
    return state


def with_smallest(df: DataFrame, key: str, need, group: str | None = None, seed: int = 42, out: str = "__chosen") -> DataFrame:
    """``df`` with a boolean column: is the row among its group's smallest hashes of ``key`` (ties by the key itself)?

    ``need``: function from the groups' sizes ``{group: rows}`` to the rows wanted of each.
    """
    kind = df.schema[group].dataType if group else T.IntegerType()
    g = quoted(group) if group else F.lit(0)
    hashes = materialize(df.select(g.alias("__g"), uhash32(seed, quoted(key)).alias("__h")))
    sizes = group_sizes(hashes)
    wanted = need(sizes)
    rules = {k: (1 << HASH_BITS, 0, 0) if wanted[k] >= n else (-1, 0, 0) for k, n in sizes.items()}
    rules |= _thresholds(hashes, {k: wanted[k] for k, n in sizes.items() if 0 < wanted[k] < n}, kind)
    schema = T.StructType([T.StructField("__k", kind), T.StructField("__last", T.LongType()), T.StructField("__left", T.LongType()),
                           T.StructField("__tied", T.LongType())])
    table = F.broadcast(df.sparkSession.createDataFrame([(k, *v) for k, v in rules.items()], schema))  # one row a group
    rows = df.withColumn("__h", uhash32(seed, quoted(key))).join(table, g.eqNullSafe(F.col("__k")))
    names = [F.col(f"`{c}`") for c in df.columns]
    tied = (F.col("__h") == F.col("__last")) & (F.col("__left") < F.col("__tied"))
    clear = rows.where(~tied).select(*names, (F.col("__h") <= F.col("__last")).alias(out))
    if all(left == n for _, left, n in rules.values()):
        return clear
    some = row_number(rows.where(tied), [quoted(key).asc()], ["__k"], out="__rn")
    return clear.unionByName(some.select(*names, (F.col("__rn") <= F.col("__left")).alias(out)))
