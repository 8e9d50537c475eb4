"""Order-dependent primitives that never funnel a whole group through one task.

``Window.partitionBy(g).orderBy(o)`` evaluates every group ``g`` inside a
single task; a hot group (a third of the rows) then serialises the job. The
helpers here use the classic two-pass scheme instead:

1. range-partition on ``(g..., o...)`` so a big group is cut into many
   Spark partitions;
2. per (Spark partition, group) totals -> a small table of exclusive offsets
   (one row per partition slice, bounded by ``partitions + groups``);
3. a running total inside each (partition, group) slice plus its offset.

The result equals a global running total in ``o`` order within ``g``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, written


def _num_partitions(df: DataFrame, n: int | None) -> int:
    if n:
        return n
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def prefix_sums(df: DataFrame, order_cols: Sequence[Column], values: dict[str, Column],
                partition_cols: Sequence[str] = (), inclusive: bool = True,
                num_partitions: int | None = None) -> DataFrame:
    """Add one running-total column per entry of ``values``.

    ``order_cols`` must define a total order inside each group for the result
    to be deterministic (append a unique key when values can tie).
    ``inclusive=False`` gives the total of the strictly preceding rows.
    """
    grp = list(partition_cols)
    names = list(values)
    keep = df.columns
    base = df.select("*", *[values[k].alias(f"__v_{k}") for k in names])
    n = _num_partitions(df, num_partitions)
    ranged = base.repartitionByRange(n, *[F.col(c) for c in grp], *order_cols) \
        .withColumn("__pid", F.spark_partition_id())
    # Range bounds come from a sample of the input; after a shuffle the input
    # order is not fixed, so two evaluations could cut the slices differently.
    # A reliable checkpoint (shared checkpoint folder) pins one assignment for
    # both consumers below and cuts the lineage.
    ensure_checkpoint_dir(df.sparkSession)
    ranged = ranged.checkpoint(eager=True)

    hi = Window.currentRow if inclusive else -1
    w_local = Window.partitionBy("__pid", *grp).orderBy(*order_cols) \
        .rowsBetween(Window.unboundedPreceding, hi)
    local = ranged.select("*", *[F.coalesce(F.sum(f"__v_{k}").over(w_local), F.lit(0))
                                 .alias(f"__l_{k}") for k in names])

    totals = ranged.groupBy("__pid", *grp).agg(
        *[F.sum(f"__v_{k}").alias(f"__t_{k}") for k in names])
    w_off = Window.partitionBy(*grp).orderBy("__pid") \
        .rowsBetween(Window.unboundedPreceding, -1) if grp else \
        Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("__pid").alias("__opid"), *[F.col(c).alias(f"__g_{c}") for c in grp],
        *[F.coalesce(F.sum(f"__t_{k}").over(w_off), F.lit(0)).alias(f"__o_{k}")
          for k in names])
    if not grp:
        # one row per Spark partition: bounded by the partition count
        offsets = F.broadcast(offsets)
    cond = local["__pid"] == offsets["__opid"]
    for c in grp:
        cond = cond & local[c].eqNullSafe(offsets[f"__g_{c}"])
    joined = local.join(offsets, cond, "inner")
    return joined.select(*[local[c] for c in keep],
                         *[(F.col(f"__o_{k}") + F.col(f"__l_{k}")).alias(k) for k in names])


def row_number(df: DataFrame, order_cols: Sequence[Column], partition_cols: Sequence[str] = (),
               out: str = "rn", num_partitions: int | None = None) -> DataFrame:
    """1-based row number in ``order_cols`` order within each group, distributed."""
    return prefix_sums(df, order_cols, {out: F.lit(1).cast("bigint")}, partition_cols,
                       inclusive=True, num_partitions=num_partitions)


#: Offsets (a row a slice and group) up to which they are broadcast.
OFFSETS = 1 << 17


def written_row_number(df: DataFrame, order_cols: Sequence[Column], partition_cols: Sequence[str] = (),
                       out: str = "rn", num_partitions: int | None = None) -> DataFrame:
    """:func:`row_number` of a large table: its rows are dealt once and written once, compressed and in order.

    A row's place in its slice is written with it. Less the place of its group's first row there, and with the group's
    rows in the slices before, it gives the number: neither rows nor groups are dealt again.
    """
    grp = list(partition_cols)
    order = [F.col(c).asc() for c in grp] + list(order_cols)
    rows = written(df.repartitionByRange(_num_partitions(df, num_partitions), *order).sortWithinPartitions(*order)
                   .withColumn("__at", F.monotonically_increasing_id()))
    # the id is the slice's number above 33 bits of the row's place in it
    stats = rows.groupBy(F.shiftright("__at", 33).alias("__s"), *[F.col(c).alias(f"__g_{c}") for c in grp]) \
        .agg(F.min("__at").alias("__lo"), F.count(F.lit(1)).alias("__c"))
    before = Window.partitionBy(*[f"__g_{c}" for c in grp]).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(stats.select("*", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__o")).drop("__c"))
    if offsets.count() <= OFFSETS:
        offsets = F.broadcast(offsets)
    cond = F.shiftright(rows["__at"], 33) == offsets["__s"]
    for c in grp:
        cond = cond & rows[c].eqNullSafe(offsets[f"__g_{c}"])
    return rows.join(offsets, cond).select(*[rows[c] for c in df.columns],
                                           (F.col("__at") - F.col("__lo") + F.col("__o") + 1).alias(out))
