"""Sampling and splitting (X1-X4) driven by the portable hash.

Random choices are functions of (seed, key), so a rerun, a retried task or
the SQL oracle reproduce exactly the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import TWO_32, uhash32
from ..functions.ordering import row_number
from ..functions.selection import with_smallest


def hash_split(key: str, seed: int = 42, test_share: float = 0.3,
               train_value: str = "train", test_value: str = "test") -> Column:
    """Unstratified split by hash threshold (no sort, no shuffle)."""
    return F.when(uhash32(seed, key) < F.lit(int(test_share * TWO_32)), F.lit(test_value)) \
        .otherwise(F.lit(train_value))


def exact_downsample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (all if fewer), chosen by smallest hash: the n-th one is found by range refinement,
    then rows are filtered; nothing is sorted."""
    return with_smallest(df, key, lambda sizes: dict.fromkeys(sizes, n), seed=seed).where("__chosen").drop("__chosen")


def test_shares(sizes: dict, test_share: float) -> dict:
    """Test rows per class: ``ceil(test_share * n)`` in all; of the proportional shares the whole part, the rest by
    largest fraction (ties by class value, null first)."""
    n = sum(sizes.values())
    total = math.ceil(test_share * n)
    share = {c: float(total) * k / n for c, k in sizes.items()}
    out = {c: math.floor(v) for c, v in share.items()}
    order = sorted(sorted(sizes, key=lambda c: (c is not None, c if c is not None else 0)),
                   key=lambda c: out[c] - share[c])
    for c in order[:total - sum(out.values())]:
        out[c] += 1
    return out


def stratified_split(df: DataFrame, key: str, label: str, seed: int = 42,
                     test_share: float = 0.3, out: str = "split") -> DataFrame:
    """Stratified split with exact test total ceil(test_share * n).

    A class's test rows are those of its smallest hashes; the last one's hash is
    found by range refinement for all classes at once, and one comparison a row
    tells the split. A null label is a class of its own.
    """
    got = with_smallest(df, key, lambda sizes: test_shares(sizes, test_share), label, seed)
    return got.withColumn(out, F.when(F.col("__chosen"), F.lit("test")).otherwise(F.lit("train"))).drop("__chosen")


def contiguous_ids(df: DataFrame, order_cols: Sequence[Column], out: str = "new_id") -> DataFrame:
    """0-based contiguous numbering in a total order, computed with
    range partitions plus per-partition offsets (no single-task sort)."""
    return row_number(df, order_cols, out="__rn").withColumn(out, F.col("__rn") - 1).drop("__rn")
