"""Embedding columns as packed bytes (helper of the vector operators)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shipping import ship


def pack(col: pa.Array) -> list:
    """Each row's little-endian bytes, or None where the vector is null, empty, zero or not wholly finite."""
    n = len(col)
    if n == 0:
        return []
    size = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(col)
    v = flat.to_numpy(zero_copy_only=False)  # null components come as NaN
    if v.dtype != np.float32:
        v = v.astype(np.float64)
    at = np.concatenate([[0], np.cumsum(size)])
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(v))])
    some = np.concatenate([[0], np.cumsum(v != 0)])
    ok = (size > 0) & (bad[at[1:]] == bad[at[:-1]]) & (some[at[1:]] > some[at[:-1]])
    raw, w = v.tobytes(), v.dtype.itemsize
    return [raw[w * at[i]:w * at[i + 1]] if ok[i] else None for i in range(n)]


def packed(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, np.dtype]:
    """``(vec_id, dim, raw)`` per row; ``dim`` and ``raw`` are null for vectors that take no part."""
    ship(vectors.sparkSession)
    item = vectors.schema[vector_col].dataType
    single = getattr(item, "elementType", None) is not None and item.elementType.typeName() == "float"
    dtype = np.dtype("<f4" if single else "<f8")

    def run(batches):
        for b in batches:
            raw = pack(b.column(1))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([None if r is None else len(r) // dtype.itemsize for r in raw], pa.int32()),
                 pa.array(raw, pa.binary())], names=["vec_id", "dim", "raw"])

    cast = "array<float>" if single else "array<double>"
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(cast).alias("v")) \
        .mapInArrow(run, "vec_id long, dim int, raw binary"), dtype


def matrix(raw: list, dtype: np.dtype, dim: int) -> np.ndarray:
    """Packed rows as a double matrix."""
    return np.frombuffer(b"".join(raw), dtype).reshape(len(raw), dim).astype(np.float64)
