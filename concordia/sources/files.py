"""One entry for table files, by their ending."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .arff import read_arff

FORMATS = (".csv", ".arff", ".parquet", ".json")


def load_file(spark: SparkSession, path: str, **options) -> DataFrame:
    """A table by its path's ending: CSV with a header and inferred types, ARFF, Parquet or JSON lines.

    Any other ending is refused before anything is read.
    """
    kind = path.rstrip("/").lower()
    if kind.endswith(".csv"):
        return spark.read.options(**({"header": True, "inferSchema": True} | options)).csv(path)
    if kind.endswith(".arff"):
        return read_arff(spark, path)
    if kind.endswith(".parquet"):
        return spark.read.options(**options).parquet(path)
    if kind.endswith(".json"):
        return spark.read.options(**options).json(path)
    raise ValueError(f"unsupported format: {path}; use one of {', '.join(FORMATS)}")
