"""ARFF source and sink (S2) on top of Spark's text reader/writer.

The header lines (``@relation``, ``@attribute``, ``@data``) are the only
thing brought to the driver - one short line per column - to build the
``StructType``; data lines are parsed on the executors with ``from_csv``.
Nominal attributes are read as STRING, numeric ones as DOUBLE, ``?`` as NULL.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ATTR = re.compile(r"^@attribute\s+('([^']*)'|\"([^\"]*)\"|(\S+))\s+(.+)$", re.IGNORECASE)


def _arff_type(spec: str) -> T.DataType:
    s = spec.strip()
    if s.startswith("{"):
        return T.StringType()
    low = s.lower()
    if low in ("numeric", "real", "integer"):
        return T.DoubleType()
    return T.StringType()


def parse_header(lines: list[str]) -> T.StructType:
    fields = []
    for line in lines:
        m = _ATTR.match(line.strip())
        if m:
            name = m.group(2) or m.group(3) or m.group(4)
            fields.append(T.StructField(name, _arff_type(m.group(5))))
    return T.StructType(fields)


def read_arff(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.text(path)
    trimmed = F.trim("value")
    header = text.where(F.lower(trimmed).startswith("@attribute")) \
        .select(trimmed.alias("line"), F.input_file_name().alias("f")).collect()  # one line per column
    seen, lines = set(), []
    for r in header:  # a directory may repeat the header per part file
        if r["line"] not in seen:
            seen.add(r["line"])
            lines.append(r["line"])
    schema = parse_header(lines)
    data = text.where((F.length(trimmed) > 0) & ~trimmed.startswith("@") & ~trimmed.startswith("%"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    parsed = data.select(F.from_csv(F.col("value"), ddl, {"nullValue": "?", "quote": "'", "escape": "\\"}).alias("r"))
    return parsed.select("r.*")


def _text_cell(c):
    """Quoted, with backslashes and quotes escaped; line breaks have no form in a line-based file."""
    text = F.regexp_replace(c.cast("string"), r"([\\'])", r"\\$1")
    return F.concat(F.lit("'"), F.translate(text, "\r\n", "  "), F.lit("'"))


def write_arff(df: DataFrame, path: str, relation: str = "data") -> None:
    """Header as the first part file, data lines after it."""
    spark = df.sparkSession
    head = [f"@relation {relation}"]
    for f in df.schema.fields:
        kind = "numeric" if isinstance(f.dataType, T.NumericType) else "string"
        head.append(f"@attribute '{f.name}' {kind}")
    head.append("@data")
    header = spark.createDataFrame([(h,) for h in head], "value string").coalesce(1)
    cells = [F.coalesce(F.col(f.name).cast("string"), F.lit("?")) if isinstance(f.dataType, T.NumericType)
             else F.coalesce(_text_cell(F.col(f.name)), F.lit("?"))
             for f in df.schema.fields]
    body = df.select(F.concat_ws(",", *cells).alias("value"))
    header.unionByName(body).write.mode("overwrite").text(path)
