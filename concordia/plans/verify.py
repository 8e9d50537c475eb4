"""Side-by-side check of a registered query against its DuckDB oracle."""

from __future__ import annotations

import hashlib
import math
import os

from ..sources.tables import TABLES


def duckdb_connection(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        return repr(round(v, 9))
    if hasattr(v, "item"):
        return _norm(v.item())
    return str(v)


def frame_digest(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines


def compare(spark, name, fn, sql, sf_dir, con=None, show=5):
    df = fn(spark, sf_dir)
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    con = con or duckdb_connection(sf_dir)
    rel = con.sql(sql)
    d_cols = list(rel.columns)
    d_rows = rel.fetchall()
    out = {"name": name, "spark_rows": len(s_rows), "oracle_rows": len(d_rows),
           "schema_match": sorted(s_cols) == sorted(d_cols)}
    hs, ls = frame_digest(s_cols, s_rows)
    hd, ld = frame_digest(d_cols, d_rows)
    out["value_match"] = hs == hd
    if not out["value_match"] or not out["schema_match"]:
        out["spark_cols"] = s_cols
        out["oracle_cols"] = d_cols
        diff_s = [x for x in ls if x not in set(ld)][:show]
        diff_d = [x for x in ld if x not in set(ls)][:show]
        out["only_spark"] = diff_s
        out["only_oracle"] = diff_d
    return out
