"""Portable, seedable hash used for every random choice in the library.

``uhash32`` takes the first 8 hex digits of ``md5(concat_ws('|', seed, keys...))``
as an unsigned 32-bit integer. The same value is produced in DuckDB by
``cast('0x' || substr(md5(concat_ws('|', ...)), 1, 8) as bigint)``, which lets
the SQL oracle reproduce every split, draw and sample exactly.
Keys must be integers or strings (doubles print differently across engines).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296


def uhash32(seed, *keys) -> Column:
    parts = [F.lit(str(seed))] + [(k if isinstance(k, Column) else F.col(k)).cast("string")
                                  for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("bigint")


def sql_uhash32(seed, *key_sql: str) -> str:
    """DuckDB spelling of :func:`uhash32` for oracle queries."""
    inner = ", ".join([f"'{seed}'"] + [f"cast({k} as varchar)" for k in key_sql])
    return f"cast('0x' || substr(md5(concat_ws('|', {inner})), 1, 8) as bigint)"


# Integer mixer for high-volume draws: an md5 per row seeds it, then every
# (sample, feature) draw costs three square-and-add steps modulo a prime
# below 2^31 (products stay below 2^62, so no overflow under ANSI mode).
# Modulus, step multipliers and round constants.
MIX_MOD = 2147483629
MIX_STEP_SAMPLE = 40503
MIX_STEP_FEATURE = 2654435
MIX_ROUNDS = (12345, 67890, 13579)


def mix31(seed_col: Column, sample, feature) -> Column:
    """Deterministic 31-bit draw from (row seed, sample, feature)."""
    s = sample if isinstance(sample, Column) else F.lit(sample)
    j = feature if isinstance(feature, Column) else F.lit(feature)
    x = (seed_col + s.cast("bigint") * MIX_STEP_SAMPLE + j.cast("bigint") * MIX_STEP_FEATURE) % MIX_MOD
    for c in MIX_ROUNDS:
        x = (x * x + c) % MIX_MOD
    return x


def sql_mix31(seed_sql: str, sample_sql: str, feature_sql: str) -> str:
    x = f"(({seed_sql}) + cast({sample_sql} AS bigint) * {MIX_STEP_SAMPLE} " \
        f"+ cast({feature_sql} AS bigint) * {MIX_STEP_FEATURE}) % {MIX_MOD}"
    for c in MIX_ROUNDS:
        x = f"(({x}) * ({x}) + {c}) % {MIX_MOD}"
    return x


def with_mix31(df, seed_col: str, sample_col: str, n: int, prefix: str = "__u", keep=None):
    """Add ``n`` mixed draws ``<prefix>0..`` as columns, one ``select`` per
    round: every round reads the previous round's column, so the optimizer
    keeps each value computed once instead of inlining the growing
    expression tree into every reference."""
    keep = list(keep or df.columns)
    cur = df.select(*keep, *[((F.col(seed_col) + F.col(sample_col).cast("bigint") * MIX_STEP_SAMPLE
                               + F.lit(j * MIX_STEP_FEATURE)) % MIX_MOD).alias(f"{prefix}{j}") for j in range(n)])
    for c in MIX_ROUNDS:
        cur = cur.select(*keep, *[((F.col(f"{prefix}{j}") * F.col(f"{prefix}{j}") + c) % MIX_MOD)
                                  .alias(f"{prefix}{j}") for j in range(n)])
    return cur


# second stream for the high half of a 62-bit index (fixed value)
MIX_HIGH_OFFSET = 1000003


def draw_index(seed_col: Column, sample, feature, n) -> Column:
    """Index in [0, n) from (row seed, sample, feature): two mixed 31-bit
    streams give a 62-bit value, so background tables of any size are
    reachable. ``seed_col`` is ``uhash32(seed, id) % MIX_MOD`` (one md5/row)."""
    j = feature if isinstance(feature, Column) else F.lit(feature)
    hi = mix31(seed_col, sample, j + F.lit(MIX_HIGH_OFFSET))
    lo = mix31(seed_col, sample, j)
    return (hi * F.lit(MIX_MOD) + lo) % (n if isinstance(n, Column) else F.lit(n))


def sql_draw_index(seed_sql: str, sample_sql: str, feature_sql: str, n_sql: str) -> str:
    hi = sql_mix31(seed_sql, sample_sql, f"({feature_sql}) + {MIX_HIGH_OFFSET}")
    lo = sql_mix31(seed_sql, sample_sql, feature_sql)
    return f"((({hi}) * {MIX_MOD} + ({lo})) % ({n_sql}))"
