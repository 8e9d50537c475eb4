"""Registered cleaning / encoding / sampling queries (S1, S4, P*, H*, N*, C1, D1, X*)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import sql_uhash32, uhash32
from ..operators import clean as cl
from ..operators import encode as en
from ..operators import sample as sm
from ..session import scratch_path
from ..sources.tables import Tables
from . import frames

R6 = 6
TOKENS_SQL = "('?', 'NA', '', 'null')"
IMPUTE_COLS = ["n_lines", "price_cents", "o_orderpriority", "c_mktsegment", "urgent_note"]
# Example recode dictionaries for the order frame.
PRIORITY_RANK = {"1-URGENT": 4, "2-HIGH": 3, "3-MEDIUM": 2, "4-NOT SPECIFIED": 1}
SEGMENT_CODE = {"AUTOMOBILE": 1, "BUILDING": 2, "FURNITURE": 3}


def _t(spark, sf):
    return Tables(spark, sf)


def _dirty_norm(spark, sf):
    return cl.normalize_null_tokens(frames.order_risk_dirty(_t(spark, sf)))


SQL_DIRTY_NORM = "SELECT o_orderkey, split, " + ", ".join(
    f"CASE WHEN {c} IN {TOKENS_SQL} THEN NULL ELSE {c} END AS {c}" for c in frames.DIRTY_TEXT_COLS) + \
    f" FROM ({frames.SQL_ORDER_RISK_DIRTY}) d"


# --------------------------------------------------------------------- S1, S4
def q_s1_csv_null_tokens(spark, sf):
    """Write the text frame as CSV to the shared scratch folder, read it back
    with an explicit all-string schema, normalise tokens, count NULLs."""
    d = frames.order_risk_dirty(_t(spark, sf))
    path = scratch_path(spark, f"s1-{uuid.uuid4().hex}")
    d.write.mode("overwrite").option("header", True).csv(path)
    schema = T.StructType([T.StructField("o_orderkey", T.LongType())] +
                          [T.StructField(c, T.StringType()) for c in d.columns[1:]])
    back = spark.read.schema(schema).option("header", True).csv(path)
    norm = cl.normalize_null_tokens(back)
    row = norm.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in frames.DIRTY_TEXT_COLS])
    stack = "stack({n}, {items}) as (col_name, n_null)".format(
        n=len(frames.DIRTY_TEXT_COLS), items=", ".join(f"'{c}', `{c}`" for c in frames.DIRTY_TEXT_COLS))
    return row.selectExpr(stack)


# ------------------------------------------------------------------------- P1
P1_TARGETS = ["status_txt", "urgent_note", "has_R_txt"]


def q_p1_target_split(spark, sf):
    d = _dirty_norm(spark, sf).select("o_orderkey", *P1_TARGETS)
    dec = cl.fit_target_types(d, P1_TARGETS)
    return cl.apply_target_types(d, dec)


# ---------------------------------------------------------------------- P2, P3
def q_p2_drop_trim_columns(spark, sf):
    r = frames.order_risk(_t(spark, sf))
    padded = r.select(F.col("o_orderkey").alias(" o_orderkey"), F.col("n_lines").alias("n_lines "),
                      F.col("qty_sum").alias(" qty_sum "), F.col("o_totalprice").alias("o_totalprice"),
                      F.col("o_orderpriority").alias("o_orderpriority  "))
    return cl.drop_columns(cl.trim_column_names(padded), ["o_totalprice", "not_there"])


# ------------------------------------------------------------------ P4, P5, P6
def q_p4_train_only_filters(spark, sf):
    d = _dirty_norm(spark, sf)
    d = cl.drop_null_rows_train(d, ["n_lines", "c_mktsegment", "absent_col"])
    d = cl.filter_not_equal_train(d, "o_orderpriority", "5-LOW")
    d = cl.filter_not_in_train(d, "n_lines", [1, 2])
    return d.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("o_orderkey").alias("key_sum"))


# ---------------------------------------------------------------------- P7, P8
def q_p7_recode_maps(spark, sf):
    r = frames.order_risk(_t(spark, sf))
    return r.select("o_orderkey", cl.recode("o_orderpriority", PRIORITY_RANK).alias("prio_code"),
                    cl.recode("c_mktsegment", SEGMENT_CODE, default=0).alias("seg_code"))


# ------------------------------------------------------------------------- P9
def _codes(spark, sf):
    r = frames.order_risk_split(_t(spark, sf))
    return r.select("o_orderkey", "split",
                    F.when(F.col("n_supp") > 3, 2).otherwise(1).alias("code_a"),
                    F.when(F.col("n_lines") > 4, 3).when(F.col("n_lines") > 2, 2).otherwise(1).alias("code_b"))


def q_p9_binary_rebase(spark, sf):
    c = _codes(spark, sf)
    rebased = cl.fit_binary_rebase(c.where(F.col("split") == "train"), ["code_a", "code_b"])
    return cl.apply_binary_rebase(c, rebased)


# ------------------------------------------------------------------------ P10
def q_p10_log1p(spark, sf):
    r = frames.order_risk(_t(spark, sf))
    return cl.log1p_columns(r.select("o_orderkey", "price_sum"), ["price_sum"]) \
        .select("o_orderkey", F.round("price_sum", R6).alias("log_price"))


# ------------------------------------------------------------------------ P11
def _codes_col():
    num = (F.col("p_partkey") * 37) % 1000
    dec = F.col("p_size") % 10
    return F.when(F.col("p_brand").endswith("1"), F.concat(F.lit("V"), num.cast("string"))) \
        .when(F.col("p_brand").endswith("2"), F.concat(F.lit("E"), num.cast("string"))) \
        .when(F.col("p_size") == 50, F.lit("n/a")) \
        .otherwise(F.concat(num.cast("string"), F.lit("."), dec.cast("string")))


def q_p11_code_groups(spark, sf):
    p = _t(spark, sf).part
    return p.select(cl.code_group(_codes_col()).alias("code_group")) \
        .groupBy("code_group").agg(F.count(F.lit(1)).alias("n"))


SQL_CODES = """CASE WHEN p_brand LIKE '%1' THEN 'V' || cast((p_partkey * 37) % 1000 AS varchar)
                    WHEN p_brand LIKE '%2' THEN 'E' || cast((p_partkey * 37) % 1000 AS varchar)
                    WHEN p_size = 50 THEN 'n/a'
                    ELSE cast((p_partkey * 37) % 1000 AS varchar) || '.' || cast(p_size % 10 AS varchar) END"""


def _sql_code_group(code: str) -> str:
    n = f"try_cast({code} AS double)"
    return f"""CASE WHEN {code} IS NULL OR {code} LIKE 'V%' OR {code} LIKE 'E%' OR {n} IS NULL OR isnan({n}) THEN 'Other'
        WHEN {n} BETWEEN 390 AND 459 OR {n} = 785 THEN 'Circulatory'
        WHEN {n} BETWEEN 460 AND 519 OR {n} = 786 THEN 'Respiratory'
        WHEN {n} BETWEEN 520 AND 579 OR {n} = 787 THEN 'Digestive'
        WHEN cast({n} AS varchar) LIKE '250%' THEN 'Diabetes'
        WHEN {n} BETWEEN 800 AND 999 THEN 'Injury'
        WHEN {n} BETWEEN 710 AND 739 THEN 'Musculoskeletal'
        WHEN {n} BETWEEN 580 AND 629 OR {n} = 788 THEN 'Genitourinary'
        WHEN {n} BETWEEN 140 AND 239 THEN 'Neoplasms'
        ELSE 'Other' END"""


# ------------------------------------------------------------------------ P12
def q_p12_binarise_label(spark, sf):
    r = frames.order_risk(_t(spark, sf))
    return r.select("o_orderkey",
                    cl.binarise_equals("o_orderstatus", "F").alias("status_bin"),
                    cl.binarise_in(F.col("n_lines").cast("double"), [3, 4]).alias("stage_bin"),
                    cl.binarise_map(F.concat(F.lit(" "), F.col("o_orderpriority"), F.lit("  ")),
                                    {"1-URGENT": 1, "2-HIGH": 1}).alias("map_bin"))


# ------------------------------------------------------------------------ P13
def q_p13_coerce_fill(spark, sf):
    d = frames.order_risk_dirty(_t(spark, sf)).select("o_orderkey", "n_lines", "price_cents",
                                                       "urgent_note", "o_orderpriority")
    return cl.coerce_fill(d, keep=["o_orderkey"])


# ------------------------------------------------------------------------ P14
def q_p14_align_columns(spark, sf):
    r = frames.order_risk_split(_t(spark, sf))
    test = r.where(F.col("split") == "test").select("o_orderkey", "n_lines", "qty_sum",
                                                    F.lit(1.0).alias("zz_extra"))
    train = r.where(F.col("split") == "train").select("n_lines", "price_sum", "qty_sum")
    return cl.align_columns(test, train, keep=["o_orderkey"])


# ------------------------------------------------------------------- P16, P17
def q_p17_or_label_gate(spark, sf):
    r = frames.order_risk_split(_t(spark, sf))
    g = r.select("o_orderkey", "split", cl.or_label(["has_R", "has_A"]).alias("gate"),
                 ((frames.linear_margin("has_R") >= 0) | (frames.linear_margin("has_A") >= 0))
                 .cast("int").alias("gate_pred"))
    sel = cl.gate_rows(g, "gate", "gate_pred")
    return sel.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("o_orderkey").alias("key_sum"))


# --------------------------------------------------------------------- H1, H2
def q_h1_promote_and_drop(spark, sf):
    train = _dirty_norm(spark, sf).where(F.col("split") == "train")
    dec = en.imputer_decisions(train, IMPUTE_COLS)
    return dec.select("position", F.col("column").alias("col_name"),
                      F.round("unparsable_share", R6).alias("unparsable_share"),
                      F.round("null_share", R6).alias("null_share"),
                      F.col("promoted").cast("int").alias("promoted"), F.col("kept").cast("int").alias("kept"))


# --------------------------------------------------------------------- H3, H4
def q_h3_impute_mean_mode(spark, sf):
    d = _dirty_norm(spark, sf)
    fitted = en.fit_imputer(d.where(F.col("split") == "train"), IMPUTE_COLS)
    out = en.apply_imputer(d, fitted, passthrough=["o_orderkey", "split"])
    return out.select(*[F.round(c, R6).alias(c) if c in fitted.means else F.col(c) for c in out.columns])


# --------------------------------------------------------------------- N1, N2
def q_n2_one_hot(spark, sf):
    r = frames.order_risk_split(_t(spark, sf))
    base = r.select("o_orderkey", "o_orderpriority", "c_mktsegment")
    lv = en.fit_levels(r.where(F.col("split") == "train"), ["o_orderpriority", "c_mktsegment"])
    all_levels = en.one_hot(base.drop("c_mktsegment"), {"o_orderpriority": lv["o_orderpriority"]})
    first_dropped = en.one_hot(base.select("o_orderkey", "c_mktsegment"),
                               {"c_mktsegment": lv["c_mktsegment"]}, drop_first=True)
    return all_levels.join(first_dropped, "o_orderkey")


# ------------------------------------------------------------------------- N3
def q_n3_label_encode(spark, sf):
    c = _t(spark, sf).customer
    codes = en.label_codes(c, "c_mktsegment", out="code")
    return en.apply_label_codes(c.select("c_custkey", "c_mktsegment"), "c_mktsegment", codes)


def q_n3_label_encode_numeric(spark, sf):
    p = _t(spark, sf).part
    codes = en.label_codes(p, "p_size", out="code")
    return en.apply_label_codes(p.select("p_partkey", "p_size"), "p_size", codes)


# ------------------------------------------------------------------------- C1
C1_COLS = frames.ORDER_NUMERIC + ["const_one"]


def q_c1_correlated_drop(spark, sf):
    r = frames.order_risk_split(_t(spark, sf)).withColumn("const_one", F.lit(1.0))
    tab = en.correlated_drop_table(r.where(F.col("split") == "train"), C1_COLS)
    return tab.select("position", F.col("column").alias("col_name"),
                      F.round("max_earlier_abs_r", R6).alias("max_earlier_abs_r"),
                      F.col("kept").cast("int").alias("kept"))


# ------------------------------------------------------------------------- D1
def q_d1_quantile_labels(spark, sf):
    r = frames.order_risk_split(_t(spark, sf))
    cols = frames.ORDER_NUMERIC
    fitted = en.fit_quantile_bins(r.where(F.col("split") == "train"), cols)
    binned = en.apply_quantile_bins(r.select("o_orderkey", *cols), fitted)
    done = [c for c in cols if c in fitted.edges]
    if not done:
        return binned.select("o_orderkey", F.lit(None).cast("string").alias("col_name"),
                             F.lit(None).cast("string").alias("label")).where(F.lit(False))
    return binned.select("o_orderkey", F.explode(F.array(*[
        F.struct(F.lit(c).alias("col_name"), F.col(c).alias("label")) for c in done])).alias("e")) \
        .select("o_orderkey", "e.col_name", "e.label")


# ------------------------------------------------------------------------- X*
def q_x1_exact_downsample(spark, sf):
    r = frames.order_risk(_t(spark, sf)).select("o_orderkey")
    return sm.exact_downsample(r, "o_orderkey", 2500, seed=42)


def q_x2_stratified_split(spark, sf):
    r = frames.order_risk(_t(spark, sf)).select("o_orderkey", "o_orderstatus")
    s = sm.stratified_split(r, "o_orderkey", "o_orderstatus", seed=42)
    return s.groupBy("o_orderstatus", "split").agg(F.count(F.lit(1)).alias("n"),
                                                   F.sum("o_orderkey").alias("key_sum"))


def q_x3_hash_split(spark, sf):
    r = frames.order_risk(_t(spark, sf)).select("o_orderkey")
    return r.withColumn("split", sm.hash_split("o_orderkey", 42, 0.3)) \
        .groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("key_sum"))


def q_x4_contiguous_ids(spark, sf):
    r = frames.order_risk_split(_t(spark, sf)).select("o_orderkey", "split")
    order = [F.when(F.col("split") == "train", 0).otherwise(1).asc(), F.col("o_orderkey").asc()]
    return sm.contiguous_ids(r, order, out="new_id")


QUERIES = {
    "s1_csv_null_tokens": q_s1_csv_null_tokens,
    "p1_target_split": q_p1_target_split,
    "p2_drop_trim_columns": q_p2_drop_trim_columns,
    "p4_train_only_filters": q_p4_train_only_filters,
    "p7_recode_maps": q_p7_recode_maps,
    "p9_binary_rebase": q_p9_binary_rebase,
    "p10_log1p": q_p10_log1p,
    "p11_code_groups": q_p11_code_groups,
    "p12_binarise_label": q_p12_binarise_label,
    "p13_coerce_fill": q_p13_coerce_fill,
    "p14_align_columns": q_p14_align_columns,
    "p17_or_label_gate": q_p17_or_label_gate,
    "h1_promote_and_drop": q_h1_promote_and_drop,
    "h3_impute_mean_mode": q_h3_impute_mean_mode,
    "n2_one_hot": q_n2_one_hot,
    "n3_label_encode": q_n3_label_encode,
    "n3_label_encode_numeric": q_n3_label_encode_numeric,
    "c1_correlated_drop": q_c1_correlated_drop,
    "d1_quantile_labels": q_d1_quantile_labels,
    "x1_exact_downsample": q_x1_exact_downsample,
    "x2_stratified_split": q_x2_stratified_split,
    "x3_hash_split": q_x3_hash_split,
    "x4_contiguous_ids": q_x4_contiguous_ids,
}

# ----------------------------------------------------------------- oracles
_OR = f"order_risk AS ({frames.SQL_ORDER_RISK})"
_ORS = f"order_risk_split AS ({frames.SQL_ORDER_RISK_SPLIT})"
_DN = f"dn AS ({SQL_DIRTY_NORM})"


def _h1_sql():
    parts = []
    for i, c in enumerate(IMPUTE_COLS):
        parts.append(f"""SELECT {i} AS position, '{c}' AS col_name,
               avg(CASE WHEN try_cast({c} AS double) IS NULL THEN 1.0 ELSE 0.0 END) AS u,
               avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS nn FROM dn WHERE split = 'train'""")
    return f"""WITH {_DN}, d AS ({' UNION ALL '.join(parts)}),
        e AS (SELECT *, u < 0.5 AS promoted, CASE WHEN u < 0.5 THEN u ELSE nn END AS null_share FROM d)
        SELECT position, col_name, round(u, {R6}) AS unparsable_share, round(null_share, {R6}) AS null_share,
               cast(promoted AS integer) AS promoted, cast(null_share <= 0.5 AS integer) AS kept FROM e"""


def _mode_sql(c):
    return f"""(SELECT {c} FROM dn WHERE split = 'train' AND {c} IS NOT NULL
                GROUP BY {c} ORDER BY count(*) DESC, {c} ASC LIMIT 1)"""


_H3_SQL = f"""WITH {_DN},
    m AS (SELECT avg(try_cast(n_lines AS double)) AS m_n, avg(try_cast(price_cents AS double)) AS m_p
          FROM dn WHERE split = 'train')
    SELECT o_orderkey, split,
           round(coalesce(try_cast(n_lines AS double), m.m_n), {R6}) AS n_lines,
           round(coalesce(try_cast(price_cents AS double), m.m_p), {R6}) AS price_cents,
           coalesce(o_orderpriority, {_mode_sql('o_orderpriority')}) AS o_orderpriority,
           coalesce(c_mktsegment, {_mode_sql('c_mktsegment')}) AS c_mktsegment
    FROM dn, m"""


def _c1_sql():
    cols = C1_COLS
    parts = []
    for j in range(len(cols)):
        for i in range(j):
            a, b = cols[i], cols[j]
            parts.append(f"""SELECT {i} AS i, {j} AS j,
                covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0) AS r FROM tr""")
    names = " UNION ALL ".join(f"SELECT {k} AS position, '{c}' AS col_name" for k, c in enumerate(cols))
    return f"""WITH {_ORS}, tr AS (SELECT *, 1.0::DOUBLE AS const_one FROM order_risk_split WHERE split = 'train'),
        ct AS ({' UNION ALL '.join(parts)}),
        mx AS (SELECT j AS position, max(abs(r)) AS mx FROM ct GROUP BY j),
        nm AS ({names})
        SELECT nm.position, nm.col_name, round(mx.mx, {R6}) AS max_earlier_abs_r,
               cast(NOT coalesce(mx.mx > 0.9, false) AS integer) AS kept
        FROM nm LEFT JOIN mx USING (position)"""


def _d1_sql():
    cols = frames.ORDER_NUMERIC
    fits = " UNION ALL ".join(
        f"""SELECT '{c}' AS col_name, count(DISTINCT {c}) AS d,
                   list_sort(list_distinct(quantile_cont({c}, [0.0, 0.25, 0.5, 0.75, 1.0]))) AS u
            FROM order_risk_split WHERE split = 'train'""" for c in cols)
    vals = " UNION ALL ".join(f"SELECT o_orderkey, '{c}' AS col_name, {c}::DOUBLE AS x FROM order_risk_split"
                              for c in cols)
    return f"""WITH {_ORS}, fit AS ({fits}), v AS ({vals})
        SELECT v.o_orderkey, v.col_name,
               CASE WHEN v.x IS NULL THEN NULL
                    ELSE (['Low', 'Mid', 'High', 'VeryHigh'])[1 + len(list_filter(f.u[2:len(f.u) - 1], lambda e: v.x > e))]
               END AS label
        FROM v JOIN fit f USING (col_name)
        WHERE f.d > 10 AND len(f.u) - 1 >= 2"""


_X2_SQL = f"""WITH {_OR},
    cls AS (SELECT o_orderstatus, count(*) AS c FROM order_risk GROUP BY ALL),
    tot AS (SELECT sum(c) AS n, ceil(0.3::DOUBLE * sum(c)) AS nt FROM cls),
    al AS (SELECT o_orderstatus, floor(nt * c / n) AS base, nt * c / n - floor(nt * c / n) AS frac, nt FROM cls, tot),
    al2 AS (SELECT *, row_number() OVER (ORDER BY frac DESC, o_orderstatus) AS rr,
                   nt - sum(base) OVER () AS rest FROM al),
    alloc AS (SELECT o_orderstatus, base + CASE WHEN rr <= rest THEN 1 ELSE 0 END AS t FROM al2),
    rk AS (SELECT o_orderkey, o_orderstatus,
                  row_number() OVER (PARTITION BY o_orderstatus ORDER BY {sql_uhash32(42, 'o_orderkey')}, o_orderkey) AS rk
           FROM order_risk)
    SELECT rk.o_orderstatus, CASE WHEN rk.rk <= alloc.t THEN 'test' ELSE 'train' END AS split,
           count(*) AS n, sum(o_orderkey) AS key_sum
    FROM rk JOIN alloc USING (o_orderstatus) GROUP BY ALL"""

ORACLES = {
    "s1_csv_null_tokens": f"WITH d AS ({frames.SQL_ORDER_RISK_DIRTY}) " + " UNION ALL ".join(
        f"SELECT '{c}' AS col_name, count(*) FILTER (WHERE {c} IS NULL OR {c} IN {TOKENS_SQL}) AS n_null FROM d"
        for c in frames.DIRTY_TEXT_COLS),
    "p1_target_split": f"""WITH {_DN} SELECT o_orderkey, status_txt,
        cast(coalesce(try_cast(urgent_note AS double), 0) AS bigint) AS urgent_note, has_R_txt FROM dn""",
    "p2_drop_trim_columns": f"WITH {_OR} SELECT o_orderkey, n_lines, qty_sum, o_orderpriority FROM order_risk",
    "p4_train_only_filters": f"""WITH {_DN} SELECT split, count(*) AS n_rows, sum(o_orderkey) AS key_sum FROM dn
        WHERE split <> 'train' OR (n_lines IS NOT NULL AND c_mktsegment IS NOT NULL
              AND o_orderpriority IS DISTINCT FROM '5-LOW'
              AND NOT coalesce(try_cast(n_lines AS double) IN (1.0, 2.0), false))
        GROUP BY split""",
    "p7_recode_maps": f"""WITH {_OR} SELECT o_orderkey,
        CASE o_orderpriority WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 3 WHEN '3-MEDIUM' THEN 2
             WHEN '4-NOT SPECIFIED' THEN 1 END AS prio_code,
        coalesce(CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'FURNITURE' THEN 3 END, 0) AS seg_code
        FROM order_risk""",
    "p9_binary_rebase": f"""WITH {_ORS}, c AS (SELECT o_orderkey, split,
            CASE WHEN n_supp > 3 THEN 2 ELSE 1 END AS code_a,
            CASE WHEN n_lines > 4 THEN 3 WHEN n_lines > 2 THEN 2 ELSE 1 END AS code_b FROM order_risk_split),
        mx AS (SELECT max(code_a) AS ma, max(code_b) AS mb FROM c WHERE split = 'train')
        SELECT o_orderkey, split, CASE WHEN ma = 2 THEN code_a - 1 ELSE code_a END AS code_a,
               CASE WHEN mb = 2 THEN code_b - 1 ELSE code_b END AS code_b FROM c, mx""",
    "p10_log1p": f"WITH {_OR} SELECT o_orderkey, round(ln(1 + price_sum), {R6}) AS log_price FROM order_risk",
    "p11_code_groups": f"""SELECT {_sql_code_group('code')} AS code_group, count(*) AS n
        FROM (SELECT {SQL_CODES} AS code FROM part) x GROUP BY 1""",
    "p12_binarise_label": f"""WITH {_OR} SELECT o_orderkey,
        CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS status_bin,
        CASE WHEN n_lines IN (3, 4) THEN 1 ELSE 0 END AS stage_bin,
        CASE WHEN trim(' ' || o_orderpriority || '  ') IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS map_bin
        FROM order_risk""",
    "p13_coerce_fill": f"""SELECT o_orderkey,
        coalesce(try_cast(n_lines AS double), 0.0) AS n_lines,
        coalesce(try_cast(price_cents AS double), 0.0) AS price_cents,
        coalesce(try_cast(urgent_note AS double), 0.0) AS urgent_note,
        coalesce(try_cast(o_orderpriority AS double), 0.0) AS o_orderpriority
        FROM ({frames.SQL_ORDER_RISK_DIRTY}) d""",
    "p14_align_columns": f"""WITH {_ORS} SELECT o_orderkey, n_lines, 0.0::DOUBLE AS price_sum, qty_sum
        FROM order_risk_split WHERE split = 'test'""",
    "p17_or_label_gate": f"""WITH {_ORS}, g AS (SELECT o_orderkey, split, greatest(has_R, has_A) AS gate,
            cast({frames.sql_linear_margin('has_R')} >= 0 OR {frames.sql_linear_margin('has_A')} >= 0 AS integer) AS gate_pred
            FROM order_risk_split)
        SELECT split, count(*) AS n_rows, sum(o_orderkey) AS key_sum FROM g
        WHERE CASE WHEN split = 'train' THEN gate = 1 ELSE gate_pred = 1 END GROUP BY split""",
    "h1_promote_and_drop": _h1_sql(),
    "h3_impute_mean_mode": _H3_SQL,
    "n2_one_hot": None,  # filled below (level names are data-derived)
    "n3_label_encode": """SELECT c_custkey, c_mktsegment,
        cast(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS integer) AS code FROM customer""",
    "n3_label_encode_numeric": """SELECT p_partkey, p_size,
        cast(dense_rank() OVER (ORDER BY p_size) - 1 AS integer) AS code FROM part""",
    "c1_correlated_drop": _c1_sql(),
    "d1_quantile_labels": _d1_sql(),
    "x1_exact_downsample": f"""WITH {_OR} SELECT o_orderkey FROM order_risk
        ORDER BY {sql_uhash32(42, 'o_orderkey')}, o_orderkey LIMIT 2500""",
    "x2_stratified_split": _X2_SQL,
    "x3_hash_split": f"""WITH {_OR} SELECT {frames.sql_split('o_orderkey')} AS split, count(*) AS n,
        sum(o_orderkey) AS key_sum FROM order_risk GROUP BY 1""",
    "x4_contiguous_ids": f"""WITH {_ORS} SELECT o_orderkey, split,
        row_number() OVER (ORDER BY CASE WHEN split = 'train' THEN 0 ELSE 1 END, o_orderkey) - 1 AS new_id
        FROM order_risk_split""",
}

# One-hot oracle: the level lists are the train levels of two fixed
# low-cardinality columns (5 priorities, 5 segments).
PRIORITY_LEVELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
SEGMENT_LEVELS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
ORACLES["n2_one_hot"] = f"WITH {_ORS} SELECT o_orderkey, " + ", ".join(
    [f"CASE WHEN o_orderpriority = '{v}' THEN 1 ELSE 0 END AS \"o_orderpriority_{v}\"" for v in PRIORITY_LEVELS] +
    [f"CASE WHEN c_mktsegment = '{v}' THEN 1 ELSE 0 END AS \"c_mktsegment_{v}\"" for v in SEGMENT_LEVELS[1:]]) + \
    " FROM order_risk_split"
