"""Analysis frames derived from the driver tables, in Spark and in SQL.

Each frame has a Spark builder (used by the library queries) and an
equivalent SQL CTE (used by the DuckDB oracle). Money and percentages are
summed as integer cents / points and divided once, so both engines produce
bit-identical doubles regardless of summation order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import sql_uhash32, uhash32
from ..session import written
from ..sources.tables import Tables

SPLIT_SEED = 42
TEST_SHARE = 0.3


def _cents(c: str):
    return F.round(F.col(c) * 100).cast("bigint")


# ------------------------------------------------------------- importance
def supplier_region(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", "s_nationkey") \
        .join(t.nation.select("n_nationkey", "n_regionkey"), F.col("s_nationkey") == F.col("n_nationkey")) \
        .join(t.region.select("r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey")) \
        .select("s_suppkey", F.col("r_name").alias("dataset"))


def importance_wide(t: Tables, attribute: str = "brand") -> DataFrame:
    """Four per-attribute measures playing the four explainer methods.

    dataset = supplier region, Target = line status, Attribute = part brand
    (or part key). Rulex = line count (has ties), SHAP = quantity,
    LIME = revenue, Ablation = mean discount in points.
    """
    li = t.lineitem.select("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
                           "l_discount", "l_linestatus")
    attr = F.col("p_brand") if attribute == "brand" else F.col("p_partkey").cast("string")
    part = t.part.select("p_partkey", attr.alias("Attribute"))
    j = li.join(part, F.col("l_partkey") == F.col("p_partkey")) \
        .join(supplier_region(t), F.col("l_suppkey") == F.col("s_suppkey"))
    return j.groupBy("dataset", F.col("l_linestatus").alias("Target"), "Attribute").agg(
        F.count(F.lit(1)).cast("double").alias("Rulex"),
        F.sum("l_quantity").alias("SHAP"),
        (F.sum(_cents("l_extendedprice")) / F.lit(100.0)).alias("LIME"),
        (F.sum(_cents("l_discount")) / (F.lit(100.0) * F.count(F.lit(1)))).alias("Ablation"),
    )


def sql_importance_wide(attribute: str = "brand") -> str:
    attr = "p.p_brand" if attribute == "brand" else "cast(p.p_partkey as varchar)"
    return f"""
    SELECT r.r_name AS dataset, l.l_linestatus AS Target, {attr} AS Attribute,
           cast(count(*) AS double) AS Rulex,
           sum(l.l_quantity) AS SHAP,
           cast(sum(cast(round(l.l_extendedprice * 100) AS bigint)) AS double) / 100 AS LIME,
           cast(sum(cast(round(l.l_discount * 100) AS bigint)) AS double) / (100 * cast(count(*) AS double)) AS Ablation
    FROM lineitem l
    JOIN part p ON l.l_partkey = p.p_partkey
    JOIN supplier s ON l.l_suppkey = s.s_suppkey
    JOIN nation n ON s.s_nationkey = n.n_nationkey
    JOIN region r ON n.n_regionkey = r.r_regionkey
    GROUP BY 1, 2, 3"""


def sql_importance_long(attribute: str = "brand") -> str:
    return f"""
    SELECT dataset, coalesce(cast(Target AS varchar), 'Single_Target') AS target,
           cast(Attribute AS varchar) AS attribute, method, value
    FROM ({sql_importance_wide(attribute)}) w
    UNPIVOT (value FOR method IN (Rulex, SHAP, LIME, Ablation))"""


# ------------------------------------------------------------- order_risk
#: Slices of the order key in which a large order frame is written, and the lines from which on it is.
SLICES = 4
SLICED_LINES = 4_000_000


def _in_slice(key: str, part: int | None):
    """Whether a key belongs to slice ``part``; null keys belong to one as well. No slice: all do."""
    return F.lit(True) if part is None else F.pmod(F.hash(F.col(key).cast("bigint")), F.lit(SLICES)) == part


def line_stats(t: Tables, part: int | None = None) -> DataFrame:
    # dealt by order once, as they are; suppliers are then counted by grouping twice where the lines lie (sets would be
    # kept as objects, and a distinct count would shuffle the lines by (order, supplier) and again by order)
    li = t.lineitem.where(_in_slice("l_orderkey", part)).select(
        "l_orderkey", "l_suppkey", "l_quantity", _cents("l_extendedprice").alias("price"), _cents("l_discount").alias("disc"),
        _cents("l_tax").alias("tax"), "l_returnflag").repartition("l_orderkey")
    each = li.groupBy("l_orderkey", "l_suppkey").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in ("l_quantity", "price", "disc", "tax")],
        *[F.max((F.col("l_returnflag") == f).cast("int")).alias(f"has_{f}") for f in "RAN"])
    n = F.sum("n")
    return each.groupBy("l_orderkey").agg(
        n.alias("n_lines"),
        F.sum("l_quantity").alias("qty_sum"),
        (F.sum("price") / F.lit(100.0)).alias("price_sum"),
        (F.sum("disc") / (F.lit(100.0) * n)).alias("disc_avg"),
        (F.sum("tax") / (F.lit(100.0) * n)).alias("tax_avg"),
        F.count("l_suppkey").alias("n_supp"),
        *[F.max(f"has_{f}").alias(f"has_{f}") for f in "RAN"],
    )


ORDER_NUMERIC = ["n_lines", "qty_sum", "price_sum", "disc_avg", "tax_avg", "n_supp", "o_totalprice"]
ORDER_CATEGORICAL = ["o_orderpriority", "c_mktsegment"]


def order_risk(t: Tables, part: int | None = None) -> DataFrame:
    """One row per order; orders without lines get zero line statistics. ``part``: only the orders of that slice."""
    o = t.orders.where(_in_slice("o_orderkey", part)).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    c = t.customer.select("c_custkey", "c_mktsegment")
    # customers before lines, so that only the orders' own columns are dealt by customer
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left") \
        .join(line_stats(t, part), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return j.select(
        "o_orderkey",
        F.coalesce("n_lines", F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce("qty_sum", F.lit(0.0)).alias("qty_sum"),
        F.coalesce("price_sum", F.lit(0.0)).alias("price_sum"),
        F.coalesce("disc_avg", F.lit(0.0)).alias("disc_avg"),
        F.coalesce("tax_avg", F.lit(0.0)).alias("tax_avg"),
        F.coalesce("n_supp", F.lit(0)).cast("bigint").alias("n_supp"),
        "o_totalprice", "o_orderpriority", "c_mktsegment",
        (F.col("o_orderstatus") == "F").cast("int").alias("y"),
        F.coalesce("has_R", F.lit(0)).alias("has_R"),
        F.coalesce("has_A", F.lit(0)).alias("has_A"),
        F.coalesce("has_N", F.lit(0)).alias("has_N"),
        "o_orderstatus",
    )


SQL_ORDER_RISK = """
    SELECT o.o_orderkey,
           cast(coalesce(l.n_lines, 0) AS bigint) AS n_lines,
           coalesce(l.qty_sum, 0.0::double) AS qty_sum,
           coalesce(l.price_sum, 0.0::double) AS price_sum,
           coalesce(l.disc_avg, 0.0::double) AS disc_avg,
           coalesce(l.tax_avg, 0.0::double) AS tax_avg,
           cast(coalesce(l.n_supp, 0) AS bigint) AS n_supp,
           o.o_totalprice, o.o_orderpriority, c.c_mktsegment,
           CASE WHEN o.o_orderstatus = 'F' THEN 1 ELSE 0 END AS y,
           coalesce(l.has_R, 0) AS has_R, coalesce(l.has_A, 0) AS has_A, coalesce(l.has_N, 0) AS has_N,
           o.o_orderstatus
    FROM orders o
    LEFT JOIN (
        SELECT l_orderkey, count(*) AS n_lines, sum(l_quantity) AS qty_sum,
               cast(sum(cast(round(l_extendedprice * 100) AS bigint)) AS double) / 100 AS price_sum,
               cast(sum(cast(round(l_discount * 100) AS bigint)) AS double) / (100 * cast(count(*) AS double)) AS disc_avg,
               cast(sum(cast(round(l_tax * 100) AS bigint)) AS double) / (100 * cast(count(*) AS double)) AS tax_avg,
               count(DISTINCT l_suppkey) AS n_supp,
               max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS has_R,
               max(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS has_A,
               max(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS has_N
        FROM lineitem GROUP BY l_orderkey) l ON o.o_orderkey = l.l_orderkey
    LEFT JOIN customer c ON o.o_custkey = c.c_custkey"""


def split_col(key: str = "o_orderkey", seed: int = SPLIT_SEED, test_share: float = TEST_SHARE):
    """X3 hash split: 'test' when the key's hash falls under test_share * 2^32."""
    return F.when(uhash32(seed, key) < F.lit(int(test_share * 4294967296)), F.lit("test")) \
        .otherwise(F.lit("train"))


def sql_split(key: str = "o_orderkey", seed: int = SPLIT_SEED, test_share: float = TEST_SHARE) -> str:
    return (f"CASE WHEN {sql_uhash32(seed, key)} < {int(test_share * 4294967296)} "
            f"THEN 'test' ELSE 'train' END")


def order_risk_split(t: Tables, part: int | None = None) -> DataFrame:
    return order_risk(t, part).withColumn("split", split_col())


def order_risk_written(t: Tables, *cols) -> DataFrame:
    """``cols`` of :func:`order_risk_split` as a written table, of many lines slice by slice, so that only a slice's
    shuffles are on disk at a time."""
    parts = range(SLICES) if t.lineitem.count() >= SLICED_LINES else [None]
    return written(*[order_risk_split(t, k).select(*cols) for k in parts])


SQL_ORDER_RISK_SPLIT = f"SELECT *, {sql_split()} AS split FROM ({SQL_ORDER_RISK}) r"


def order_risk_dirty(t: Tables) -> DataFrame:
    """Text-typed order frame as if read from a CSV with missing-value tokens.

    Orders without lines have no line statistics at all (natural NULLs); a
    hashed ~7% of cells carry the '?' token, priority uses 'NA', the segment
    sometimes is the empty string, and ``urgent_note`` is mostly missing.
    """
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    c = t.customer.select("c_custkey", "c_mktsegment")
    ls = line_stats(t)
    j = o.join(ls, F.col("o_orderkey") == F.col("l_orderkey"), "left") \
        .join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    h = uhash32("dirty", "o_orderkey") % 100
    return j.select(
        "o_orderkey",
        split_col().alias("split"),
        F.when(h < 7, F.lit("?")).otherwise(F.col("n_lines").cast("string")).alias("n_lines"),
        F.when((h >= 7) & (h < 12), F.lit("?"))
         .otherwise(F.round(F.col("price_sum") * 100).cast("bigint").cast("string")).alias("price_cents"),
        F.when((h >= 12) & (h < 16), F.lit("NA")).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"),
        F.when((h >= 16) & (h < 19), F.lit("")).when((h >= 19) & (h < 21), F.lit("null"))
         .otherwise(F.col("c_mktsegment")).alias("c_mktsegment"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.col("n_supp").cast("string")).alias("urgent_note"),
        F.when((h >= 21) & (h < 24), F.lit("?")).otherwise(F.col("o_orderstatus")).alias("status_txt"),
        F.when((h >= 24) & (h < 27), F.lit("x")).otherwise(F.col("has_R").cast("string")).alias("has_R_txt"),
    )


SQL_ORDER_RISK_DIRTY = f"""
    SELECT o.o_orderkey, {sql_split('o.o_orderkey')} AS split,
           CASE WHEN h < 7 THEN '?' ELSE cast(l.n_lines AS varchar) END AS n_lines,
           CASE WHEN h >= 7 AND h < 12 THEN '?' ELSE cast(cast(round(l.price_sum * 100) AS bigint) AS varchar) END AS price_cents,
           CASE WHEN h >= 12 AND h < 16 THEN 'NA' ELSE o.o_orderpriority END AS o_orderpriority,
           CASE WHEN h >= 16 AND h < 19 THEN '' WHEN h >= 19 AND h < 21 THEN 'null' ELSE c.c_mktsegment END AS c_mktsegment,
           CASE WHEN o.o_orderpriority = '1-URGENT' THEN cast(l.n_supp AS varchar) END AS urgent_note,
           CASE WHEN h >= 21 AND h < 24 THEN '?' ELSE o.o_orderstatus END AS status_txt,
           CASE WHEN h >= 24 AND h < 27 THEN 'x' ELSE cast(l.has_R AS varchar) END AS has_R_txt
    FROM (SELECT *, {sql_uhash32('dirty', 'o_orderkey')} % 100 AS h FROM orders) o
    LEFT JOIN (
        SELECT l_orderkey, count(*) AS n_lines,
               cast(sum(cast(round(l_extendedprice * 100) AS bigint)) AS double) / 100 AS price_sum,
               count(DISTINCT l_suppkey) AS n_supp,
               max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS has_R
        FROM lineitem GROUP BY l_orderkey) l ON o.o_orderkey = l.l_orderkey
    LEFT JOIN customer c ON o.o_custkey = c.c_custkey"""

DIRTY_TEXT_COLS = ["n_lines", "price_cents", "o_orderpriority", "c_mktsegment", "urgent_note",
                   "status_txt", "has_R_txt"]


# ------------------------------------------------------------- closed-form scorers
# Intercepts and weights (in ORDER_NUMERIC order) of the
# fixed logistic scorers that stand in for trained models wherever an exact
# oracle is needed.
LINEAR_MODELS = {
    "y": (-0.2, [0.30, -0.004, 0.000004, -8.0, 5.0, 0.1, -0.000002]),
    "has_R": (-1.5, [0.45, 0.001, 0.000001, 2.0, -3.0, 0.05, 0.0000005]),
    "has_A": (-1.2, [0.35, 0.002, -0.000002, 4.0, 1.0, 0.08, 0.000001]),
    "has_N": (0.3, [0.25, -0.001, 0.000002, -1.0, 2.0, 0.02, -0.000001]),
}
TARGETS = ["y", "has_R", "has_A", "has_N"]


def linear_margin(target: str, cols=None):
    b, w = LINEAR_MODELS[target]
    cols = cols or [F.col(c) for c in ORDER_NUMERIC]
    z = F.lit(float(b))
    for wi, c in zip(w, cols):
        z = z + F.lit(float(wi)) * c
    return z


def sql_linear_margin(target: str, cols=None) -> str:
    b, w = LINEAR_MODELS[target]
    cols = cols or ORDER_NUMERIC
    return "(" + f"{float(b)!r}::DOUBLE" + "".join(
        f" + {float(wi)!r}::DOUBLE * {c}" for wi, c in zip(w, cols)) + ")"


def scored_long(t: Tables) -> DataFrame:
    """One row per (order, target): label, margin z, predicted label, split."""
    r = order_risk_split(t)
    items = [F.struct(F.lit(tg).alias("target"), F.col(tg).cast("int").alias("label"),
                      linear_margin(tg).alias("z")) for tg in TARGETS]
    # a target with a single class: every order has a customer
    items.append(F.struct(F.lit("has_customer").alias("target"),
                          F.col("c_mktsegment").isNotNull().cast("int").alias("label"),
                          linear_margin("y").alias("z")))
    return r.select("o_orderkey", "split", F.explode(F.array(*items)).alias("s")) \
        .select("o_orderkey", "split", "s.target", "s.label", "s.z",
                (F.col("s.z") >= 0).cast("int").alias("prediction"))


def sql_scored_long() -> str:
    parts = [f"SELECT o_orderkey, split, '{tg}' AS target, cast({tg} AS integer) AS label, "
             f"{sql_linear_margin(tg)} AS z FROM order_risk_split" for tg in TARGETS]
    parts.append("SELECT o_orderkey, split, 'has_customer' AS target, "
                 "cast(c_mktsegment IS NOT NULL AS integer) AS label, "
                 f"{sql_linear_margin('y')} AS z FROM order_risk_split")
    return ("SELECT *, cast(z >= 0 AS integer) AS prediction FROM ("
            + " UNION ALL ".join(parts) + ") u")


SQL_CTE_SCORED = f"order_risk_split AS ({SQL_ORDER_RISK_SPLIT}), scored AS ({sql_scored_long()})"
