"""Exact k-nearest-neighbour join by pivots and the triangle inequality.

Equal vectors are one point (with the k + 1 smallest of their ids: no row needs
more of them), so copies are never paired. Points go to the cell of their
nearest pivot. A point first searches its own cell; its (k + 1)-th distance u
then rules out every cell c whose members cannot be nearer: a member lies within
the cell's radius r of the pivot, and is nearer to it than to the point's own
pivot, so its distance is at least max(d(q, c) - r, (d(q, c) - d(q, own)) / 2).
The cells that remain are searched in a second round. Bounds are compared with
a margin above rounding, distances are sums of squares in column order, so
results are those of comparing all pairs, ties going to the smaller id.

Cells are cut into blocks of members and of visitors, and a task compares one
block with one, so a crowded cell is spread over tasks and memory is bounded.
Pivots are at most ``MAX_PIVOTS`` (root of the number of points), the only thing
that reaches the driver besides a count and a radius a cell.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import uhash32
from ..functions.ordering import row_number
from ..session import materialize

MAX_PIVOTS = 4096
#: Members or visitors of a cell that a task holds.
BLOCK = 4096
#: Distances that a task holds at once.
CELLS = 1 << 20
#: Relative room for rounding in the bounds.
MARGIN = 1e-9


def _matrix(column, p: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, p)


def _points(rows: DataFrame, k: int) -> DataFrame:
    """``(pid, x, ids)``: distinct vectors, ``ids`` the k + 1 smallest ids that have it, ``pid`` the smallest."""
    first = row_number(rows, [F.col("id").asc()], ["x"], out="__rn").where(F.col("__rn") <= k + 1)
    return first.groupBy("x").agg(F.sort_array(F.collect_list("id")).alias("ids")) \
        .select(F.col("ids")[0].alias("pid"), "x", "ids")


def _assign(points: DataFrame, pivots: np.ndarray, p: int) -> DataFrame:
    """Adds the nearest pivot's number and its distance."""
    shared = points.sparkSession.sparkContext.broadcast(pivots)
    step = max(1, CELLS // max(1, len(pivots)))

    def run(batches):
        of = shared.value
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
            cell, dist = np.zeros(len(x), np.int32), np.zeros(len(x))
            for lo in range(0, len(x), step):
                d = np.zeros((len(x[lo:lo + step]), len(of)))
                for j in range(p):
                    gap = x[lo:lo + step, j][:, None] - of[:, j][None, :]
                    d += gap * gap
                cell[lo:lo + step] = d.argmin(axis=1)
                dist[lo:lo + step] = np.sqrt(d.min(axis=1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(dist)], names=[*b.schema.names, "cell", "dist"])

    return points.mapInArrow(run, "pid long, x array<double>, ids array<long>, cell int, dist double")


def _visits(found: DataFrame, pivots: np.ndarray, radius: np.ndarray, p: int) -> DataFrame:
    """``(pid, x, cell)``: the other cells that may hold a row as near as the (k + 1)-th found."""
    shared = found.sparkSession.sparkContext.broadcast((pivots, radius))
    step = max(1, CELLS // max(1, len(pivots)))
    margin = MARGIN

    def run(batches):
        of, r = shared.value
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
            own, dist, u = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
            for lo in range(0, len(x), step):
                part = x[lo:lo + step]
                d = np.zeros((len(part), len(of)))
                for j in range(p):
                    gap = part[:, j][:, None] - of[:, j][None, :]
                    d += gap * gap
                d = np.sqrt(d)
                o = dist[lo:lo + step][:, None]
                least = np.maximum(d - r[None, :], (d - o) / 2)
                near = least <= np.sqrt(u[lo:lo + step])[:, None] + margin * (d + r[None, :] + o)
                near[np.arange(len(part)), own[lo:lo + step]] = False
                q, c = np.nonzero(near)
                rows = b.slice(lo, step).take(pa.array(q))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(c.astype(np.int32))],
                                                 names=["pid", "x", "cell"])

    return found.select("pid", "x", "cell", "dist", "u").mapInArrow(run, "pid long, x array<double>, cell int")


def _search(members: DataFrame, visitors: DataFrame, p: int, k: int, block: int) -> DataFrame:
    """``(pid, npid, d, ids)``: of every visitor's cell the k + 1 nearest points (squared distance) a block."""
    # one row a cell, at most MAX_PIVOTS
    blocks = members.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).alias("nb"))
    queues = visitors.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).alias("nq"))
    sizes = F.broadcast(blocks.join(queues, "cell"))
    held = members.join(sizes, "cell").select(
        "cell", F.pmod(F.xxhash64("pid"), "nb").alias("mb"), F.explode(F.expr("sequence(0L, nq - 1)")).alias("qb"),
        "pid", "x", "ids")
    asks = visitors.join(sizes, "cell").select(
        F.col("cell").alias("acell"), F.explode(F.expr("sequence(0L, nb - 1)")).alias("amb"),
        F.pmod(F.xxhash64("pid", F.lit(1)), "nq").alias("aqb"), F.col("pid").alias("apid"), F.col("x").alias("ax"))
    most = CELLS

    def run(asking, holding):
        names = ["pid", "npid", "d", "ids"]
        if not asking.num_rows or not holding.num_rows:
            return pa.table({"pid": pa.array([], pa.int64()), "npid": pa.array([], pa.int64()), "d": pa.array([], pa.float64()),
                             "ids": pa.array([], pa.list_(pa.int64()))})
        order = holding.column("pid").combine_chunks().to_numpy().argsort()
        holding = holding.take(pa.array(order))  # ties go to the smaller id
        a = asking.column("ax").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
        b = holding.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
        keep, at, near, far = min(k + 1, len(b)), [], [], []
        step = max(1, most // len(b))
        for lo in range(0, len(a), step):
            part = a[lo:lo + step]
            d = np.zeros((len(part), len(b)))
            for j in range(p):
                gap = part[:, j][:, None] - b[:, j][None, :]
                d += gap * gap
            if keep < len(b):
                # all that lie as near as the last one kept, then the first of them in order of (distance, id)
                limit = np.partition(d, keep - 1, axis=1)[:, keep - 1]
                q, m = np.nonzero(d <= limit[:, None])
            else:
                q, m = np.divmod(np.arange(d.size), len(b))
            v = d[q, m]
            by = np.lexsort((m, v, q))
            q, m, v = q[by], m[by], v[by]
            first = np.arange(len(q)) - np.searchsorted(q, q)
            chosen = first < keep
            at.append(q[chosen] + lo)
            near.append(m[chosen])
            far.append(v[chosen])
        at, near = pa.array(np.concatenate(at)), pa.array(np.concatenate(near))
        return pa.table([asking.column("apid").take(at), holding.column("pid").take(near), pa.array(np.concatenate(far)),
                         holding.column("ids").take(near)], names=names)

    return asks.groupBy("acell", "amb", "aqb").cogroup(held.groupBy("cell", "mb", "qb")) \
        .applyInArrow(run, "pid long, npid long, d double, ids array<long>")


def _nearest_rows(found: DataFrame, k: int) -> DataFrame:
    """``(pid, best)``: the k + 1 nearest rows as (d, id), from at most k + 1 points a searched block."""
    entries = F.sort_array(F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct(F.col("d").alias("d"), i.alias("id"))))))
    return found.groupBy("pid").agg(F.slice(entries, 1, k + 1).alias("best"))


def nearest(rows: DataFrame, p: int, k: int, pivots: int | None = None, block: int = BLOCK) -> DataFrame:
    """``(id, neighbour, d, rank)``: the k nearest other rows of every row (id, x), nearest first, ties to the smaller id.

    ``d`` is the squared distance. Ids are unique; rows whose vector is null or
    holds a null are left out. Fewer than k others: all of them.
    """
    rows = rows.select(F.col("id").cast("long").alias("id"), F.col("x").cast("array<double>").alias("x")) \
        .where(F.col("x").isNotNull() & (F.size("x") == p) & ~F.exists("x", lambda v: v.isNull()))
    points = materialize(_points(rows, k))
    n = points.count()
    chosen = points.select("pid", "x", uhash32("pivot", "pid").alias("h")).orderBy("h", "pid") \
        .limit(min(pivots or max(1, math.isqrt(n)), MAX_PIVOTS)).collect()
    at = np.array([r["x"] for r in chosen], float).reshape(-1, p)
    members = materialize(_assign(points, at, p))
    radius = np.zeros(len(at))
    for r in members.groupBy("cell").agg(F.max("dist").alias("r")).collect():  # one row a cell
        radius[r["cell"]] = r["r"]
    own = materialize(_nearest_rows(_search(members, members.select("pid", "x", "cell"), p, k, block), k))
    bound = F.when(F.size("best") > k, F.col("best")[k]["d"]).otherwise(F.lit(math.inf))
    visits = materialize(_visits(members.join(own.select("pid", bound.alias("u")), "pid"), at, radius, p))
    other = _search(members, visits, p, k, block)
    first = own.select("pid", F.explode("best").alias("b")).select(
        "pid", F.lit(None).cast("long").alias("npid"), F.col("b.d").alias("d"), F.array("b.id").alias("ids"))
    best = _nearest_rows(first.unionByName(other), k)
    # a row's point: rows of one vector may be many, the join splits them where they are skewed
    of = rows.join(points.select("x", "pid"), "x").select("id", "pid").join(best, "pid")
    others = F.slice(F.filter("best", lambda b: b["id"] != F.col("id")), 1, k)
    return of.select("id", F.posexplode(others).alias("rank", "b")).select(
        "id", F.col("b.id").alias("neighbour"), F.col("b.d").alias("d"), (F.col("rank") + 1).alias("rank"))
