"""Operator 8: nearest neighbours through learned partitions.

Fit (on the ``sample`` vectors of smallest hash, a bounded parameter): a
neighbour graph of the sample is cut into balanced parts, and a small softmax
classifier learns, from a vector, how its neighbours spread over the parts. The
number of parts a query visits is calibrated on the sample: the smallest number
that reaches ``recall`` against brute force there, on average.

Index: every vector goes to its most probable part; parts are cut into blocks by
a hash, so a hot part spreads over tasks. Search: a query is routed to its most
probable parts; each (block, group of queries) reranks with original vectors in
double precision and keeps its best k, and the blocks' bests are merged. Within
a block equal vectors share one computation. Only the result of k rows per query
and block is shuffled on the query.

Nearness is the inner product; scores are computed in one fixed order of
operations, so equal vectors tie exactly and ties go to the smaller id.

Defined results: vectors that are null, empty, zero or hold a null or non-finite
component, and rows with a null id, take no part; repeated rows (equal id and
vector) count once; a query that met fewer than k others in its parts visits
the rest, so with fewer than k other vectors it returns them all; vectors of
another length than the most common one of the sample are no candidates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .vectors import matrix, packed

PARTS = 16
SAMPLE = 4096
RECALL = 0.97
BLOCK = 4096
QUERY_GROUP = 2048


def neighbours(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other rows by inner product, for a bounded matrix."""
    out = np.empty((len(x), k), np.int64)
    for lo in range(0, len(x), 1024):
        s = x[lo:lo + 1024] @ x.T
        s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -np.inf
        out[lo:lo + 1024] = np.argsort(-s, axis=1, kind="stable")[:, :k]
    return out


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Cut a neighbour graph into parts of at most 10 % over the mean size.

    Starts from seeds grown by nearness to running means; then vertices move to
    the part that holds most of their neighbours, as far as it has room.
    """
    n = len(x)
    cap = int(np.ceil(1.1 * n / parts))
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(n, parts, replace=False)]
    part = np.zeros(n, np.int64)

    def place(gain):
        room = np.full(parts, cap)
        out = np.full(n, -1)
        for i in np.argsort(-(np.sort(gain, axis=1)[:, -1] - np.sort(gain, axis=1)[:, -2]), kind="stable"):
            for p in np.argsort(-gain[i], kind="stable"):
                if room[p]:
                    out[i] = p
                    room[p] -= 1
                    break
        return out

    for _ in range(rounds):
        part = place(x @ centre.T)
        centre = np.stack([x[part == p].mean(axis=0) if (part == p).any() else centre[p] for p in range(parts)])
    # edges both ways
    src = np.repeat(np.arange(n), near.shape[1])
    dst = near.ravel()
    src, dst = np.concatenate([src, dst]), np.concatenate([dst, src])
    for _ in range(rounds):
        votes = np.bincount(src * parts + part[dst], minlength=n * parts).reshape(n, parts).astype(float)
        votes[np.arange(n), part] += 0.5
        new = place(votes + 1e-3 * (x @ centre.T))
        if (new == part).all():
            break
        part = new
    return part


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


class Router:
    """The fitted classifier; its size is parts times dimensions."""

    def __init__(self, weight: np.ndarray, bias: np.ndarray, probes: int):
        self.weight, self.bias, self.probes = weight, bias, probes

    def order(self, x: np.ndarray) -> np.ndarray:
        """Parts from most to least probable."""
        return np.argsort(-(x @ self.weight + self.bias), axis=1, kind="stable")


def fit(x: np.ndarray, parts: int = PARTS, k: int = 20, recall: float = RECALL, steps: int = 300, graph_k: int = 10) -> Router:
    """Fit on a bounded sample (rows of ``x``, in a fixed order)."""
    n, dim = x.shape
    parts = max(1, min(parts, n // (4 * k)))
    if parts == 1:
        return Router(np.zeros((dim, 1)), np.zeros(1), 1)
    near = neighbours(x, max(graph_k, k))
    part = balanced_parts(x, near[:, :graph_k], parts)
    spread = np.bincount(np.repeat(np.arange(n), graph_k) * parts + part[near[:, :graph_k]].ravel(),
                         minlength=n * parts).reshape(n, parts) / graph_k
    target = 0.5 * spread + 0.5 * np.eye(parts)[part]
    scale = np.sqrt((x ** 2).sum(axis=1).mean())
    w, b = np.zeros((dim, parts)), np.zeros(parts)
    gw, gb = np.full_like(w, 1e-8), np.full_like(b, 1e-8)
    for _ in range(steps):
        e = (softmax(x @ w / scale + b) - target) / n
        dw, db = x.T @ e / scale + 1e-5 * w, e.sum(axis=0)
        gw += dw ** 2
        gb += db ** 2
        w -= 0.5 * dw / np.sqrt(gw)
        b -= 0.5 * db / np.sqrt(gb)
    router = Router(w / scale, b, parts)
    order = router.order(x)
    at = order[:, 0]
    rank = np.empty((n, parts), np.int64)
    np.put_along_axis(rank, order, np.arange(parts)[None, :].repeat(n, 0), axis=1)
    needed = rank[np.arange(n)[:, None], at[near[:, :k]]]  # at which visit each true neighbour is met
    for probes in range(1, parts + 1):
        if (needed < probes).mean() >= recall:
            router.probes = probes
            break
    return router


def _route(router: Router, dtype, dim: int, probes: int):
    def run(batches):
        for b in batches:
            if b.num_rows == 0:
                continue
            order = router.order(matrix(b.column(1).to_pylist(), dtype, dim))[:, :probes].astype(np.int32)
            offs = np.arange(0, order.size + 1, order.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.ListArray.from_arrays(pa.array(offs), pa.array(order.ravel()))],
                names=[*b.schema.names, "parts"])

    return run


def _rerank(dtype, dim: int, k: int):
    def run(t: pa.Table) -> pa.Table:
        ids, raw, query = t["vec_id"].to_numpy(), t["raw"].to_pylist(), t["query"].to_numpy(zero_copy_only=False)
        order = np.argsort(ids, kind="stable")
        qs, xs = order[query[order]], order[~query[order]]
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if len(qs) and len(xs):
            # equal vectors: the k + 1 smallest ids of each can be among the k nearest, no others
            of: dict[bytes, list] = {}
            for i in xs:
                held = of.setdefault(raw[i], [])
                if len(held) <= k:
                    held.append(ids[i])
            x = matrix(list(of), dtype, dim)
            counts = np.array([len(v) for v in of.values()])
            flat = np.concatenate([np.array(v) for v in of.values()])
            at = np.concatenate([[0], np.cumsum(counts)])
            parts = [out]
            for lo in range(0, len(qs), 256):
                part = qs[lo:lo + 256]
                q = matrix([raw[i] for i in part], dtype, dim)
                s = q @ x.T
                if x.shape[0] > k + 1:
                    cut = np.partition(s, -(k + 1), axis=1)[:, -(k + 1)]
                    size = np.sqrt((q ** 2).sum(axis=1)) * np.sqrt((x ** 2).sum(axis=1)).max()
                    i, j = np.nonzero(s >= (cut - 1e-12 * dim * size)[:, None])
                else:
                    i, j = (v.ravel() for v in np.indices(s.shape))
                score = (q[i] * x[j]).sum(axis=1)  # one order of operations for every pair
                rep = counts[j]
                i, score = np.repeat(i, rep), np.repeat(score, rep)
                c = flat[np.arange(len(i)) - np.repeat(np.cumsum(rep) - rep, rep) + np.repeat(at[j], rep)]
                qid = ids[part][i]
                other = qid != c
                qid, c, score = qid[other], c[other], score[other]
                o = np.lexsort((c, -score, qid))
                qid, c, score = qid[o], c[o], score[o]
                first = np.concatenate([[True], qid[1:] != qid[:-1]]) if len(qid) else np.zeros(0, bool)
                place = np.arange(len(qid)) - np.maximum.accumulate(np.where(first, np.arange(len(qid)), 0))
                parts.append([v[place < k] for v in (qid, c, score)])
            out = [np.concatenate(v) for v in zip(*parts)]
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()),
                         "score": pa.array(out[2], pa.float64())})

    return run


def nearest(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
            parts: int = PARTS, sample: int = SAMPLE, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's k nearest other vectors found.

    ``is_query`` is a condition on the column ``vec_id``.
    """
    rows, dtype = packed(vectors, id_col, vector_col)
    rows = materialize(rows.where("raw IS NOT NULL AND vec_id IS NOT NULL").dropDuplicates(["vec_id", "raw"]))
    fitted = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "raw").limit(sample).select("dim", "raw").collect()
    if not fitted:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = [r["dim"] for r in fitted]
    dim = max(sorted(set(dims)), key=dims.count)
    router = fit(matrix([bytes(r["raw"]) for r in fitted if r["dim"] == dim], dtype, dim), parts, k, recall)
    n_parts = router.weight.shape[1]
    held = materialize(rows.where(F.col("dim") == dim).select("vec_id", "raw").mapInArrow(
        _route(router, dtype, dim, n_parts), "vec_id long, raw binary, parts array<int>"))
    queries = held.where(is_query)

    def visited(which: DataFrame, first: int, count: int) -> DataFrame:
        return which.select("vec_id", "raw", F.explode(F.slice("parts", first, count)).alias("part"))

    def ranked(found: DataFrame) -> DataFrame:
        # k rows a block and query at most
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")) \
            .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k) \
            .select("query_id", "rank", "vec_id", "score")

    got = materialize(ranked(_search(held, visited(queries, 1, router.probes), dtype, dim, k, block)))
    if router.probes == n_parts:
        return got
    # the parts left out, for queries that met fewer than k others
    met = got.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("met"))
    short = queries.join(met, "vec_id", "left").where(F.coalesce("met", F.lit(0)) < k)
    if short.isEmpty():
        return got
    rest = _search(held, visited(short, router.probes + 1, n_parts), dtype, dim, k, block)
    return ranked(got.drop("rank").unionByName(rest))


def _search(held: DataFrame, asked: DataFrame, dtype, dim: int, k: int, block: int) -> DataFrame:
    """``(query_id, vec_id, score)``: the best k of every (block, group of queries) of the parts that ``asked`` names."""
    # blocks of a part, groups of the queries routed to it: one row a part (``parts`` rows at most)
    sizes = held.groupBy(F.col("parts")[0].alias("part")).agg(F.ceil(F.count("*") / F.lit(block)).alias("blocks"))
    groups = asked.groupBy("part").agg(F.ceil(F.count("*") / F.lit(QUERY_GROUP)).alias("groups"))
    plan = F.broadcast(sizes.join(groups, "part"))

    def upto(c):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))

    h = F.xxhash64("vec_id")
    data = held.select("vec_id", "raw", F.col("parts")[0].alias("part")).join(plan, "part") \
        .select("vec_id", "raw", "part", F.pmod(h, F.col("blocks")).alias("b"), upto("groups").alias("g"),
                F.lit(False).alias("query"))
    asks = asked.join(plan, "part").select("vec_id", "raw", "part", upto("blocks").alias("b"),
                                           F.pmod(h, F.col("groups")).alias("g"), F.lit(True).alias("query"))
    return data.unionByName(asks).groupBy("part", "b", "g").applyInArrow(
        _rerank(dtype, dim, k), "query_id long, vec_id long, score double")


def op8_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20, among all vectors."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), (F.col("vec_id") % 20) == 0)


QUERIES = {"op8_nearest_neighbours": op8_nearest_neighbours}
ORACLES: dict[str, str] = {}
