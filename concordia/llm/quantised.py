"""Operator 10: near-duplicate embeddings by int8 tile products with error bounds.

Equal vectors form one class (rows of a class are all linked). Classes are dealt
to tiles of about ``tile`` vectors by a hash of their bytes. A unit vector
``a`` is stored as ``s_a * q_a`` with int8 ``q_a``; ``e_a`` is the exact length of
what rounding took. For two vectors

    |cos(a, b) - s_a s_b (q_a . q_b)| <= |s_a q_a| e_b + e_a |s_b q_b| + e_a e_b

so a pair of tiles costs one product of small integers, exact in single
precision, and only pairs whose upper bound reaches the threshold are computed
again from the original vectors in double precision. Tiles are written once; a
task holds a batch of them while all others pass through it, and gives out at
most a row per vector of its batch and one per passing vector (its number of
links there, and the smallest vector it is joined with), never the pairs: neither
the tiles nor a large group of near copies fill the disk. The work is n^2 / 2
integer products in tiles.

Defined results: vectors that are null, empty, zero or hold a null or non-finite
component link with nothing (0 links, own component, kept); vectors of different
lengths never link; repeated rows (equal id and vector) count once as a partner;
rows with a null id take no part. Labels and further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .components import components
from .shipping import ship
from .vectors import matrix, packed

TILE = 2048
#: Components of the vectors of the tiles that a task holds while the others pass: 8 bytes each, and their codes.
BATCH_CELLS = 1 << 21


def quantise(unit: np.ndarray):
    """``(codes, scale, rounding error, length of the rounded vector)`` of unit rows."""
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None])
    back = codes * scale[:, None]
    return codes, scale, np.sqrt(((unit - back) ** 2).sum(axis=1)), np.sqrt((back ** 2).sum(axis=1))


def _build(dtype):
    def run(rows: pa.Table, classes: pa.Table) -> pa.Table:
        if not rows.num_rows or not classes.num_rows:
            return pa.table({n: pa.array([], t) for n, t in (("dim", pa.int32()), ("tile", pa.int64()), *((p, pa.binary()) for p in _PARTS))})
        # rows of a class may come from several tasks: one of them is taken
        at = {k: i for i, k in enumerate(rows["key"].to_pylist())}
        known = [at.get(k, -1) for k in classes["c_key"].to_pylist()]
        keep = np.flatnonzero(np.array(known) >= 0)
        ids = classes["c_id"].to_numpy()[keep]
        order = np.argsort(ids, kind="stable")
        raw = rows["raw"].take(pa.array([known[i] for i in keep[order]], pa.int64())).to_pylist()
        dim = rows["dim"][0].as_py()
        x = matrix(raw, dtype, dim)
        # lengths of very large or small vectors: scaled before squaring
        top = np.abs(x).max(axis=1, keepdims=True)
        length = np.sqrt(((x / top) ** 2).sum(axis=1))
        codes, scale, err, size = quantise(x / top / length[:, None])
        blobs = (ids[order], classes["c_m"].to_numpy()[keep][order], codes.astype(np.int8), scale, err, size, x.astype(dtype))
        return pa.table({"dim": pa.array([dim], pa.int32()), "tile": pa.array([rows["tile"][0].as_py()], pa.int64()),
                         **{n: pa.array([b.tobytes()], pa.binary()) for n, b in zip(_PARTS, blobs)}})

    return run


_PARTS = ("ids", "m", "codes", "scale", "err", "size", "raw")


def _load(t: dict, dtype):
    dim = t["dim"]
    get = lambda n, d: np.frombuffer(t[n], d)
    x = get("raw", dtype).reshape(-1, dim).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x = x / np.sqrt((x ** 2).sum(axis=1))[:, None]
    exact = np.float32 if dim * 127 * 127 < 1 << 24 else np.float64
    return {"ids": get("ids", np.int64), "m": get("m", np.int64), "codes": get("codes", np.int8).reshape(-1, dim).astype(exact),
            "scale": get("scale", np.float64), "err": get("err", np.float64), "size": get("size", np.float64), "x": x}


def links_between(a: dict, b: dict, same: bool, threshold: float):
    """Index pairs ``(i, j)`` whose cosine reaches the threshold (``i < j`` within one tile)."""
    got_i, got_j = [], []
    slack = 1e-9
    worst = b["size"].max() * a["err"] + (a["size"] + a["err"]) * b["err"].max()
    least = (threshold - worst - slack) / a["scale"]
    # with a bound over the threshold anything may link; else the largest scale gives the least product
    cut = np.where(least > 0, least / b["scale"].max(), least / b["scale"].min())
    for lo in range(0, len(a["ids"]), 512):
        part = slice(lo, min(lo + 512, len(a["ids"])))
        dots = a["codes"][part] @ b["codes"].T
        i, j = np.nonzero(dots >= cut[part, None])
        if same:
            i, j = i[i + lo < j], j[i + lo < j]
        value = dots[i, j].astype(np.float64)
        i = i + lo
        upper = value * a["scale"][i] * b["scale"][j] + a["size"][i] * b["err"][j] \
            + a["err"][i] * b["size"][j] + a["err"][i] * b["err"][j] + slack
        i, j = i[upper >= threshold], j[upper >= threshold]
        for k in range(0, len(i), 1 << 15):
            p, q = i[k:k + (1 << 15)], j[k:k + (1 << 15)]
            good = (a["x"][p] * b["x"][q]).sum(axis=1) >= threshold
            got_i.append(p[good])
            got_j.append(q[good])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *got_i]), np.concatenate([none, *got_j])


def _meets(a: int, b: int) -> bool:
    """Whether the batch that holds tile ``a`` counts its pairs with tile ``b``: one side of every two does."""
    return a == b or (a < b) == ((a + b) % 2 == 0)


class _Batch:
    """Tiles that a task holds, and their vectors' links and roots so far."""

    def __init__(self, tiles: list[dict], dtype, threshold: float):
        self.dtype, self.threshold, self.dim = dtype, threshold, tiles[0]["dim"]
        self.numbers, self.tiles = [t["tile"] for t in tiles], [_load(t, dtype) for t in tiles]
        self.first = np.concatenate([[0], np.cumsum([len(t["ids"]) for t in self.tiles])])
        self.ids, self.m = (np.concatenate([t[n] for t in self.tiles]) for n in ("ids", "m"))
        self.links, self.root = np.zeros(len(self.ids), np.int64), self.ids.copy()

    def visit(self, passing: dict):
        """Meet a passing tile: rows of (id, links, root) to give out at once, or None."""
        at = [k for k, a in enumerate(self.numbers) if _meets(a, passing["tile"])] if passing["dim"] == self.dim else []
        if not at:
            return None
        own = self.numbers.index(passing["tile"]) if passing["tile"] in self.numbers else None
        b = _load(passing, self.dtype) if own is None else self.tiles[own]
        n, first = len(self.ids), len(self.ids) if own is None else self.first[own]
        ids, m, root = (np.concatenate([held, more]) if own is None else held for held, more in (
            (self.ids, b["ids"]), (self.m, b["m"]), (self.root, b["ids"])))
        links, given_up = np.zeros(len(ids), np.int64), []
        for k in at:  # pairs of two tiles are held at a time
            i, j = links_between(self.tiles[k], b, k == own, self.threshold)
            if not len(i):
                continue
            i, j = i + self.first[k], j + first
            links += (np.bincount(i, m[j], minlength=len(ids)) + np.bincount(j, m[i], minlength=len(ids))).astype(np.int64)
            new = root.copy()
            while True:  # smallest id joined with, along the links
                low = np.minimum(new[i], new[j])
                step = new.copy()
                np.minimum.at(step, i, low)
                np.minimum.at(step, j, low)
                if (step == new).all():
                    break
                new = step
            # a root that gives way stays joined with the one that follows it
            moved = np.flatnonzero((new != root) & (root != ids))
            given_up.append(np.unique(np.stack([root[moved], new[moved]]), axis=1))
            root = new
        if not given_up:
            return None
        before, after = np.unique(np.concatenate(given_up, axis=1), axis=1)
        self.links, self.root = self.links + links[:n], root[:n]
        hit = n + np.flatnonzero(links[n:] > 0)
        return (np.concatenate([ids[hit], before]), np.concatenate([links[hit], np.zeros(len(before), np.int64)]),
                np.concatenate([root[hit], after]))

    def rows(self):
        hit = np.flatnonzero(self.links > 0)
        return self.ids[hit], self.links[hit], self.root[hit]


def _batches_meet(dtype, threshold):
    def run(pairs):
        held = {}
        for (name, tiles), passing in pairs:
            if name not in held:
                held[name] = _Batch(tiles, dtype, threshold)
            got = held[name].visit(passing.asDict())
            if got is not None:
                yield from zip(*(c.tolist() for c in got))
        for batch in held.values():
            yield from zip(*(c.tolist() for c in batch.rows()))

    return run


def linked_vectors(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding",
                   tile: int = TILE) -> DataFrame:
    """Per row of ``vectors``: vec_id, n_links, component_id, kept."""
    given, dtype = packed(vectors, id_col, vector_col)
    given = given.withColumn("key", F.unhex(F.sha2("raw", 256)))
    rows = written(given.select("vec_id", "dim", "key"))
    # classes of equal vectors; members are counted once an id
    members = rows.where("key IS NOT NULL AND vec_id IS NOT NULL")
    classes = written(members.distinct().groupBy("key", "dim").agg(F.min("vec_id").alias("id"), F.count("*").alias("m")))
    per_dim = {r["dim"]: -(-r["n"] // tile) for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # a row a length
    spark = vectors.sparkSession
    if not per_dim:
        found = spark.createDataFrame([], "id long, links long, root long")
    else:
        found = _found(spark, given, classes, per_dim, dtype, threshold, tile)
    comp = components(found.select(F.col("id").alias("u"), F.col("root").alias("v")))
    count = found.groupBy("id").agg(F.sum("links").alias("links"))
    by_class = classes.select("key", "id", "m").join(count, "id", "left").join(comp, "id", "left") \
        .select("key", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"),
                F.coalesce("component_id", "id").alias("component_id"))
    return rows.join(by_class, "key", "left").select(
        "vec_id", F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"),
        F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id")).alias("component_id"),
        (F.col("vec_id").isNull() | (F.col("vec_id") == F.coalesce("component_id", "vec_id"))).alias("kept"))


def _once_a_batch(batches):
    """Rows without those whose vector came before in the same batch, so that a common vector's rows meet in no task."""
    for b in batches:
        seen = b.column(b.schema.get_field_index("key")).to_pylist()
        yield b.take(pa.array(sorted({k: i for i, k in enumerate(seen)}.values()), pa.int64()))


def _found(spark, given: DataFrame, classes: DataFrame, per_dim: dict, dtype, threshold: float, tile: int) -> DataFrame:
    """``(id, links, root)``: links of classes, and the smallest id that each was seen joined with; an id may come several times.

    Tiles are written once. Batches of them are dealt to tasks, and all tiles pass through every task, one at a time, read
    where they were written: disk holds the vectors a fixed number of times, whatever their number.
    """
    ship(spark)
    number = F.create_map(*[F.lit(int(v)) for kv in sorted(per_dim.items()) for v in kv])
    number = F.pmod(F.xxhash64("key"), F.element_at(number, F.col("dim")).cast("long")).alias("tile")
    kinds = "key binary, dim int, raw binary"
    rows = given.where("key IS NOT NULL AND vec_id IS NOT NULL").select("key", "dim", "raw").mapInArrow(_once_a_batch, kinds)
    blobs = ", ".join(f"{n} binary" for n in _PARTS)
    tiles = written(rows.select("dim", number, "key", "raw").groupBy("dim", "tile").cogroup(
        classes.select("dim", number, "key", "id", "m").toDF("c_dim", "c_tile", "c_key", "c_id", "c_m").groupBy("c_dim", "c_tile"))
        .applyInArrow(_build(dtype), f"dim int, tile long, {blobs}"))
    # batches of a length's tiles: as many as give every core two, bounded by the cells a task holds
    cores, batches = spark.sparkContext.defaultParallelism, {}
    for dim, n in sorted(per_dim.items()):
        size = max(1, min(BATCH_CELLS // (tile * dim), n // (2 * cores)))
        batches[dim] = (sum(count for _, _, count in batches.values()), size, -(-n // size))
    total = sum(count for _, _, count in batches.values())

    def batch_of(r):
        first, size, count = batches[r["dim"]]
        return first + r["tile"] % count, r.asDict()

    def pack(pairs):
        held = {}
        for k, t in pairs:
            held.setdefault(k, []).append(t)
        yield from held.items()

    asking = tiles.rdd.map(batch_of).partitionBy(total, int).mapPartitions(pack)
    got = asking.cartesian(tiles.rdd.coalesce(1)).mapPartitions(_batches_meet(dtype, threshold))
    return written(spark.createDataFrame(got, "id long, links long, root long", verifySchema=False))


def op10_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Every embedding: links at cosine 0.9 or more."""
    return linked_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


# From the definition: every pair in double precision, then reachability.
_ORACLE = """
WITH RECURSIVE
v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE embedding IS NOT NULL
      AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0
      AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
      WHERE list_cosine_similarity(a.x, b.x) >= 0.9),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
k AS (SELECT a AS vec_id, count(*) AS n FROM e GROUP BY a)
SELECT t.vec_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, c.component_id, t.vec_id = c.component_id AS kept
FROM embeddings t JOIN c USING (vec_id) LEFT JOIN k USING (vec_id)
"""
QUERIES = {"op10_embedding_near_dedup": op10_embedding_near_dedup}
ORACLES = {"op10_embedding_near_dedup": _ORACLE}
