"""Operator 1: near-duplicate documents by a signature-coordinate inverted join.

1. Every text becomes a set of distinct word shingles (64-bit hashes) and a
   signature of ``k`` minima; documents with equal sets form one class.
2. Each class is posted under its ``k`` (coordinate, value) pairs. Posting
   frequencies are counted over all classes. Two classes that agree on at least
   ``T`` coordinates must meet in the rarest ``k - T + 1`` of them (prefix), so
   classes with too few shared coordinates fall out, and long posting lists are
   skipped rather than merged: the rest of the count is read off the signatures.
3. Classes that meet in a prefix posting form clusters (linear star edges, not
   pairs). A cluster is cut by set size and into blocks; each pair of blocks
   counts collisions between signatures, keeps pairs with ``T`` matches or more
   and confirms them on the full sets. A block emits a spanning forest of its
   links, so a group of n near copies costs at most n - 1 rows per block.
4. Components of the confirmed links are the duplicate groups.

``T`` lies ``z`` standard deviations under the mean match count at the
similarity bound: with the defaults a pair exactly on the bound is missed with
probability below 1e-5, a closer one far less often.

Defined results: null and empty texts (and texts of white space) have an empty
set and link with nothing; fewer words than the shingle size form one shingle;
rows that share a ``doc_id`` are one document; rows with a null ``doc_id`` link
with nothing (component null, kept). Only ``doc_id`` and ``text`` are read, so
further columns may have any names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from . import shingles as S
from .components import components
from .shipping import ship

BLOCK = 256


def match_threshold(k: int, percent: int, z: float = 4.75) -> int:
    p = percent / 100
    return max(1, math.floor(k * p - z * math.sqrt(k * p * (1 - p))))


def signatures(docs: DataFrame, size: int, k: int, seed: int) -> DataFrame:
    """``(doc_id, n_shingles, key, sig)``; ``key`` is a 128-bit digest of the sorted set."""

    def run(batches):
        params = S.minhash_params(k, seed)
        for b in batches:
            ids, text = b.column(0), b.column(1)
            for lo, offs, data in S.text_slices(text):
                h, first, _, _ = S.words(offs, data)
                n, keys, sigs = [], [], []
                for u in S.shingle_sets(h, first, size):
                    n.append(len(u))
                    keys.append(hashlib.blake2b(u.tobytes(), digest_size=16).digest())
                    sigs.append(S.minhash(u, params) if len(u) else None)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, len(n)).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(keys, pa.binary()),
                     pa.array(sigs, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "key", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(run, "doc_id long, n_shingles long, key binary, sig array<long>")


def prefix_postings(reps: DataFrame, k: int, t: int) -> DataFrame:
    """``(tok, id)``: each class's rarest ``k - t + 1`` coordinate-value pairs, as far as another class has them."""
    tokens = reps.select("id", F.posexplode("sig").alias("pos", "value")).select("id", F.xxhash64("pos", "value").alias("tok"))
    df = tokens.groupBy("tok").agg(F.count("*").alias("df")).where("df >= 2")
    shared = tokens.join(df, "tok")
    # k rows per class at most: the window never grows with the data
    w = Window.partitionBy("id")
    return shared.withColumn("m", F.count("*").over(w)) \
        .withColumn("r", F.row_number().over(w.orderBy("df", "tok"))) \
        .where((F.col("m") >= t) & (F.col("r") <= F.col("m") - (t - 1))).select("tok", "id")


def shingle_blobs(docs: DataFrame, size: int) -> DataFrame:
    """``(id, grams)``: the sorted 64-bit shingle hashes of each text."""

    def run(batches):
        for b in batches:
            ids, text = b.column(0), b.column(1)
            for lo, offs, data in S.text_slices(text):
                h, first, _, _ = S.words(offs, data)
                sets = [u.tobytes() for u in S.shingle_sets(h, first, size)]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, len(sets)), pa.array(sets, pa.binary())],
                                                 names=["id", "grams"])

    return docs.mapInArrow(run, "id long, grams binary")


def _confirm(percent: int, t: int):
    def run(table: pa.Table) -> pa.Table:
        ids = table["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        side = table["side"].to_numpy()[order]
        sig = table["sig"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)[order]
        blobs = table["grams"].to_pylist()
        sets = [np.frombuffer(blobs[i], np.uint64) for i in order]
        n = np.array([len(s) for s in sets])
        root = np.arange(len(ids))

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        eu, ev = [], []
        for i in range(len(ids)):
            j = np.arange(i + 1, len(ids))
            j = j[(side[j] != side[i]) | (side[i] == 2)]
            lo, hi = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
            j = j[100 * lo >= percent * hi]
            if not len(j):
                continue
            j = j[(sig[j] == sig[i]).sum(axis=1) >= t]
            for x in j:
                a, b = find(i), find(x)
                if a == b:
                    continue
                both = len(np.intersect1d(sets[i], sets[x], assume_unique=True))
                if 100 * both >= percent * (n[i] + n[x] - both):
                    root[max(a, b)] = min(a, b)
                    eu.append(ids[i])
                    ev.append(ids[x])
        return pa.table({"u": pa.array(eu, pa.int64()), "v": pa.array(ev, pa.int64())})

    return run


def duplicate_links(docs: DataFrame, sigs: DataFrame, size: int, percent: int, k: int, t: int,
                    block: int = BLOCK) -> DataFrame:
    """Confirmed links ``(u, v)`` between classes (smallest doc_ids) that span every component."""
    reps = sigs.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("key") \
        .agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
    posts = materialize(prefix_postings(reps, k, t))
    lead = posts.groupBy("tok").agg(F.min("id").alias("v"))
    stars = posts.join(lead, "tok").where("id != v").select(F.col("id").alias("u"), "v").distinct()
    member = components(stars).withColumnRenamed("component_id", "cluster")

    # a pair on the bound has sizes within percent/100 of each other: same or next size class
    step = math.log(100 / percent) if percent < 100 else 1.0
    held = materialize(reps.join(member, "id").select(
        "id", "n", "cluster", F.floor(F.log(F.col("n").cast("double")) / F.lit(step)).cast("int").alias("s"),
        "key", "sig"))
    sizes = held.groupBy("cluster", "s").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("c"))

    def near(shift: int, name: str) -> DataFrame:
        return sizes.select("cluster", (F.col("s") + shift).alias("s"), F.col("c").alias(name))

    placed = held.join(near(0, "c"), ["cluster", "s"]).join(near(-1, "up"), ["cluster", "s"], "left") \
        .join(near(1, "down"), ["cluster", "s"], "left") \
        .withColumn("b", F.pmod(F.xxhash64("id"), F.col("c").cast("long")).cast("int"))

    def upto(c: str):
        return F.when(F.col(c) > 0, F.sequence(F.lit(0), F.col(c) - 1)).otherwise(F.array().cast("array<int>"))

    unit = F.concat(
        F.transform(upto("c"), lambda j: F.struct(
            F.col("s").alias("s1"), F.col("s").alias("s2"), F.least("b", j).alias("b1"), F.greatest("b", j).alias("b2"),
            F.when(F.col("b") == j, 2).when(F.col("b") < j, 0).otherwise(1).alias("side"))),
        F.transform(F.coalesce(upto("up"), F.array().cast("array<int>")), lambda j: F.struct(
            F.col("s").alias("s1"), (F.col("s") + 1).alias("s2"), F.col("b").alias("b1"), j.alias("b2"),
            F.lit(0).alias("side"))),
        F.transform(F.coalesce(upto("down"), F.array().cast("array<int>")), lambda j: F.struct(
            (F.col("s") - 1).alias("s1"), F.col("s").alias("s2"), j.alias("b1"), F.col("b").alias("b2"),
            F.lit(1).alias("side"))))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")) \
        .join(held.select("id"), "id", "left_semi")
    grams = shingle_blobs(texts, size).dropDuplicates(["id", "grams"])
    units = placed.join(grams, "id").select("id", "sig", "grams", "cluster", F.explode(unit).alias("q")) \
        .select("cluster", "q.*", "id", "sig", "grams")
    return units.groupBy("cluster", "s1", "s2", "b1", "b2").applyInArrow(_confirm(percent, t), "u long, v long")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, k: int = 64, seed: int = 1) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (smallest reachable doc_id), kept."""
    ship(docs.sparkSession)
    t = match_threshold(k, percent)
    sigs = materialize(signatures(docs, size, k, seed))
    links = duplicate_links(docs, sigs, size, percent, k, t)
    # documents of a class (and rows of a document) are linked with its smallest id
    low = sigs.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("v"))
    same = sigs.where("doc_id IS NOT NULL").join(low, "key").where("doc_id != v") \
        .select(F.col("doc_id").alias("u"), "v")
    comp = components(links.unionByName(same)).withColumnRenamed("id", "doc_id")
    return sigs.select("doc_id", "n_shingles").join(comp, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
        (F.col("doc_id").isNull() | (F.col("doc_id") == F.coalesce("component_id", "doc_id"))).alias("kept"))


def keep_one(docs: DataFrame, **params) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the smallest doc_id's, null ids last.

    Rows are compared, not ids: rows that share an id but differ stay unless
    their texts are near copies; rows equal in every column count as one, with
    or without an id. Texts without a word are linked with nothing and all stay.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.withColumns({f"__row{i}": F.xxhash64(F.lit(i), *columns) for i in range(2)})
    full = F.coalesce(F.rlike(F.col("text").cast("string"), F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))
    worded = rows.where(full)
    near = near_duplicates(worded.select(F.col("__row0").alias("doc_id"), "text"), **params)
    first = F.min(F.struct(F.col("__id").isNull().alias("none"), "__id", "__row0")).alias("first")
    kept = worded.select("__row0", F.col("doc_id").alias("__id")) \
        .join(near.select(F.col("doc_id").alias("__row0"), "component_id"), "__row0") \
        .groupBy("component_id").agg(first).select("first.__row0")
    stay = worded.join(kept, "__row0", "left_semi").dropDuplicates(["__row0", "__row1"])
    return stay.unionByName(rows.where(~full)).drop("__row0", "__row1")


def op1_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document: 3-word shingles, links at 85 % similarity."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=3, percent=85)


# From the definition: every pair of documents that shares a shingle, then reachability.
_ORACLE = r"""
WITH RECURSIVE
w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) < 3 THEN list_slice([array_to_string(w, ' ')], 1, least(len(w), 1))
        ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
x AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT p.a, p.b FROM p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, c.component_id, n.doc_id = c.component_id AS kept FROM n JOIN c USING (doc_id)
"""
QUERIES = {"op1_minhash_near_dedup": op1_minhash_near_dedup}
ORACLES = {"op1_minhash_near_dedup": _ORACLE}
