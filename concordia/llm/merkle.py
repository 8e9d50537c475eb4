"""Operator 13: Merkle manifest of a dataset by butterfly exchange.

Every row is a leaf digest. The leaves of a group (by default a source), in
order, form a tree of fixed fanout: while several nodes remain, every
``fanout`` consecutive ones (the last run may be shorter, even one) become the
digest of their concatenated digests. The groups' roots, in order, form the
tree of the whole dataset in the same way.

How it runs: leaves are numbered in their group by distributed prefix sums and
cut into aligned chunks of ``fanout ** CHUNK_LEVELS`` (a group that holds a
third of all rows is many chunks). A chunk hashes its own levels in one task.
Then the chunks swap subtree roots: in round r those whose numbers differ in
digit r (base ``fanout``) alone meet, each brings the root of its aligned block
of ``fanout ** r`` chunks, and each of them hashes the parent. So every chunk
holds the path to the root when the rounds end; nothing is passed down again.
An incomplete last block has fewer members than its partners; member m then
also meets the partners whose number within the block is m modulo its size.
A round is one shuffle of a row or two a chunk, and there are log(chunks) of them.

Texts are hashed where they are read and never shuffled.

Defined results: a null field counts as ``-``, an empty text as ``0:``; rows
with equal ids are ordered by their digest, so repeated rows are a leaf each
and reruns agree; a null id comes first; a null group is a group of its own and
comes first; a lone leaf is its group's root, and a lone group's root the
dataset's; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import prefix_sums
from ..session import materialize
from .shipping import ship

FANOUT = 3
#: Levels hashed within one task: a chunk is ``FANOUT ** CHUNK_LEVELS`` leaves.
CHUNK_LEVELS = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEP = "struct<place:int,others:array<string>>"


def sha(parts: Sequence[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(c: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    s = c.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf(*fields: Column) -> Column:
    """Digest of a row, 32 bytes."""
    return F.unhex(F.sha2(F.concat(*[field(c) for c in fields]), 256))


def group_key(c: Column) -> Column:
    """A key that is never null and sorts like ``c`` by UTF-8 bytes with null first."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def numbered(leaves: DataFrame, order: Sequence[Column], fanout: int = FANOUT, levels: int = CHUNK_LEVELS) -> DataFrame:
    """Adds ``chunk`` and the place ``at`` within it, in ``order`` within ``key``; written once."""
    size = fanout ** levels
    ranked = prefix_sums(leaves, order, {"__rn": F.lit(1).cast("bigint")}, ["key"])
    return materialize(ranked.select("*", F.floor((F.col("__rn") - 1) / size).cast("long").alias("chunk"),
                                     ((F.col("__rn") - 1) % size).cast("int").alias("at")).drop("__rn"))


def tree_levels(digests: list[str], fanout: int = FANOUT) -> list[list[str]]:
    """All levels of a tree, leaves first, the last of one node."""
    out = [digests]
    while len(out[-1]) > 1:
        below = out[-1]
        out.append([sha(below[i:i + fanout]) for i in range(0, len(below), fanout)])
    return out


def path(levels: list[list[str]], i: int, fanout: int = FANOUT) -> list[tuple[int, list[str]]]:
    """``(place, siblings left to right)`` of leaf ``i`` at every level below the root."""
    out = []
    for nodes in levels[:-1]:
        lo = i - i % fanout
        run = nodes[lo:lo + fanout]
        out.append((i - lo, run[:i - lo] + run[i - lo + 1:]))
        i //= fanout
    return out


def fold(digest: str, steps) -> str:
    """The root that a leaf's digest and its path give."""
    for place, others in steps:
        digest = sha([*others[:place], digest, *others[place:]])
    return digest


def chunk_roots(ranked: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """``(key, chunk, digest, height)``: the root of every chunk's own levels, hashed in one task a chunk."""
    def run(key, table):
        order = table.column("at").to_numpy().argsort()
        levels = tree_levels([table.column("digest")[int(i)].as_py().hex() for i in order], fanout)
        return pa.table({"key": [key[0].as_py()], "chunk": [key[1].as_py()], "digest": [levels[-1][0]],
                         "height": pa.array([len(levels) - 1], pa.int32())})

    return ranked.select("key", "chunk", "at", "digest").groupBy("key", "chunk") \
        .applyInArrow(run, "key string, chunk long, digest string, height int")


def butterfly(nodes: DataFrame, rounds: int, fanout: int = FANOUT) -> DataFrame:
    """``(key, chunk, digest, proof)``: every chunk with its group's root and the path up to it.

    ``nodes``: ``(key, chunk, digest, n)``, chunks numbered from 0, ``n`` a group's number of chunks.
    """
    state = nodes.withColumn("proof", F.expr(f"cast(array() as array<{_STEP}>)"))
    for r in range(rounds):
        step = fanout ** r
        state = state.withColumns({"block": F.expr(f"chunk div {step}"), "low": F.col("chunk") % step}) \
            .withColumns({"parent": F.expr(f"block div {fanout}"), "place": (F.col("block") % fanout).cast("int"),
                          "size": F.least(F.lit(step).cast("long"), F.col("n") - F.col("block") * step)})
        # an incomplete block's members also meet the partners that find no member of their own number
        more = F.when((F.col("place") > 0) & (F.col("low") + F.col("size") < step),
                      F.sequence(F.col("low") + F.col("size"), F.lit(step - 1).cast("long"), F.col("size"))) \
            .otherwise(F.expr("cast(array() as array<bigint>)"))
        top = F.col("n") <= step  # this group has one node left: nobody to meet
        sent = state.withColumn("top", top).withColumn("meeting", F.explode(
            F.when(top, F.array("low")).otherwise(F.concat(F.array("low"), more)))) \
            .withColumn("own", F.col("meeting") == F.col("low")) \
            .withColumn("proof", F.when(F.col("own"), F.col("proof"))) \
            .select("key", "n", "parent", "meeting", "top", F.struct("place", "digest", "own", "chunk", "proof").alias("m"))
        met = sent.groupBy("key", "n", "parent", "meeting", "top").agg(F.sort_array(F.collect_list("m")).alias("ms"))
        root = F.when(F.col("top"), F.col("ms")[0]["digest"]) \
            .otherwise(F.sha2(F.array_join(F.col("ms")["digest"], ""), 256))
        each = met.select("key", "n", "top", "ms", root.alias("digest"), F.explode("ms").alias("m")).where("m.own")
        others = F.transform(F.filter("ms", lambda x: x["place"] != F.col("m.place")), lambda x: x["digest"])
        grown = F.concat(F.col("m.proof"), F.array(F.struct(F.col("m.place").alias("place"), others.alias("others"))))
        state = each.select("key", F.col("m.chunk").alias("chunk"), "n", "digest",
                            F.when(F.col("top"), F.col("m.proof")).otherwise(grown).alias("proof"))
    return state.select("key", "chunk", "digest", "proof")


def upper_paths(ranked: DataFrame, fanout: int = FANOUT, levels: int = CHUNK_LEVELS) -> DataFrame:
    """``(key, chunk, lone, digest, proof)``: a chunk's path from its own root to its group's root.

    ``lone``: how often a last chunk's root is hashed alone until it stands beside the other chunks' roots.
    """
    chunks = materialize(chunk_roots(ranked, fanout))
    sizes = chunks.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    most = sizes.agg(F.max("n")).first()[0] or 1
    nodes = chunks.join(sizes, "key").withColumn("lone", F.when(F.col("n") > 1, levels - F.col("height")).otherwise(0))
    digest = F.col("digest")
    for k in range(levels):
        nodes = nodes.withColumn("digest", F.when(F.col("lone") > k, F.sha2(digest, 256)).otherwise(digest))
    rounds = 0
    while fanout ** rounds < most:
        rounds += 1
    up = butterfly(nodes.select("key", "chunk", "digest", "n"), rounds, fanout)
    return materialize(up.join(nodes.select("key", "chunk", "lone"), ["key", "chunk"]))


def _leaf_steps(table, upper, fanout):
    """Per leaf of a chunk ``(row, digest, path to the root)``."""
    order = table.column("at").to_numpy().argsort()
    digests = [table.column("digest")[int(i)].as_py().hex() for i in order]
    levels = tree_levels(digests, fanout)
    above = [(0, [])] * upper.column("lone")[0].as_py() + \
        [(s["place"], s["others"]) for s in upper.column("proof")[0].as_py()]
    for i, row in enumerate(order):
        yield int(row), digests[i], path(levels, i, fanout) + above


def proofs(ranked: DataFrame, uppers: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """``(key, chunk, at, digest, root, proof)``: every leaf with its full path as an array of steps."""
    def run(table, upper):
        out = [(row, d, steps) for row, d, steps in _leaf_steps(table, upper, fanout)]
        rows = pa.array([row for row, _, _ in out])
        return pa.table({
            "key": table.column("key").take(rows), "chunk": table.column("chunk").take(rows),
            "at": table.column("at").take(rows), "digest": pa.array([d for _, d, _ in out]),
            "root": pa.array([upper.column("digest")[0].as_py()] * len(out), pa.string()),
            "proof": pa.array([[{"place": p, "others": o} for p, o in steps] for _, _, steps in out],
                              pa.list_(pa.struct([("place", pa.int32()), ("others", pa.list_(pa.string()))])))})

    ship(ranked.sparkSession)
    return ranked.select("key", "chunk", "at", "digest").groupBy("key", "chunk") \
        .cogroup(uppers.groupBy("key", "chunk")) \
        .applyInArrow(run, f"key string, chunk long, at int, digest string, root string, proof array<{_STEP}>")


def checked(ranked: DataFrame, uppers: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """``(doc_id, key, leaf, proof_sha256, folded_root)``; ``seen``, if not null, is the digest found on checking, else
    the leaf's own: every row is folded along its path."""
    def run(table, upper):
        rows, leaves, marks, folded = [], [], [], []
        root = upper.column("root")[0].as_py()
        for row, digest, steps in _leaf_steps(table, upper, fanout):
            seen = table.column("seen")[row].as_py()
            rows.append(row)
            leaves.append(digest)
            marks.append(sha([d for _, others in steps for d in others]))
            folded.append(fold(digest if seen is None else seen.hex(), steps))
        at = pa.array(rows, pa.int64())
        return pa.table({"doc_id": table.column("doc_id").take(at), "key": table.column("key").take(at),
                         "leaf": pa.array(leaves, pa.string()), "proof_sha256": pa.array(marks, pa.string()),
                         "folded_root": pa.array(folded, pa.string()),
                         "subroot": pa.array([upper.column("subroot")[0].as_py()] * len(rows), pa.string()),
                         "root": pa.array([root] * len(rows), pa.string())})

    return ranked.groupBy("key", "chunk").cogroup(uppers.groupBy("key", "chunk")).applyInArrow(
        run, "doc_id long, key string, leaf string, proof_sha256 string, folded_root string, subroot string, root string")


def manifest(docs: DataFrame, seen: Column | None = None, fields: Sequence[str] = FIELDS, group: str = "source",
             fanout: int = FANOUT, levels: int = CHUNK_LEVELS) -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)`` per row.

    ``seen``: a digest to check in place of the row's own; null where nothing changed.
    """
    ship(docs.sparkSession)
    leaves = docs.select(F.col("doc_id").cast("long").alias("doc_id"), group_key(F.col(group)).alias("key"),
                         leaf(*[F.col(f) for f in fields]).alias("digest"),
                         (F.lit(None).cast("binary") if seen is None else seen).alias("seen"))
    ranked = numbered(leaves, [F.col("doc_id").asc_nulls_first(), F.col("digest").asc()], fanout, levels)
    uppers = upper_paths(ranked, fanout, levels)
    # the groups' roots are the leaves of the tree above, built the same way
    groups = uppers.where("chunk = 0").select(F.lit("").alias("key"), F.col("key").alias("group"),
                                              F.unhex("digest").alias("digest"))
    over = numbered(groups, [F.col("group").asc()], fanout, levels)
    tops = proofs(over, upper_paths(over, fanout, levels), fanout) \
        .join(over.select("chunk", "at", "group"), ["chunk", "at"]) \
        .select(F.col("group").alias("key"), "root", F.col("proof").alias("top"))
    whole = uppers.withColumnRenamed("digest", "subroot").join(tops, "key") \
        .select("key", "chunk", "lone", "subroot", "root", F.concat("proof", "top").alias("proof"))
    got = checked(ranked, whole, fanout)
    return got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root",
                      (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Manifest of the documents, checked against copies whose line breaks are gone where 2 divides the id's crc32."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tampered = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.contains("text", F.lit("\n"))
    changed = leaf(*[F.translate("text", "\n", "") if f == "text" else F.col(f) for f in FIELDS])
    return manifest(docs, seen=F.when(tampered, changed))


def _crc32_sql(text: str) -> str:
    """Unsigned crc32 of a text of ASCII characters, bit by bit."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) "
            "WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END), 4294967295::BIGINT)")


def _tree_sql(name: str, base: str, depth: int) -> str:
    """CTEs ``name0..name{depth}`` (k, i, h, n) of a tree over ``base`` (k, i, h, n), and siblings ``name{l}s``."""
    out = []
    for level in range(depth + 1):
        if level == 0:
            out.append(f"{name}0 AS MATERIALIZED (SELECT k, i, h, n FROM {base})")
        else:
            below = f"{name}{level - 1}"
            out.append(f"{name}{level} AS MATERIALIZED (SELECT k, i // 3 AS i, CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY i))"
                       f" ELSE max(h) END AS h, (n + 2) // 3 AS n FROM {below} GROUP BY k, i // 3, n)")
        here = f"{name}{level}"
        out.append(f"{here}s AS MATERIALIZED (SELECT a.k, a.i, a.n, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, "
                   f"coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r "
                   f"FROM {here} a JOIN {here} b ON a.k = b.k AND a.i // 3 = b.i // 3 GROUP BY a.k, a.i, a.n)")
    return ", ".join(out)


def _fold_sql(name: str, start: str, depth: int, prefix: str, key: str, place: str) -> str:
    """CTEs that carry ``proof`` and the folded digest ``f`` of every row of ``start`` up one tree."""
    out, prev = [], start
    for level in range(depth):
        out.append(f"{prefix}{level} AS MATERIALIZED (SELECT x.* EXCLUDE (proof, f), x.proof || s.l || s.r AS proof, "
                   f"CASE WHEN s.n > 1 THEN sha256(s.l || x.f || s.r) ELSE x.f END AS f "
                   f"FROM {prev} x JOIN {name}{level}s s ON s.k = x.{key} AND s.i = x.{place} // {3 ** level})")
        prev = f"{prefix}{level}"
    return ", ".join(out)


def _oracle(depth: int = 11, top: int = 5) -> str:
    def row(text):
        cells = [f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR END"
                 for c in ("doc_id", "source", "lang", "n_chars")]
        cells.append(f"CASE WHEN text IS NULL THEN '-' ELSE octet_length(encode({text})) || ':' || {text} END")
        return f"sha256({' || '.join(cells)})"

    return f"""WITH d AS MATERIALIZED (SELECT doc_id, coalesce('=' || source, '') AS k, {row('text')} AS leaf,
        CASE WHEN {_crc32_sql('doc_id::VARCHAR')} % 2 = 0 THEN {row("replace(text, chr(10), '')")} ELSE {row('text')} END AS seen
        FROM documents),
    o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS h,
        count(*) OVER (PARTITION BY k) AS n FROM d),
    {_tree_sql('t', 'o', depth)},
    g AS MATERIALIZED (SELECT '' AS k, k AS src, h, row_number() OVER (ORDER BY encode(k)) - 1 AS i, count(*) OVER () AS n
        FROM t{depth}),
    {_tree_sql('u', 'g', top)},
    start AS (SELECT o.doc_id, o.k, o.i, o.leaf, g.i AS gi, '' AS gk, g.h AS subroot, '' AS proof, o.seen AS f
        FROM o JOIN g ON g.src = o.k),
    {_fold_sql('t', 'start', depth, 'p', 'k', 'i')},
    {_fold_sql('u', f'p{depth - 1}', top, 'q', 'gk', 'gi')}
    SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified
    FROM q{top - 1}, (SELECT h AS root FROM u{top})"""


QUERIES = {"op13_merkle_manifest": op13_merkle_manifest}
#: Eleven levels in a source and five over the sources hold 177,147 documents a source and 243 sources.
ORACLES = {"op13_merkle_manifest": _oracle()}
