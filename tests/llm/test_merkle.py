"""Merkle manifest: whole trees by brute force, ragged butterflies, odd rows."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from concordia.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, drop=False):
    doc_id, text, lang, source, n = r
    text = text.replace("\n", "") if drop and text is not None else text
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n, text)])


def tree(nodes, fanout=3):
    """Root, and per leaf its (siblings before, siblings after) level by level."""
    paths = [[] for _ in nodes]
    under = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(i, min(i + fanout, len(nodes))) for i in range(0, len(nodes), fanout)]
        for run in runs:
            for k in run:
                for i in under[k]:
                    paths[i].append(([nodes[j] for j in run if j < k], [nodes[j] for j in run if j > k]))
        nodes, under = [h(*[nodes[j] for j in run]) for run in runs], [sum((under[j] for j in run), []) for run in runs]
    return nodes[0], paths


def brute(rows, fanout=3):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subs = {}
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        subs[s] = tree([leaf(r) for r in groups[s]], fanout)
    root, tops = tree([subs[s][0] for s in order], fanout) if order else (None, [])
    out = []
    for s, top in zip(order, tops):
        for r, path in zip(groups[s], subs[s][1]):
            steps = path + top
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            f = leaf(r, drop=hit)
            for a, b in steps:
                f = h(*a, f, *b)
            out.append((r[0], leaf(r), subs[s][0], root, h(*[x for a, b in steps for x in a + b]), f, f == root))
    return sorted(out, key=str)


def run(spark, rows, **params):
    docs = spark.createDataFrame(rows, SCHEMA)
    tampered = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.contains("text", F.lit("\n"))
    changed = merkle.leaf(*[F.translate("text", "\n", "") if f == "text" else F.col(f) for f in merkle.FIELDS])
    got = merkle.manifest(docs, seen=F.when(tampered, changed), **params)
    return sorted([tuple(r) for r in got.collect()], key=str)


def rows_of(sizes):
    out, i = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            out.append((i, f"line {i}\nmore é\n" if i % 4 else f"plain {i}", "en", s, i))
            i += 1
    return out


@pytest.mark.parametrize("levels", [0, 1, 2, 7])
def test_every_chunk_size_gives_the_whole_tree(spark, levels):
    rows = rows_of({"a": 1, "b": 2, "c": 3, "d": 5, "e": 10, "f": 31, None: 28, "": 4})
    assert run(spark, rows, levels=levels) == brute(rows)


def test_butterfly_of_every_ragged_size(spark):
    rows = rows_of({f"s{n:02d}": n for n in range(1, 30)})
    assert run(spark, rows, levels=0) == brute(rows)


def test_other_fanout(spark):
    rows = rows_of({"a": 13, "b": 6})
    assert run(spark, rows, fanout=2, levels=1) == brute(rows, fanout=2)


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, "x\ny", None, None, 3), (7, "", "", "", 0), (7, "", "", "", 0),
            (7, "other", None, "", 1), (8, "a\n" * 200_000, "de", "s", 400_000), (9, "\n", "de", "s", 1)]
    assert run(spark, rows) == brute(rows)


def test_one_row_and_no_row(spark):
    rows = [(0, "only\n", "en", "s", 5)]
    got = run(spark, rows)
    assert got == brute(rows)
    assert got[0][1] == got[0][2] == got[0][3]
    assert run(spark, []) == []


def test_clashing_extra_columns_are_ignored(spark):
    rows = rows_of({"a": 7, "b": 2})
    extra = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("key", "chunk", "at", "digest", "seen", "root")})
    got = sorted(map(tuple, merkle.manifest(extra).select("doc_id", "proof_sha256").collect()))
    assert got == sorted((r[0], r[4]) for r in brute(rows))


def test_a_changed_text_fails_and_an_unchanged_one_holds(spark):
    rows = rows_of({"a": 40})
    for r in run(spark, rows, levels=1):
        changed = zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[0] % 4 != 0
        assert r[6] is not changed


def test_every_leaf_is_folded(spark):
    """A wrong root is noticed by rows whose text did not change, too: none takes the root for its folded digest."""
    merkle.ship(spark)
    leaves = spark.range(12).select(F.col("id").alias("doc_id"), F.lit("=a").alias("key"),
                                    F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"), F.lit(None).cast("binary").alias("seen"))
    ranked = merkle.numbered(leaves, [F.col("doc_id").asc()], levels=1)
    uppers = merkle.upper_paths(ranked, levels=1).withColumnRenamed("digest", "subroot").withColumn("root", F.lit("0" * 64))
    got = merkle.checked(ranked, uppers).collect()
    right, _ = tree([h(str(i)) for i in range(12)])
    assert {r["folded_root"] for r in got} == {right} and {r["root"] for r in got} == {"0" * 64} and len(got) == 12
