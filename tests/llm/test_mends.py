"""Long runs, tied blocks, shared ids, wide signatures and short parts."""

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from concordia.llm import ann, minhash, mixing, shingles, tokens

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("sign", [" ", "\n", "a", "7", "=", "　", "\t "])
def test_tokens_of_a_million_equal_characters(spark, sign):
    run = sign * (1_000_000 // len(sign))
    rows = [(1, f"before{run}after"), (2, run), (3, f"x{run}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in tokens.section_tokens(docs).groupBy("doc_id").agg(
        F.sum("n_tokens").alias("n"), F.max("end_char").alias("end")).collect()}
    assert [got[i]["end"] for i in (1, 2, 3)] == [len(t) for _, t in rows]
    assert got[1]["n"] > 2 and got[2]["n"] > 1


def test_long_white_space_is_encoded_as_by_the_library():
    enc, _ = tokens.encoder(tokens.ranks_path())
    for space in (" " * 12_000, "\n" * 10_001, " \t" * 9_000, "　" * 11_000, " " * 10_000, " " * 30_000 + "\n"):
        for text in (space, "a" + space, space + "b", "a" + space + "b  c" + space, space + "\x1c" + space + "日"):
            assert tokens.encode_whole(enc, text) == enc.encode_ordinary(text)


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_a_tied_block_does_not_stop_the_filling(spark, seed):
    # source a holds 200 equal rows of 50 words and 1,000 of 10 words; b is large, so a's target is a fraction of a
    rows = [(7, " ".join(["same"] * 50), "en", "a", 1)] * 200
    rows += [(100 + i, " ".join([f"w{i}"] * 10), "en", "a", 1) for i in range(1000)]
    docs = spark.createDataFrame(rows, DOC)
    goal = 9_500
    got = mixing.plan_mix(docs, F.array("source"), mixing.n_words(F.col("text")), lambda sizes: {"a": goal}, seed=seed)
    taken = got.select(F.sum(F.col("__size") * F.size("__uses"))).first()[0]
    assert goal * 0.99 <= taken <= goal


def test_rows_that_share_an_id_but_not_a_text_all_stay(spark):
    a, b, c = (" ".join(f"{p}{i}" for i in range(40)) for p in "abc")
    rows = [(1, a, "en", "s", 1), (1, b, "en", "s", 1), (2, a + " more", "en", "s", 1), (3, c, "en", "s", 1), (3, c, "en", "s", 1),
            (3, c, "en", "t", 1), (None, b + " tail", "en", "s", 1), (None, "only here and nowhere else at all", "en", "s", 1),
            (None, "only here and nowhere else at all", "en", "s", 1), (5, "", "en", "s", 0), (5, "", "en", "s", 0), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOC).withColumn("component_id", F.lit("x"))
    first = None
    for parts in (1, 5):
        kept = minhash.keep_one(docs.repartition(parts), size=5, percent=80)
        assert kept.columns == docs.columns
        got = sorted(kept.select("doc_id", "text").collect(), key=str)
        want = [(1, a), (1, b), (3, c), (None, "only here and nowhere else at all"), (5, ""), (5, ""), (None, None)]
        assert got == sorted((Row(doc_id=i, text=t) for i, t in want), key=str)
        first = first or got
        assert got == first


def test_unrelated_sets_share_no_signature_value():
    rng = np.random.default_rng(1)
    params = shingles.minhash_params(64, 1)
    sigs = np.stack([shingles.minhash(rng.integers(0, 2**63, 200, dtype=np.uint64), params) for _ in range(4000)])
    assert sigs.dtype == np.int64
    for j in range(64):
        assert len(np.unique(sigs[:, j])) == len(sigs)


def test_queries_of_a_small_part_visit_the_rest(spark):
    # a tight group of 5 far from all others: its queries need other parts to find 20
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(8, 6)) * 10
    x = np.concatenate([centres[i % 8] + rng.normal(size=6) for i in range(800)]).reshape(-1, 6)
    x[:5] = 0.01 * rng.normal(size=(5, 6)) + 1e-3
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, k=150, parts=8, sample=800, recall=0.05)
    assert {r["n"] for r in got.groupBy("query_id").agg(F.count("*").alias("n")).collect()} == {150}


def test_parts_are_left_out_on_small_tables(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(16, 12)) * 4
    x = np.stack([centres[i % 16] + rng.normal(size=12) for i in range(1500)])
    router = ann.fit(x, parts=16, k=20, recall=0.95)
    assert router.probes <= router.weight.shape[1] // 2
