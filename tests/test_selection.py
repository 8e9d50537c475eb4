"""Rows of smallest hash by range refinement: exact counts, ties, groups."""

import pytest
from pyspark.sql import functions as F

from concordia.functions import selection as sel
from concordia.functions.hashing import uhash32
from concordia.operators import sample as sm


def smallest(rows, n):
    return {k for _, k in sorted((h, k) for h, k in rows)[:n]}


def test_downsample_takes_the_smallest_hashes(spark):
    df = spark.range(3000).withColumn("payload", F.col("id") * 2)
    rows = [(r["h"], r["id"]) for r in df.select("id", uhash32(7, "id").alias("h")).collect()]
    for n in (0, 1, 137, 2999, 3000, 9000):
        got = sm.exact_downsample(df, "id", n, seed=7)
        assert got.columns == ["id", "payload"]
        assert {r["id"] for r in got.collect()} == smallest(rows, n)


def test_nothing_is_range_partitioned_or_sorted(spark):
    plan = sm.exact_downsample(spark.range(500), "id", 50)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "Sort" not in plan and "Window" not in plan


def test_rows_that_share_the_last_hash(spark):
    # a key repeated 40 times, and a hash cut down so that different keys tie
    df = spark.createDataFrame([(i % 25, i) for i in range(1000)], "k int, id long")
    for n in (1, 39, 40, 41, 500, 999):
        got = sm.exact_downsample(df, "k", n)
        assert got.count() == n
    small = sel.with_smallest(df, "k", lambda s: {g: 7 for g in s}, "k")
    assert {r["k"]: r["n"] for r in small.where("__chosen").groupBy("k").agg(F.count("*").alias("n")).collect()} == dict.fromkeys(range(25), 7)


@pytest.mark.parametrize("label", ["string", "int"])
def test_split_by_class(spark, label):
    df = spark.range(2003).select("id", F.when(F.col("id") % 10 < 6, 1).when(F.col("id") % 10 < 9, 2)
                                  .when(F.col("id") % 100 == 9, None).otherwise(3).cast(label).alias("a.b"))
    got = sm.stratified_split(df.withColumnRenamed("a.b", "y"), "id", "y")
    count = {(r["y"], r["split"]): r["n"] for r in got.groupBy("y", "split").agg(F.count("*").alias("n")).collect()}
    sizes = {y: sum(n for (c, _), n in count.items() if c == y) for y, _ in count}
    assert sum(n for (_, s), n in count.items() if s == "test") == 601 and sum(sizes.values()) == 2003
    assert all(abs(count.get((y, "test"), 0) - 0.3 * n) < 1.2 for y, n in sizes.items())
    hashes = [(r["h"], r["id"]) for r in got.where("y = 2").select("id", uhash32(42, "id").alias("h")).collect()]
    chosen = {r["id"] for r in got.where("y = 2 AND split = 'test'").collect()}
    assert chosen == smallest(hashes, len(chosen))


def test_no_rows_and_too_many_groups(spark, monkeypatch):
    empty = spark.range(0).withColumn("y", F.lit(1))
    assert sm.exact_downsample(empty, "id", 5).collect() == []
    assert sm.stratified_split(empty, "id", "y").collect() == []
    monkeypatch.setattr(sel, "MAX_GROUPS", 10)
    with pytest.raises(ValueError, match="more than 10 groups"):
        sm.stratified_split(spark.range(50).withColumn("y", F.col("id")), "id", "y")
