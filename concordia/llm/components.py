"""Connected components of a distributed edge list (alternating large and small stars).

Each round rewires every vertex to the smallest neighbour it knows; minima are
partial aggregates, so a hub's edges are combined before the shuffle. Every
round is checkpointed in ``spark.checkpoint.dir``: lineage stays short and a
lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def _state(edges: DataFrame):
    row = edges.agg(F.count("*").alias("n"),
                    F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``(id, component_id)`` for every vertex on an edge; the component is its smallest vertex.

    Self loops and repeated edges are fine; edges with a null end are ignored;
    an empty edge list gives an empty table.
    """
    given = materialize(edges.where(F.col(u).isNotNull() & F.col(v).isNotNull())
                        .select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct())
    loops = given.where("u = v").select("u")
    e = given.where("u != v")
    state = _state(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: every larger neighbour points at the smallest vertex in reach
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .where("u != v").distinct()
        # small star: a vertex's smaller neighbours, and the vertex, point at the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        e = materialize(small.select(F.col("v").alias("u"), F.col("m").alias("v"))
                        .unionByName(low.select("u", F.col("m").alias("v")))
                        .where("u != v").distinct())
        new = _state(e)
        if new == state:
            break
        state = new
    roots = e.select(F.col("v").alias("id")).distinct()
    out = e.select(F.col("u").alias("id"), F.col("v").alias("component_id")) \
        .unionByName(roots.select("id", F.col("id").alias("component_id"))) \
        .unionByName(loops.select(F.col("u").alias("id"), F.col("u").alias("component_id")))
    return out.groupBy("id").agg(F.min("component_id").alias("component_id"))
