"""Operator 5: mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong
to) into token capacity. A min-cost flow over (patterns, sources) routes that
capacity to the sources' quotas; a pattern's capacity can be used ``max_repeat``
times, every further use at a higher price (convex), so repetition is the last
resort. A pattern's flow is a number of whole uses of all its documents plus a
rest, and the rest is taken by seeded documents: in the order of a seeded hash,
as many as fit, found by refining hash ranges with partial sums (no sort, no
pass over a whole source in one task). What the last range leaves is filled with
smaller documents further on in the same order, and then with one more use of
small documents, until the gap is under ``tolerance`` of the flow or nothing fits. The outcome is a rule a pattern
(uses, hash ranges, size limits), applied map-side: no text is shuffled.

The flow is solved on the driver; it sees one row a membership pattern, never
documents.

Defined results: null texts have size 0 and are never taken; a null source is a
source of its own, ordered last; empty tables give empty results; rows equal in
id and text are taken together or not at all; no document is taken more than
``max_repeat`` times.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

MAX_REPEAT = 3
SEED = 11
TOLERANCE = 0.0005
HASH_BITS = 60
LEVEL_BITS = 10
#: Price of the first, second and third use of a document.
PRICES = (0, 1, 3)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def by_code_point(sources) -> list:
    return sorted((s for s in sources if s is not None)) + [None] * (None in sources)


def capped_targets(sizes: dict, weights: dict, max_repeat: int = MAX_REPEAT) -> dict:
    """Share the total by weight; no target over ``max_repeat`` sizes, the excess shared again."""
    names = by_code_point(sizes)
    total = float(sum(sizes.values()))
    targets, open_ = {}, list(names)
    while open_:
        rest = total - sum(targets.values())
        weight = sum(weights[s] for s in open_)
        share = {s: rest * weights[s] / weight for s in open_}
        over = [s for s in open_ if share[s] > max_repeat * sizes[s]]
        if not over:
            return targets | share
        targets |= {s: float(max_repeat * sizes[s]) for s in over}
        open_ = [s for s in open_ if s not in targets]
    return targets


def min_cost_flow(capacity: Sequence[int], members: Sequence[Sequence[int]], quota: Sequence[int],
                  prices: Sequence[int] = PRICES) -> list[dict[int, int]]:
    """Words each pattern sends to each of its sources: as much as the quotas and uses admit, at least price.

    Successive cheapest paths; every path fills an arc or a quota.
    """
    n, m = len(capacity), len(quota)
    start, sink = n + m, n + m + 1
    arcs: list[list[int]] = []  # to, room, price; arc k and its reverse k ^ 1
    out: list[list[int]] = [[] for _ in range(n + m + 2)]

    def arc(a, b, room, price):
        out[a].append(len(arcs))
        arcs.append([b, room, price])
        out[b].append(len(arcs))
        arcs.append([a, 0, -price])

    for p in range(n):
        for price in prices:
            arc(start, p, capacity[p], price)
    for p in range(n):
        for s in members[p]:
            arc(p, n + s, sum(quota) + 1, 0)
    for s in range(m):
        arc(n + s, sink, quota[s], 0)
    potential = [0] * (n + m + 2)
    while True:
        dist, via = [None] * len(out), [-1] * len(out)
        dist[start] = 0
        heap = [(0, start)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > dist[a]:
                continue
            for k in out[a]:
                b, room, price = arcs[k]
                if room > 0:
                    e = d + price + potential[a] - potential[b]
                    if dist[b] is None or e < dist[b]:
                        dist[b], via[b] = e, k
                        heapq.heappush(heap, (e, b))
        if dist[sink] is None:
            break
        far = max(d for d in dist if d is not None)
        potential = [h + (d if d is not None else far) for h, d in zip(potential, dist)]
        path, b = [], sink
        while b != start:
            path.append(via[b])
            b = arcs[via[b] ^ 1][0]
        push = min(arcs[k][1] for k in path)
        for k in path:
            arcs[k][1] -= push
            arcs[k ^ 1][1] += push
    return [{arcs[k][0] - n: arcs[k ^ 1][1] for k in out[p] if n <= arcs[k][0] < n + m and not k & 1 and arcs[k ^ 1][1]}
            for p in range(n)]


def _ranges(table: DataFrame, need: dict[int, int], least: dict[int, int], largest: dict[int, int],
            stop: dict[int, float]):
    """Per pattern the hash up to which documents (from ``least`` on, of at most ``largest`` words) fit in ``need``.

    Each round splits the range that overflows into 2^LEVEL_BITS; sums are
    partial aggregates and one row a pattern comes back. Returns
    ``{pattern: (end of the range, words in it)}``.
    """
    spark = table.sparkSession
    state = {p: [0, 0, need[p]] for p in need}  # prefix bits, words taken, words left
    end, open_, bits = {}, set(need), 0
    while open_ and bits < HASH_BITS:
        step = min(LEVEL_BITS, HASH_BITS - bits)
        shift = HASH_BITS - bits - step
        now = spark.createDataFrame([(p, state[p][0], state[p][2], least[p], largest[p]) for p in sorted(open_)],
                                    "pattern int, prefix long, need long, least long, largest long")
        inside = table.join(F.broadcast(now), "pattern").where(
            (F.shiftright("h", shift + step) == F.col("prefix")) & (F.col("h") >= F.col("least"))
            & (F.col("size") > 0) & (F.col("size") <= F.col("largest")))
        sums = inside.groupBy("pattern", "need", F.shiftright("h", shift).alias("slot")) \
            .agg(F.sum("size").alias("words"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        # 2^LEVEL_BITS rows a pattern at most
        cell = F.sort_array(F.collect_list(F.struct("slot", "words", "lo", "hi")))
        walked = sums.groupBy("pattern", "need").agg(cell.alias("cells")).select("pattern", F.aggregate(
            "cells", F.struct(F.lit(0).cast("long").alias("words"), F.lit(None).cast(
                "struct<slot:bigint,words:bigint,lo:bigint,hi:bigint>").alias("over")),
            lambda acc, c: F.when(acc["over"].isNotNull(), acc)
            .when(acc["words"] + c["words"] <= F.col("need"), F.struct((acc["words"] + c["words"]).alias("words"), acc["over"].alias("over")))
            .otherwise(F.struct(acc["words"].alias("words"), c.alias("over")))).alias("w")).collect()
        seen = set()
        for r in walked:
            p, words, over = r["pattern"], r["w"]["words"], r["w"]["over"]
            seen.add(p)
            state[p][1] += words
            state[p][2] -= words
            if over is None:
                end[p] = (state[p][0] + 1) << (HASH_BITS - bits)
            elif over["lo"] == over["hi"] or state[p][2] <= stop[p]:
                end[p] = over["lo"]
            else:
                state[p][0] = over["slot"]
                continue
            open_.discard(p)
        for p in open_ - seen:  # nothing of it is left in the range
            end[p] = (state[p][0] + 1) << (HASH_BITS - bits)
        open_ &= seen
        bits += step
    for p in open_:
        end[p] = state[p][0]
    return {p: (end[p], state[p][1]) for p in need}


def plan_mix(docs: DataFrame, members: Column, size: Column, targets, prices=PRICES, seed: int = SEED,
             tolerance: float = TOLERANCE) -> DataFrame:
    """``docs`` with ``__size``, ``__source_size``, ``__target`` (of the first member) and ``__uses`` (array of sources
    the document's uses count for, one entry a use).

    ``members``: array of a row's sources; ``targets``: function from
    ``{source: words}`` to ``{source: target}``.
    """
    spark = docs.sparkSession
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")), 64 - HASH_BITS)
    rows = docs.withColumns({"__size": size, "__members": F.array_sort(F.array_distinct(members)), "__h": h}) \
        .withColumn("__key", F.to_json("__members"))
    table = materialize(rows.select("__key", "__members", F.col("__size").alias("size"), F.col("__h").alias("h")))
    sums = sorted((r["__key"], list(r["__members"]), r["words"]) for r in table.groupBy("__key", "__members").agg(
        F.sum("size").alias("words")).collect())
    sizes: dict = {}
    for _, who, words in sums:
        for s in who:
            sizes[s] = sizes.get(s, 0) + words
    names = by_code_point(sizes)
    goal = targets(sizes)
    at = {s: i for i, s in enumerate(names)}
    flow = min_cost_flow([w for _, _, w in sums], [[at[s] for s in who] for _, who, _ in sums],
                         [int(goal[s]) for s in names], prices)
    total = [sum(f.values()) for f in flow]
    uses = [t // w if w else 0 for t, (_, _, w) in zip(total, sums)]
    left = {p: t - u * w for p, (t, u, (_, _, w)) in enumerate(zip(total, uses, sums)) if t - u * w > 0}
    keys = spark.createDataFrame([(k, p) for p, (k, _, _) in enumerate(sums)], "__key string, pattern int")
    sized = table.join(F.broadcast(keys), "__key").select("pattern", "size", "h")
    stop = {p: tolerance * total[p] for p in left}
    rules: list[dict[int, list]] = [{p: [] for p in range(len(sums))} for _ in range(2)]
    any_size = 1 << 62
    for extra in range(2):  # one use more for some documents; then, where that leaves a gap, a second one
        least, first = dict.fromkeys(left, 0), extra == 0
        unfilled: dict[int, int] = {}
        while left:
            # the first range takes documents of any size, later ones those that fit in the gap
            largest = {p: any_size if first else left[p] for p in left}
            again = {}
            for p, (end, words) in _ranges(sized, left, least, largest, stop).items():
                rules[extra][p].append((least[p], end, largest[p]))
                gap = left[p] - words
                if gap > stop[p] and end < 1 << HASH_BITS:
                    # equal rows share a hash and are taken together or not at all: go on behind those that don't fit
                    again[p], least[p] = gap, end if words or first else end + 1
                elif gap > stop[p]:
                    unfilled[p] = gap
            left, first = again, False
        left = {p: g for p, g in unfilled.items() if uses[p] + extra + 2 <= len(prices)}
    spread = []
    for p, (k, who, w) in enumerate(sums):
        ends, run = [], 0
        for s in sorted(flow[p]):
            run += flow[p][s]
            ends.append((float(run) / w, names[s]))
        lead = names.index(who[0]) if who else None
        spread.append((k, int(uses[p]), rules[0][p], rules[1][p], ends, *((sizes[names[lead]], float(goal[names[lead]])) if who else (0, 0.0))))
    plan = spark.createDataFrame(spread, "__plan_key string, __whole int, __rules array<struct<lo:bigint,hi:bigint,most:bigint>>, "
                                 "__more array<struct<lo:bigint,hi:bigint,most:bigint>>, __ends array<struct<upto:double,source:string>>, __source_size long, __target double")
    joined = rows.join(plan, rows["__key"] == plan["__plan_key"], "left")

    def fits(rules):
        return F.exists(rules, lambda r: (F.col("__h") >= r["lo"]) & (F.col("__h") < r["hi"]) & (F.col("__size") <= r["most"]))

    n = F.when(F.col("__size") > 0, F.col("__whole") + fits("__rules").cast("int") + fits("__more").cast("int")).otherwise(F.lit(0))
    place = F.col("__h") / F.lit(float(1 << HASH_BITS))

    def source_of(i):
        # the use's place on the pattern's line decides which quota it fills
        inside = F.filter("__ends", lambda e: e["upto"] > i.cast("double") + place)
        return F.when(F.size(inside) > 0, inside[0]["source"]).otherwise(F.element_at("__ends", -1)["source"])

    return joined.withColumn("__n", n).withColumn("__uses", F.when(
        F.col("__n") > 0, F.transform(F.sequence(F.lit(0), F.col("__n") - 1), source_of)).otherwise(
        F.array().cast("array<string>"))).drop("__plan_key", "__whole", "__rules", "__more", "__ends", "__key", "__members", "__h", "__n")


def weights_in_turn(sizes: dict) -> dict:
    """Targets of sources that weigh 1, 2, 3, repeating, in code point order (null last)."""
    return capped_targets(sizes, {s: i % 3 + 1 for i, s in enumerate(by_code_point(sizes))})


def mixed(docs: DataFrame, targets=weights_in_turn, **params) -> DataFrame:
    """The mix itself: ``docs``, each document as often as it is used."""
    columns = docs.columns
    got = plan_mix(docs, F.array(F.col("source").cast("string")), n_words(F.col("text")), targets, **params)
    return got.select(*[F.col(f"`{c}`") for c in columns], F.explode("__uses").alias("__use")).drop("__use")


def op5_source_mixing(spark, sf_dir: str) -> DataFrame:
    """Every document: its size, its source's size and target, and the words the mix takes of it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    got = plan_mix(docs, F.array(F.col("source").cast("string")), n_words(F.col("text")), weights_in_turn)
    return got.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").cast("long").alias("source_size"),
                      F.col("__target").alias("target"), (F.col("__size") * F.size("__uses")).cast("long").alias("taken"))


QUERIES = {"op5_source_mixing": op5_source_mixing}
ORACLES: dict[str, str] = {}
