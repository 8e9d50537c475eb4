"""Perturbation explainers as Spark jobs.

Rows to explain carry ``id`` and a feature array ``x``; the background
(training rows) is numbered 0..n-1 with the distributed row number. Every
random draw is an integer-mixer index seeded by ``md5(seed|id)`` and keyed by
(feature|step, draw), so draws are reproducible, independent of
partitioning and checkable in SQL.

Work grows as rows x features x draws. Models with an array form
(``array_fn``) are scored where the row, or the background block that its draws
fall into, lies (:mod:`.draws`): no draw becomes a Spark row. Other models take
the plan

    explode(features) x explode(draws) -> equi-join background on (j, idx)
    -> score by Spark -> partial avg per (id, j)

whose background side is broadcast only under ``broadcast_bytes``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import MIX_MOD, draw_index, uhash32
from ..session import written
from .draws import draw_means

#: Size up to which a background table is broadcast; beyond it the join is shuffled.
BROADCAST_BYTES = 64 << 20


def _names(feature_names: Sequence[str]):
    return F.array(*[F.lit(n) for n in feature_names])


def number_background(train: DataFrame, id_col: str = "id") -> tuple[DataFrame, int]:
    """Background rows numbered 0..n-1 in id order; returns (frame, n).

    Dealt by ranges of the id and written once in order, each with its slice and place in it; the slices' sizes (a
    row a slice) give the numbers, so nothing is dealt again and a task's rows follow one another.
    """
    n_slices = int(train.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    rows = written(train.select(F.col(id_col).alias("__k"), "x").repartitionByRange(n_slices, "__k")
                       .sortWithinPartitions("__k").select(F.monotonically_increasing_id().alias("__at"), "x"))
    # the id is the slice's number above 33 bits of the row's place in it
    sizes = dict(rows.groupBy(F.shiftright("__at", 33).alias("s")).agg(F.count(F.lit(1)).alias("n")).collect())
    before, n = {}, 0
    for s in sorted(sizes):
        before[s], n = n, n + sizes[s]
    offsets = F.array(*[F.lit(before.get(s, 0)).cast("bigint") for s in range(max(before, default=0) + 1)])
    bidx = F.element_at(offsets, F.shiftright("__at", 33).cast("int") + 1) + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.select(bidx.alias("bidx"), "x"), n


def long_form(wide: DataFrame, feature_names: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """A row an id and feature of a wide table, whose ``columns`` hold arrays in the order of ``feature_names``."""
    return wide.select("id", F.posexplode(_names(feature_names)).alias("j", "feature"), *columns) \
        .select("id", "feature", *[F.get(c, F.col("j")).alias(c) for c in columns])


def base_value(scorer, train: DataFrame) -> float:
    """Mean positive-class prediction over the training rows."""
    return scorer.predict(train.select("x"), "x").agg(F.avg("pred")).first()[0]


def base_values(scorers: dict, train: DataFrame) -> dict:
    """:func:`base_value` of several models in one pass."""
    scored = train.select("x")
    for i, s in enumerate(scorers.values()):
        scored = s.predict(scored, "x", out=f"__b{i}")
    row = scored.agg(*[F.avg(f"__b{i}") for i in range(len(scorers))]).first()
    return dict(zip(scorers, row))


def spread(df: DataFrame, key: str = "id") -> DataFrame:
    """Hash-spread the rows to explain before a large fan-out (draws, samples,
    leaves): an upstream aggregate may leave them in very few partitions, and
    every exploded row would then be produced by those few tasks."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")),
            spark.sparkContext.defaultParallelism)
    return df.repartition(n, key)


def array_forms(scorers: Sequence, spark):
    """The scorers as functions of a matrix, or None if one of them has no such form."""
    fns = [s.array_fn(spark) if hasattr(s, "array_fn") else None for s in scorers]
    return None if any(f is None for f in fns) else fns


def _maybe_broadcast(df: DataFrame, rows: int, width: int, limit: int) -> DataFrame:
    """Broadcast when ``rows`` rows of ``width`` 8-byte cells stay under ``limit`` bytes."""
    return F.broadcast(df) if rows * width * 8 <= limit else df


# ----------------------------------------------------------------- X5, X6, J9
def marginal_draws(test: DataFrame, p: int, n_draws: int, n_bg: int, seed) -> DataFrame:
    """(id, x, j, d, bidx): one background index per row, feature and draw.
    One md5 per row seeds an integer mixer for all of the row's draws; the
    row's own array travels with the draw, so no join back on id."""
    seeded = test.select("id", "x", (uhash32(seed, "id") % F.lit(MIX_MOD)).alias("__seed"))
    return seeded.select("id", "x", "__seed", F.explode(F.sequence(F.lit(0), F.lit(p - 1))).alias("j")) \
        .select("id", "x", "__seed", "j", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1))).alias("d")) \
        .select("id", "x", "j", "d", draw_index(F.col("__seed"), F.col("d"), F.col("j"), n_bg).alias("bidx"))


def joint_draws(test: DataFrame, steps: int, n_draws: int, n_bg: int, seed) -> DataFrame:
    """(id, x, s, d, bidx): one joint background row per row, step and draw."""
    seeded = test.select("id", "x", (uhash32(seed, "id") % F.lit(MIX_MOD)).alias("__seed"))
    return seeded.select("id", "x", "__seed", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("s")) \
        .select("id", "x", "__seed", "s", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1))).alias("d")) \
        .select("id", "x", "s", "d", draw_index(F.col("__seed"), F.col("d"), F.col("s"), n_bg).alias("bidx"))


# ------------------------------------------------------------------------ A5
def marginal_ablation(scorer, train: DataFrame, test: DataFrame, feature_names: Sequence[str],
                      n_draws: int = 50, seed="ablation", broadcast_bytes: int = BROADCAST_BYTES,
                      background=None, wide: bool = False) -> DataFrame:
    """value = |f(x) - mean_d f(x with x_j := background draw)| per (id, feature).

    Output: id, feature, feature_value, base_value, ablation_value. ``wide`` (models with an array form): a row a test
    row, feature_value and ablation_value as arrays in the order of ``feature_names``.
    """
    p = len(feature_names)
    bg, n_bg = background or number_background(train)
    fns = array_forms([scorer], test.sparkSession)
    if wide:
        if not fns:
            raise ValueError("a wide table needs a model with an array form")
        import numpy as np

        base = base_value(scorer, train)
        got = draw_means([(np.eye(p), fns[0])], bg, n_bg, test, p, range(p), n_draws, seed, broadcast_bytes)
        return got.select("id", F.col("x").alias("feature_value"), F.lit(base).alias("base_value"),
                          F.transform("means", lambda m: F.abs(F.col("orig")[0] - m)).alias("ablation_value"))
    if fns:
        return marginal_ablation_targets({"": scorer}, train, test, feature_names, n_draws, seed, broadcast_bytes, (bg, n_bg)) \
            .drop("target_context")
    base = base_value(scorer, train)
    bg_long = bg.select("bidx", F.posexplode("x").alias("j", "v"))
    bg_long = _maybe_broadcast(bg_long, n_bg * p, 4, broadcast_bytes)
    draws = marginal_draws(spread(test), p, n_draws, n_bg, seed)
    pert = draws.join(bg_long, ["j", "bidx"]) \
        .withColumn("xp", F.transform("x", lambda e, k: F.when(k == F.col("j"), F.col("v")).otherwise(e)))
    scored = scorer.predict(pert.select("id", "j", "xp"), "xp")
    avg = scored.groupBy("id", "j").agg(F.avg("pred").alias("avg_pred"))
    orig = scorer.predict(test.select("id", "x"), "x").withColumnRenamed("pred", "orig")
    names = _names(feature_names)
    return avg.join(orig, "id").select(
        "id", F.element_at(names, F.col("j") + 1).alias("feature"),
        F.element_at("x", F.col("j") + 1).alias("feature_value"),
        F.lit(base).alias("base_value"),
        F.abs(F.col("orig") - F.col("avg_pred")).alias("ablation_value"))


def marginal_ablation_targets(scorers: dict, train: DataFrame, test: DataFrame, feature_names: Sequence[str],
                              n_draws: int = 50, seed="ablation", broadcast_bytes: int = BROADCAST_BYTES,
                              background=None) -> DataFrame:
    """A5 for several targets' models in one pass: drawn, joined and grouped once, scored by every model.

    Output: target_context and the columns of :func:`marginal_ablation`.
    """
    p, targets = len(feature_names), list(scorers)
    bg, n_bg = background or number_background(train)
    fns = array_forms(list(scorers.values()), test.sparkSession)
    if fns:
        import numpy as np

        means = base_values(scorers, train)
        got = draw_means([(np.eye(p), f) for f in fns], bg, n_bg, test, p, range(p), n_draws, seed, broadcast_bytes)

        def values(i, t):
            return F.transform(F.slice("means", i * p + 1, p), lambda m, j: F.struct(
                F.lit(t).alias("target_context"), j.alias("j"), F.lit(means[t]).alias("base_value"),
                F.abs(F.col("orig")[i] - m).alias("ablation_value")))

        cells = F.flatten(F.array(*[values(i, t) for i, t in enumerate(targets)]))
        return got.select("id", "x", F.explode(cells).alias("r")).select(
            "r.target_context", "id", F.element_at(_names(feature_names), F.col("r.j") + 1).alias("feature"),
            F.element_at("x", F.col("r.j") + 1).alias("feature_value"), "r.base_value", "r.ablation_value")
    bg_long = _maybe_broadcast(bg.select("bidx", F.posexplode("x").alias("j", "v")), n_bg * p, 4, broadcast_bytes)
    pert = marginal_draws(spread(test), p, n_draws, n_bg, seed).join(bg_long, ["j", "bidx"]) \
        .select("id", "j", F.transform("x", lambda e, k: F.when(k == F.col("j"), F.col("v")).otherwise(e)).alias("xp"))
    orig, base = test.select("id", "x"), train.select("x")
    for i, t in enumerate(targets):
        pert = scorers[t].predict(pert, "xp", out=f"__p{i}")
        orig = scorers[t].predict(orig, "x", out=f"__o{i}")
        base = scorers[t].predict(base, "x", out=f"__b{i}")
    means = base.agg(*[F.avg(f"__b{i}") for i in range(len(targets))]).first()
    avg = pert.groupBy("id", "j").agg(*[F.avg(f"__p{i}").alias(f"__a{i}") for i in range(len(targets))])
    rows = avg.join(orig, "id").select("id", "j", "x", F.explode(F.array(*[F.struct(
        F.lit(t).alias("target_context"), F.lit(means[i]).alias("base_value"),
        F.abs(F.col(f"__o{i}") - F.col(f"__a{i}")).alias("ablation_value")) for i, t in enumerate(targets)])).alias("r"))
    return rows.select("r.target_context", "id", F.element_at(_names(feature_names), F.col("j") + 1).alias("feature"),
                       F.element_at("x", F.col("j") + 1).alias("feature_value"), "r.base_value", "r.ablation_value")


def interval_weights(train: DataFrame, cuts: Sequence[Sequence[float]]) -> list[list[tuple[float, float]]]:
    """Per feature ``(a value, share of train rows)`` of every interval between its cuts (upper ends included).

    A tree is constant within these intervals, so they carry the whole
    distribution; one aggregate, one row.
    """
    counts = [F.count(F.lit(1)).alias("n")]
    for j, c in enumerate(cuts):
        x = F.element_at("x", j + 1)
        counts += [F.sum((x <= F.lit(float(t))).cast("bigint")).alias(f"c{j}_{k}") for k, t in enumerate(c)]
    row = train.agg(*counts).first()
    out = []
    for j, c in enumerate(cuts):
        upto = [0] + [row[f"c{j}_{k}"] or 0 for k in range(len(c))] + [row["n"]]
        values = [float(t) for t in c] + [float(c[-1]) + 1.0 if c else 0.0]
        out.append([(v, (hi - lo) / row["n"]) for v, lo, hi in zip(values, upto, upto[1:]) if hi > lo])
    return out


def marginal_ablation_exact(scorer, train: DataFrame, test: DataFrame, feature_names: Sequence[str],
                            cuts: Sequence[Sequence[float]]) -> DataFrame:
    """Expectation form of A5 for a model that is constant between ``cuts`` (a tree ensemble's
    thresholds, at most 33 intervals a feature with 32 bins): no draws, no join, no sampling error.

    Output as :func:`marginal_ablation`.
    """
    weights = interval_weights(train, cuts)
    cells = [F.struct(F.lit(j).alias("j"), F.lit(v).alias("v"), F.lit(w).alias("w"))
             for j, per in enumerate(weights) for v, w in per]
    rows = spread(test).select("id", "x", F.explode(F.array(*cells)).alias("c")) \
        .select("id", "x", "c.j", "c.w", F.transform("x", lambda e, k: F.when(k == F.col("c.j"), F.col("c.v")).otherwise(e))
                .alias("xp"))
    scored = scorer.predict(rows.select("id", "j", "w", "xp"), "xp")
    exp = scored.groupBy("id", "j").agg(F.sum(F.col("w") * F.col("pred")).alias("exp_pred"))
    orig = scorer.predict(test.select("id", "x"), "x").withColumnRenamed("pred", "orig")
    base = base_value(scorer, train)
    return exp.join(orig, "id").select(
        "id", F.element_at(_names(feature_names), F.col("j") + 1).alias("feature"),
        F.element_at("x", F.col("j") + 1).alias("feature_value"), F.lit(base).alias("base_value"),
        F.abs(F.col("orig") - F.col("exp_pred")).alias("ablation_value"))


# ------------------------------------------------------------------------ A7
def least_to_most(ablation: DataFrame) -> DataFrame:
    """(feature, mean_ablation, step): step 1 = least important; ties by name."""
    g = ablation.groupBy("feature").agg(F.avg("ablation_value").alias("mean_ablation"))
    # one row per feature: a bounded table, ordered with a plain window
    return g.withColumn("step", F.row_number().over(
        Window.orderBy(F.col("mean_ablation").asc(), F.col("feature").asc())))


# ------------------------------------------------------------------------ A6
def cumulative_ablation(scorer, train: DataFrame, test: DataFrame, feature_names: Sequence[str],
                        ablation: DataFrame, n_draws: int = 50, seed="cumulative",
                        broadcast_bytes: int = BROADCAST_BYTES, background=None, wide: bool = False,
                        keep: Sequence[str] = ()) -> DataFrame:
    """Mask the s least important features jointly (fresh joint draws per
    step), value = |pred(step s-1) - pred(step s)|, step 0 = original.

    Output: id, feature, feature_value, base_value, original_prediction,
    current_prediction, cum_ablation_value (plus ``step``). ``wide`` (models with an array form): a row a test row, with
    arrays in the order of ``feature_names`` but for base_value and original_prediction, and the columns ``keep`` of ``test``.
    """
    p = len(feature_names)
    if wide or array_forms([scorer], test.sparkSession):
        got = cumulative_ablation_targets({"": scorer}, train, test, feature_names, ablation.withColumn("target_context", F.lit("")),
                                          n_draws, seed, broadcast_bytes, background, wide, keep)
        return got if wide else got.drop("target_context")
    order = {r["feature"]: r["step"] for r in least_to_most(ablation).collect()}  # p rows
    step_of = F.array(*[F.lit(int(order[n])) for n in feature_names])
    feat_at_step = F.array(*[F.lit(n) for n in sorted(feature_names, key=lambda n: order[n])])
    idx_at_step = F.array(*[F.lit(feature_names.index(n)) for n in sorted(feature_names, key=lambda n: order[n])])
    bg, n_bg = background or number_background(train)
    base = base_value(scorer, train)
    bgr = _maybe_broadcast(bg.withColumnRenamed("x", "xb"), n_bg, p + 4, broadcast_bytes)
    draws = joint_draws(spread(test), p, n_draws, n_bg, seed)
    pert = draws.join(bgr, "bidx") \
        .withColumn("xp", F.transform("x", lambda e, k: F.when(
            F.element_at(step_of, k + 1) <= F.col("s"), F.element_at("xb", k + 1)).otherwise(e)))
    scored = scorer.predict(pert.select("id", "s", "xp"), "xp")
    cur = scored.groupBy("id", "s").agg(F.avg("pred").alias("current_prediction"))
    orig = scorer.predict(test.select("id", "x"), "x").withColumnRenamed("pred", "original_prediction")
    w = Window.partitionBy("id").orderBy("s")  # p rows per id: bounded
    j = cur.join(orig, "id")
    prev = F.lag("current_prediction", 1).over(w)
    return j.select(
        "id", F.col("s").alias("step"),
        F.element_at(feat_at_step, F.col("s")).alias("feature"),
        F.element_at("x", F.element_at(idx_at_step, F.col("s")) + 1).alias("feature_value"),
        F.lit(base).alias("base_value"), "original_prediction", "current_prediction",
        F.abs(F.coalesce(prev, F.col("original_prediction")) - F.col("current_prediction"))
        .alias("cum_ablation_value"))


def leaf_boxes(ensemble, p: int):
    """``(lo, hi, value)`` of all leaves of a compiled tree ensemble: a row scores the values of the boxes
    (lo < x <= hi in every column) that it lies in."""
    import numpy as np

    lo, hi = np.full((len(ensemble.leaves), p), -np.inf), np.full((len(ensemble.leaves), p), np.inf)
    value = np.zeros(len(ensemble.leaves))
    for i, (leaf, _, weight) in enumerate(ensemble.leaves):
        lo[i, leaf.features], hi[i, leaf.features], value[i] = leaf.lo, leaf.hi, weight * leaf.value
    return lo, hi, value


def leaf_coverage(train: DataFrame, boxes, order: Sequence[int], cells: int = 1 << 20):
    """Share of the train rows inside every leaf's box as far as the first s columns of ``order`` go, s = 0 .. p.

    One pass: a partition counts for all leaves and steps at once and sends one
    row; p x leaves sums reach the driver.
    """
    import numpy as np
    import pyarrow as pa

    lo, hi, value = boxes
    p, leaves = len(order), len(value)
    columns = list(order)
    step = max(1, cells // max(1, leaves))

    def run(batches):
        counts, n = np.zeros((p, leaves), np.int64), 0
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            n += b.num_rows
            for at in range(0, b.num_rows, step):
                rows = x[at:at + step]
                inside = np.ones((len(rows), leaves), bool)
                for s, j in enumerate(columns):
                    v = rows[:, j][:, None]
                    inside &= (lo[:, j] < v) & (v <= hi[:, j])
                    counts[s] += inside.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([counts.ravel().tolist()], pa.list_(pa.int64()))],
                                         names=["n", "counts"])

    parts = train.select(F.col("x").cast("array<double>").alias("x")).mapInArrow(run, "n long, counts array<long>")
    total = parts.select("n", F.posexplode("counts").alias("i", "c")).groupBy("i").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))
    share = np.zeros(p * leaves)
    for r in total.collect():
        share[r["i"]] = r["c"] / r["n"] if r["n"] else 0.0
    return np.concatenate([np.ones((1, leaves)), share.reshape(p, leaves)])


def cumulative_ablation_exact(ensemble, train: DataFrame, test: DataFrame, feature_names: Sequence[str],
                              ablation: DataFrame, cells: int = 1 << 20) -> DataFrame:
    """Expectation form of A6 for a compiled tree ensemble, over the whole background and without draws.

    Masking the first s columns leaves a leaf with the share of the background
    inside its box in those columns (jointly), times whether the row is inside
    it in the others. Predictions are the ensemble's sums (a forest's mean
    probability; a boosted ensemble's log-odds). Everything of a row is worked
    out where the row is. Output as :func:`cumulative_ablation`.
    """
    import numpy as np
    import pyarrow as pa

    p = len(feature_names)
    steps = {r["feature"]: r["step"] for r in least_to_most(ablation).collect()}  # p rows
    order = sorted(range(p), key=lambda j: steps[feature_names[j]])
    lo, hi, value = boxes = leaf_boxes(ensemble, p)
    weights = leaf_coverage(train, boxes, order, cells) * value  # per step
    base, step = float(weights[p].sum()), max(1, cells // max(1, len(value)))

    def run(batches):
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            pred = np.zeros((b.num_rows, p + 1))
            for at in range(0, b.num_rows, step):
                rows = x[at:at + step]
                inside = np.ones((len(rows), len(value)), bool)  # in the columns that are not masked
                for s in range(p, -1, -1):
                    pred[at:at + step, s] = inside @ weights[s]
                    if s:
                        v = rows[:, order[s - 1]][:, None]
                        inside &= (lo[:, order[s - 1]] < v) & (v <= hi[:, order[s - 1]])
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), p))),
                 pa.array(np.tile(np.arange(1, p + 1, dtype=np.int32), b.num_rows)), pa.array(x[:, order].ravel()),
                 pa.array(np.repeat(pred[:, 0], p)), pa.array(pred[:, 1:].ravel()),
                 pa.array(np.abs(np.diff(pred, axis=1)).ravel())],
                names=["id", "step", "feature_value", "original_prediction", "current_prediction", "cum_ablation_value"])

    kind = test.schema["id"].dataType.simpleString()
    long = test.select("id", F.col("x").cast("array<double>").alias("x")).mapInArrow(
        run, f"id {kind}, step int, feature_value double, original_prediction double, current_prediction double, "
             "cum_ablation_value double")
    names = _names([feature_names[j] for j in order])
    return long.select("id", "step", F.element_at(names, F.col("step")).alias("feature"), "feature_value",
                       F.lit(base).alias("base_value"), "original_prediction", "current_prediction", "cum_ablation_value")


def cumulative_ablation_targets(scorers: dict, train: DataFrame, test: DataFrame, feature_names: Sequence[str],
                                ablation: DataFrame, n_draws: int = 50, seed="cumulative",
                                broadcast_bytes: int = BROADCAST_BYTES, background=None, wide: bool = False,
                                keep: Sequence[str] = ()) -> DataFrame:
    """A6 for several targets' models in one pass over shared draws, each masked in the order of its own ``ablation``
    (with ``target_context``). Output: target_context and the columns of :func:`cumulative_ablation`.

    Models need an array form. ``wide``: one target, its arrays without target_context, and the columns ``keep`` of ``test``.
    """
    import numpy as np

    p, targets = len(feature_names), list(scorers)
    fns = array_forms(list(scorers.values()), test.sparkSession)
    if not fns:
        raise ValueError("cumulative ablation of several targets needs models with an array form")
    bg, n_bg = background or number_background(train)
    bases = base_values(scorers, train)
    mean = {(r["target_context"], r["feature"]): r["m"] for r in ablation.groupBy("target_context", "feature").agg(
        F.avg("ablation_value").alias("m")).collect()}  # one row a target and feature
    plans, orders = [], []
    for t, f in zip(targets, fns):
        order = sorted(range(p), key=lambda j: (mean.get((t, feature_names[j]), 0.0), feature_names[j]))
        mask = np.zeros((p, p), bool)
        for s, j in enumerate(order):
            mask[s:, j] = True
        plans.append((mask, f))
        orders.append(order)
    got = draw_means(plans, bg, n_bg, test, p, range(1, p + 1), n_draws, seed, broadcast_bytes, keep if wide else ())

    if wide:
        if len(targets) != 1:
            raise ValueError("a wide table has one target")
        at = [orders[0].index(j) for j in range(p)]
        now = [F.col("means")[s] for s in at]
        before = [F.col("means")[s - 1] if s else F.col("orig")[0] for s in at]
        return got.select("id", *keep, F.array(*[F.lit(s + 1) for s in at]).alias("step"), F.col("x").alias("feature_value"),
                          F.lit(bases[targets[0]]).alias("base_value"), F.col("orig")[0].alias("original_prediction"),
                          F.array(*now).alias("current_prediction"),
                          F.array(*[F.abs(b - c) for b, c in zip(before, now)]).alias("cum_ablation_value"))

    def steps(i, t):
        names = _names([feature_names[j] for j in orders[i]])
        place = F.array(*[F.lit(j) for j in orders[i]])

        def step(cur, s):
            before = F.when(s == 0, F.col("orig")[i]).otherwise(F.col("means")[F.greatest(s - 1, F.lit(0)) + i * p])
            return F.struct(F.lit(t).alias("target_context"), (s + 1).alias("step"), F.element_at(names, s + 1).alias("feature"),
                            F.element_at("x", F.element_at(place, s + 1) + 1).alias("feature_value"),
                            F.lit(bases[t]).alias("base_value"), F.col("orig")[i].alias("original_prediction"),
                            cur.alias("current_prediction"), F.abs(before - cur).alias("cum_ablation_value"))

        return F.transform(F.slice("means", i * p + 1, p), step)

    cells = F.flatten(F.array(*[steps(i, t) for i, t in enumerate(targets)]))
    return got.select("id", F.explode(cells).alias("r")).select("r.target_context", "id", *[f"r.{c}" for c in (
        "step", "feature", "feature_value", "base_value", "original_prediction", "current_prediction", "cum_ablation_value")])


# ---------------------------------------------------------------- linear SHAP
def linear_shap(model, train: DataFrame, test: DataFrame, feature_names: Sequence[str], wide: bool = False,
                keep: Sequence[str] = ()) -> DataFrame:
    """Exact Shapley values of a linear margin with independent features:
    phi_j = w_j (x_j - E[x_j]); base = margin at the train means. ``wide``: a row a test row, feature_value and
    shap_value as arrays, and the columns ``keep`` of ``test``."""
    p = len(feature_names)
    means = train.select(*[F.element_at("x", k + 1).alias(f"m{k}") for k in range(p)]) \
        .agg(*[F.avg(f"m{k}").alias(f"m{k}") for k in range(p)]).first()
    mu = [float(means[f"m{k}"]) for k in range(p)]
    base = float(model.intercept) + sum(float(w) * m for w, m in zip(model.weights, mu))
    w_arr = F.array(*[F.lit(float(w)) for w in model.weights])
    m_arr = F.array(*[F.lit(m) for m in mu])
    if wide:
        return test.select("id", *keep, F.col("x").alias("feature_value"), F.lit(base).alias("base_value"),
                           F.transform("x", lambda v, j: F.get(w_arr, j) * (v - F.get(m_arr, j))).alias("shap_value"))
    names = _names(feature_names)
    return test.select("id", F.posexplode("x").alias("j", "feature_value")).select(
        "id", F.element_at(names, F.col("j") + 1).alias("feature"), "feature_value",
        F.lit(base).alias("base_value"),
        (F.element_at(w_arr, F.col("j") + 1) * (F.col("feature_value") - F.element_at(m_arr, F.col("j") + 1)))
        .alias("shap_value"))


# ------------------------------------------------------------------------ A8
def per_target(frames_by_target: dict[str, DataFrame]) -> DataFrame:
    """Stack per-target attribution frames with a ``target_context`` column."""
    out = None
    for tgt, df in frames_by_target.items():
        d = df.withColumn("target_context", F.lit(tgt))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out
