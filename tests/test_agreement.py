"""Agreement metrics: golden table, hand cases, invariants."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from concordia.operators import agreement as ag

# Golden: the smallest shipped importance table (Attribute, Rulex, SHAP, LIME, Ablation), file order.
GOLDEN = [
    ("mitosis", 0.0, 0.0085226827, 0.0469178474, 0.0060314286),
    ("adhesion", 0.0, 0.0441504445, 0.0709382132, 0.0328419048),
    ("single", 0.0, 0.0605735402, 0.0712614817, 0.02696),
    ("nucleoli", 0.0229116641, 0.0493005282, 0.0984992525, 0.0329266667),
    ("chromatin", 0.0037866111, 0.0668712734, 0.0834596923, 0.03766),
    ("nuclei", 0.3352454563, 0.1062506092, 0.18533925, 0.0773152381),
    ("thickness", 0.0895937334, 0.0606069552, 0.1246289532, 0.0587866667),
    ("size", 0.1700268886, 0.1324054544, 0.1716147459, 0.094747619),
]
# expected per pair RS RL SL RA SA LA
EXP_SPEARMAN = [0.81, 0.98, 0.86, 0.95, 0.90, 0.93]
EXP_KENDALL = [0.64, 0.94, 0.71, 0.79, 0.79, 0.79]
EXP_JACCARD = [0.67, 1.0, 0.67, 1.0, 0.67, 1.0]


def _golden_imp(spark, with_noise):
    rows = []
    rng = np.random.RandomState(42)
    noise = {m: rng.rand(len(GOLDEN)) * 1e-12 for m in ag.METHODS}  # golden mode: rank noise
    for i, (a, *vals) in enumerate(GOLDEN):
        for m, v in zip(ag.METHODS, vals):
            rows.append(("Breast_Cancer", "Single_Target", a, m, float(v),
                         float(noise[m][i]) if with_noise else 0.0))
    return spark.createDataFrame(rows, "dataset string, target string, attribute string, method string, "
                                       "value double, noise double")


def _summary(df):
    out = {}
    for r in df.collect():
        out[(r["metric"], r["pair"])] = r["value"]
    return out


def test_golden_breast_cancer(spark):
    imp = _golden_imp(spark, with_noise=True)
    s = _summary(ag.agreement_summary(imp, tie_col="noise", wide=False)
                 .where(F.col("dataset") == "Breast_Cancer"))
    pairs = [p for _, _, p in ag.PAIRS]
    for metric, exp in (("Spearman", EXP_SPEARMAN), ("Kendall", EXP_KENDALL), ("Jaccard", EXP_JACCARD)):
        got = [s[(metric, p)] for p in pairs]
        assert got == pytest.approx(exp, abs=1e-9), (metric, got)


def _brute_tau_b(x, y):
    s = tx = ty = 0
    for i, j in combinations(range(len(x)), 2):
        a, b = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
        s += a * b
        tx += abs(a)
        ty += abs(b)
    return 0.0 if tx * ty == 0 else s / math.sqrt(tx * ty)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_kendall_dominance_matches_brute_force(spark, seed):
    rng = np.random.RandomState(seed)
    n = 57
    x = rng.randint(0, 6, n).astype(float)      # heavy ties
    y = rng.randint(0, 9, n).astype(float)
    rows = [("d", "t", "p", f"a{i}", float(x[i]), float(y[i])) for i in range(n)]
    pts = spark.createDataFrame(rows, "dataset string, target string, pair string, attribute string, "
                                      "xv double, yv double")
    got = ag.kendall_tau_b(pts).first()["value"]
    assert got == pytest.approx(_brute_tau_b(x, y), abs=1e-12)


def test_kendall_degenerate_cases(spark):
    rows = [("d", "t", "const", "a", 1.0, 1.0), ("d", "t", "const", "b", 1.0, 2.0),
            ("d", "t", "single", "a", 1.0, 3.0)]
    pts = spark.createDataFrame(rows, "dataset string, target string, pair string, attribute string, "
                                      "xv double, yv double")
    got = {r["pair"]: r["value"] for r in ag.kendall_tau_b(pts).collect()}
    assert got == {"const": 0.0, "single": 0.0}


def test_metric_of_method_with_itself_is_one(spark):
    imp = _golden_imp(spark, with_noise=False)
    same = imp.where(F.col("method") == "SHAP")
    dup = same.unionByName(same.withColumn("method", F.lit("SHAP2")))
    ranks = ag.unique_ranks(dup)
    pts = ag.paired_points(ranks, [("SHAP", "SHAP2", "self")])
    assert ag.spearman(pts).first()["value"] == pytest.approx(1.0)
    assert ag.kendall_tau_b(pts).first()["value"] == pytest.approx(1.0)
    assert ag.jaccard_top_k(ranks, pairs=[("SHAP", "SHAP2", "self")]).first()["value"] == 1.0


def test_unique_ranks_are_a_permutation(spark):
    imp = _golden_imp(spark, with_noise=False)
    r = ag.unique_ranks(imp).groupBy("method").agg(F.sort_array(F.collect_list("rank")).alias("r")).collect()
    for row in r:
        assert row["r"] == list(range(1, len(GOLDEN) + 1))


def test_contract_rejects_missing_columns(spark):
    df = spark.createDataFrame([("a", 1.0)], "Attribute string, SHAP double")
    with pytest.raises(ValueError):
        ag.unpivot_importance(df, dataset="x")


def test_single_target_default(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0, 3.0, 4.0)],
                               "Attribute string, Rulex double, SHAP double, LIME double, Ablation double")
    long = ag.unpivot_importance(df, dataset="x")
    assert {r["target"] for r in long.collect()} == {"Single_Target"}


def test_dominance_across_blocks_explodes_no_point(spark, monkeypatch):
    """Blocks and strips smaller than the groups, ties in both values; the counts equal all pairs and no point is multiplied."""
    import numpy as np

    from concordia.operators import agreement as ag

    monkeypatch.setattr(ag, "BLOCK_BITS", 3)
    monkeypatch.setattr(ag, "STRIP", 2)
    rng, rows, want = np.random.default_rng(0), [], {}
    for g, (n, k) in {"a": (300, 1000), "b": (300, 9), "c": (5, 3), "d": (1, 2), "e": (70, 1000)}.items():
        x = rng.integers(0, k, n)
        y = rng.integers(0, k, n) + (x if g == "e" else 0)
        want[g] = int(((x[:, None] < x) & (y[:, None] < y)).sum())
        rows += [(g, float(a), float(b)) for a, b in zip(x, y)]
    x, y = [None if i % 7 == 0 else float(v) for i, v in enumerate(rng.integers(0, 9, 60))], rng.permutation(60)
    rows += [("f", v, float(w)) for v, w in zip(x, y)]
    top = np.array([np.inf if v is None else v for v in x])
    want["f"] = int(((top[:, None] < top) & (y[:, None] < y)).sum())
    got = ag._dominance_total(spark.createDataFrame(rows, "g string, x double, y double"), ["g"])
    assert {r["g"]: r["dom"] for r in got.collect()} == want
    assert "yr" in got._jdf.queryExecution().analyzed().toString() and "level" not in got._jdf.queryExecution().analyzed().toString()


def test_ranks_are_written_once_and_points_counted_in_slices(spark, monkeypatch):
    """Ranked rows are read where they were written, not dealt again; groups counted slice by slice give the same values and
    leave no table of a slice behind."""
    import os

    import numpy as np

    from concordia.operators import agreement as ag
    from concordia.session import scratch_path

    rng = np.random.default_rng(2)
    rows = [(f"d{g}", t, f"a{i}", m, float(v)) for g in range(3) for t in "xy" for m in ag.METHODS
            for i, v in enumerate(rng.integers(0, 15, 40))]
    imp = spark.createDataFrame([*rows, (None, "x", "a0", "SHAP", 1.0), ("d0", "x", None, "SHAP", None)],
                                "dataset string, target string, attribute string, method string, value double")
    ranks = ag.unique_ranks(imp)
    plan = ranks._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "Window" not in plan and "RDDScan" not in plan
    want = {}
    for r in sorted(imp.collect(), key=lambda r: (r.value is None, -(r.value or 0), r.attribute or "")):
        want.setdefault((r.dataset, r.target, r.method), []).append(r.attribute)
    assert {(r.dataset, r.target, r.method, r.attribute, r["rank"]) for r in ranks.collect()} == \
        {(*k, a, i + 1) for k, v in want.items() for i, a in enumerate(v)}
    points = ag.paired_points(ranks)
    whole = sorted(map(tuple, ag.kendall_tau_b(points).collect()))
    assert len(whole) == 36
    monkeypatch.setattr(ag, "SLICED_POINTS", 0)
    tables = os.path.dirname(scratch_path(spark, "x").removeprefix("file:"))
    before = len(os.listdir(tables))
    assert sorted(map(tuple, ag.kendall_tau_b(points).collect())) == whole
    assert len(os.listdir(tables)) == before + 1 + ag.SLICES  # the points and a result a slice
