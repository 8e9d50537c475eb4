"""Operator 3: toxicity, a counterfactual-regularised linear classifier.

Features are the distinct words of the whole text, and the distinct beginnings
(``PREFIXES`` bytes) of its longer words, which carry over to inflected forms a
small sample doesn't hold. A feature's weight is learnt on
a bounded sample of labelled rows: logistic loss, a ridge, and a counterfactual
penalty ``strength * mean((s(x) - s(x'))^2)`` where ``s`` is the score before the
logistic and ``x'`` is a labelled sentence whose identity term was swapped for
another one of its group (a sentence without any gets one inserted), so a
neutral group mention moves no score. Words are scaled by their log odds, and
words whose log odds are within ``min_z`` standard errors of zero are left out,
identity terms excepted: the penalty decides on those.

``max_train`` bounds the labelled rows fitted on (smallest hash of the id
first); scoring covers every row, one pass, no shuffle of texts.

Defined results: null and empty texts have no words and get the score of the
intercept; no labelled rows, or one class only, gives that class's smoothed rate
everywhere; null labels and null ids are not learnt from; repeated ids with
differing labels count as labelled 1 when any is 1. Scores read the text alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import shingles as S
from .shipping import ship

#: Groups whose members may be swapped for one another (parameter default).
IDENTITY_GROUPS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "arab", "african", "european"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("disabled", "deaf", "blind"),
)
MAX_TRAIN = 8000
THRESHOLD = 0.7
PREFIXES = (5, 6, 7, 8)
MIN_Z = 2.5
MAX_FEATURES = 20_000


def held_out() -> F.Column:
    """True for rows no label is learnt from: crc32 of the id's text modulo 3 is 1."""
    return (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3) == 1


def term_features(term: str) -> np.ndarray:
    """A term's features: the word itself first, then its beginnings."""
    raw = np.frombuffer(term.encode(), np.uint8)
    return _row_words(np.array([0, len(raw)]), raw)[0]


def _row_words(offs, data):
    """``(feature hash, row)`` of every word, and of every longer word's beginning, of a slice; rows ascend."""
    h, first, start, end = S.words(offs, data, separators=S.NOT_LETTER)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    hs, rows = [h], [row]
    for n in PREFIXES:
        long = end - start > n
        hs.append(~S.words(offs, data, separators=S.NOT_LETTER, prefix=n)[0][long])
        rows.append(row[long])
    row = np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    return np.concatenate(hs)[order], row[order]


def training_sets(docs: DataFrame, labels: DataFrame, max_train: int, learn_from) -> DataFrame:
    """At most ``max_train`` rows ``(y, words)``: distinct feature hashes, repeated sets once."""
    ship(docs.sparkSession)
    y = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(learn_from) \
        .groupBy("doc_id").agg(F.max("toxic").alias("y"))
    picked = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)

    def run(batches):
        for b in batches:
            for lo, offs, data in S.text_slices(b.column(1)):
                h, row = _row_words(offs, data)
                cut = np.searchsorted(row, np.arange(len(offs)))
                sets = [np.unique(h[cut[i]:cut[i + 1]]).view(np.int64) for i in range(len(offs) - 1)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(sets)).cast(pa.int32()),
                                                  pa.array(sets, pa.list_(pa.int64()))], names=["y", "words"])

    return docs.join(F.broadcast(picked), "doc_id").select(F.col("y").cast("int"), F.col("text").cast("string")) \
        .mapInArrow(run, "y int, words array<long>").groupBy("words").agg(F.max("y").alias("y"))


def training_rows(sets: DataFrame, groups, min_z: float, max_features: int) -> list:
    """``(y, features)`` of every row, with the features that tell the classes apart and the identity terms only.

    Features are counted and chosen in Spark; what reaches the driver is at most
    ``max_features`` hashes and the rows' few chosen ones.
    """
    size = sets.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos")).first()
    n, pos = float(size["n"]), float(size["pos"] or 0)
    terms = np.unique(np.concatenate([term_features(t) for g in groups for t in g])).view(np.int64).tolist()
    p, q = F.col("p") + 0.5, F.col("t") - F.col("p") + 0.5
    rest_p, rest_q = F.lit(pos + 1.0) - p, F.lit(n - pos + 1.0) - q
    odds = F.log(p) - F.log(rest_p) - F.log(q) + F.log(rest_q)
    z = F.abs(odds / F.sqrt(1 / p + 1 / rest_p + 1 / q + 1 / rest_q))
    chosen = sets.select("y", F.explode("words").alias("w")).groupBy("w") \
        .agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("t")).select("w", z.alias("z"), F.col("w").isin(terms).alias("term")) \
        .where((F.col("z") >= min_z) | F.col("term")).orderBy(F.desc("term"), F.desc("z"), "w").limit(max_features).collect()
    vocab = np.array(sorted(r["w"] for r in chosen), dtype=np.int64)

    def run(batches):
        for b in batches:
            sets = [np.array(w, dtype=np.int64) for w in b.column(1).to_pylist()]
            kept = [np.sort(w[np.isin(w, vocab, assume_unique=True)].view(np.uint64)).tobytes() for w in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.binary())], names=["y", "words"])

    rows = sets.select("y", "words").mapInArrow(run, "y int, words binary").collect()
    return [(r["y"], np.frombuffer(r["words"], np.uint64)) for r in rows]


class Model:
    """Intercept, sorted word hashes and their weights; at most ``max_features`` of them."""

    def __init__(self, bias: float, words: np.ndarray, weights: np.ndarray):
        self.bias, self.words, self.weights = float(bias), words, weights

    def score(self, offs, data) -> np.ndarray:
        rows = len(offs) - 1
        z = np.full(rows, self.bias)
        if len(self.words) and len(data):
            h, row = _row_words(offs, data)
            at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
            hit = self.words[at] == h
            pair = np.unique(row[hit] * np.int64(len(self.words)) + at[hit])
            z += np.bincount(pair // len(self.words), self.weights[pair % len(self.words)], minlength=rows)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _counted(sets: list) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, ascending, and in how many of the sets each is."""
    flat = np.concatenate(sets)
    flat.sort()
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
    return flat[first], np.diff(np.append(first, len(flat)))


def fit(rows: list, groups=IDENTITY_GROUPS, strength: float = 100.0, ridge: float = 1e-3, min_z: float = MIN_Z,
        max_features: int = MAX_FEATURES, steps: int = 300, seed: int = 7) -> Model:
    """Fit on labelled word sets (a bounded sample; rows are put in a fixed order first)."""
    rows = sorted(rows, key=lambda r: (r[0], r[1].tobytes()))
    y = np.array([r[0] for r in rows], dtype=np.float64)
    none = np.zeros(0, np.uint64)
    n, pos = len(y), y.sum()
    if pos == 0 or pos == n:
        return Model(np.log((pos + 0.5) / (n - pos + 0.5)) if n else 0.0, none, np.zeros(0))
    vocab, total = _counted([r[1] for r in rows])
    of_pos, some = _counted([r[1] for r in rows if r[0] == 1])
    p = np.zeros(len(vocab))
    p[np.searchsorted(vocab, of_pos)] = some
    q = total - p
    odds = np.log((p + .5) / (pos - p + .5)) - np.log((q + .5) / (n - pos - q + .5))
    z = odds / np.sqrt(1 / (p + .5) + 1 / (pos - p + .5) + 1 / (q + .5) + 1 / (n - pos - q + .5))
    named = [[term_features(t) for t in g] for g in groups]
    is_term = np.isin(vocab, np.concatenate([f for g in named for f in g]))
    use = (np.abs(z) >= min_z) | is_term
    order = np.flatnonzero(use)
    order = order[np.lexsort((vocab[order], -np.abs(z[order]) - 1e9 * is_term[order]))][:max_features]
    order = np.sort(order)
    if not len(order):
        return Model(np.log((pos + 0.5) / (n - pos + 0.5)), none, np.zeros(0))
    vocab, odds = vocab[order], odds[order]
    # of every row only the chosen features
    held = [np.searchsorted(vocab, r[1][np.isin(r[1], vocab, assume_unique=True)]) for r in rows]
    of, at = np.repeat(np.arange(n), [len(h) for h in held]), np.concatenate(held)

    # counterfactual pairs: a term's features go (sign -1), another's of its group come (+1);
    # linear scores need only the difference
    rng = np.random.default_rng(seed)

    def slots(features):
        k = np.minimum(np.searchsorted(vocab, features), len(vocab) - 1)
        return k[vocab[k] == features]

    place = [[slots(f) for f in g] for g in named]
    term_of = {int(np.searchsorted(vocab, f[0])): (i, j) for i, g in enumerate(named) for j, f in enumerate(g)
               if len(slots(f[:1]))}
    has = np.isin(at, list(term_of))
    pairs = []
    for a in at[has]:
        i, j = term_of[int(a)]
        pairs.append((place[i][j], place[i][rng.integers(len(place[i]))]))
    for _ in np.setdiff1d(np.arange(n), of[has]):
        g = place[rng.integers(len(place))]
        pairs.append((np.zeros(0, np.int64), g[rng.integers(len(g))]))
    which = np.repeat(np.arange(len(pairs)), [len(o) + len(i) for o, i in pairs])
    slot_of = np.concatenate([np.concatenate(p) for p in pairs]).astype(np.int64)
    sign = np.concatenate([np.repeat([-1.0, 1.0], [len(o), len(i)]) for o, i in pairs])

    x = odds[at]
    weight = np.where(y == 1, n / (2 * pos), n / (2 * (n - pos)))
    m = len(vocab)
    w, b = np.full(m, 0.1), 0.0
    gw, gb = np.full(m, 1e-8), 1e-8
    for _ in range(steps):
        s = np.bincount(of, x * w[at], minlength=n) + b
        e = weight * (1 / (1 + np.exp(-np.clip(s, -40, 40))) - y) / n
        grad = np.bincount(at, x * e[of], minlength=m) + ridge * w
        gap = np.bincount(which, sign * (w * odds)[slot_of], minlength=len(pairs))
        grad += 2 * strength / len(pairs) * np.bincount(slot_of, sign * gap[which] * odds[slot_of], minlength=m)
        gw += grad * grad
        gb += e.sum() ** 2
        w -= 0.3 * grad / np.sqrt(gw)
        b -= 0.3 * e.sum() / np.sqrt(gb)
    return Model(b, vocab, w * odds)


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, learn_from=None, groups=IDENTITY_GROUPS,
          min_z: float = MIN_Z, max_features: int = MAX_FEATURES, **params) -> Model:
    learn = F.lit(True) if learn_from is None else learn_from
    sets = materialize(training_sets(docs, labels, max_train, learn))
    return fit(training_rows(sets, groups, min_z, max_features), groups, min_z=min_z, max_features=max_features, **params)


def with_score(docs: DataFrame, model: Model, out: str) -> DataFrame:
    """``docs`` with a double column ``out`` (0 to 1) scored from ``text`` alone."""
    ship(docs.sparkSession)
    kept = docs.schema
    schema = type(kept)([*kept.fields]).add(out, "double")
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            if b.num_rows == 0:
                continue
            text = b.column(at)
            if pa.types.is_null(text.type):
                text = text.cast(pa.string())
            got = np.concatenate([model.score(o, d) for _, o, d in S.text_slices(text)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.float64())], names=[*b.schema.names, out])

    return docs.mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **params) -> DataFrame:
    """``docs`` without the rows that score at or over ``threshold``."""
    model = train(docs, labels, **params)
    col = "toxicity_score"
    while col in docs.columns:
        col += "_"
    return with_score(docs, model, col).where(F.col(col) < threshold).drop(col)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document's score; learnt from labelled rows that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), learn_from=~held_out())
    return with_score(docs, model, "score").select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op3_toxicity": op3_toxicity}
ORACLES: dict[str, str] = {}
