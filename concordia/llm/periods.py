"""Operator 11: periodic runs of words by string synchronising sets.

A run is a stretch of consecutive words with smallest period q (words q apart
are identical) and length >= max(``least``, 2 q) that no neighbouring word
extends. All runs of a text are found without comparing all pairs of places:

* Periods 1 to 4 are compared directly.
* Scale t = 2, 4, 8, ... finds the periods 3 t - 1 to 6 t - 2. Every place gets
  the hash of its t words; hashes of blocks with a period of at most t / 3 (known
  from smaller scales) do not count. A place is *selected* if, among the blocks
  that begin within t places from it, the smallest hash is the first or the last
  one's. Selection depends on 2 t words only, so it is the same wherever they
  recur, and any t consecutive places hold a selected one unless 3 t - 1 words
  there have a period of at most t / 3.
* A run of period q in that range thus holds a selected place and, q words on,
  another with the same 2 t words. Selected places are grouped by these words;
  pairs at a distance in the range propose (place, period). Equal contexts are
  more than t / 3 apart, so a place has at most some 18 partners: no all-pairs
  work however often a passage recurs.
* What selection omits: a run both of whose halves lie in regions of one small
  period p <= t / 3. Such regions touch, and the second fits the first at
  distances that are one value modulo p; these propose the run's period.
* A proposal is extended both ways by comparing fingerprints (polynomials modulo
  two primes) with halving steps. Of proposals for one stretch the smallest
  period counts.

Texts are taken in slices of about 1 MB, many short ones side by side, parted
by a word that occurs nowhere else. Documents are independent: nothing is
shuffled, and memory is some 150 bytes a word of the slice (or of one very long
document).

Defined results: null and empty texts and texts under ``least`` words have no
runs and collapse to their words; repeated rows are each judged; a null id stays
null; an empty table gives an empty result; extra columns are ignored. Words are
compared by 64-bit hash and length.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import mix, text_slices, words
from .shipping import ship

LEAST = 12
SMALL = 4
_U = np.uint64
_NONE = np.iinfo(np.uint64).max
# Two primes below 2**31 and the bases of the fingerprints, odd multiplier of the block hash.
_PRIMES = (2147483647, 2147483629)
_BASES = (1103515245, 1664525123)
_ODD = 0xD6E8FEB86659FD93
_RUN = "struct<start:long,length:long,period:long>"
WORD_BREAKS = r"[\x20\x09-\x0D]+"


class Fingerprints:
    """Compares stretches of words at two places in constant time."""

    def __init__(self, w: np.ndarray):
        self.n = n = len(w)
        self.sums, self.powers = [], []
        for prime, base in zip(_PRIMES, _BASES):
            power = np.ones(n + 1, np.int64)
            done, step = 1, base  # powers by doubling
            while done <= n:
                more = min(done, n + 1 - done)
                power[done:done + more] = power[:more] * step % prime
                done, step = done + more, step * step % prime
            total = np.zeros(n + 1, np.int64)
            np.cumsum((w % _U(prime)).astype(np.int64) * power[:n] % prime, out=total[1:])
            self.sums.append(total)
            self.powers.append(power)

    def same(self, a: np.ndarray, q: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Are the ``length`` words from ``a`` those from ``a + q``?"""
        ok = np.ones(len(a), bool)
        for prime, total, power in zip(_PRIMES, self.sums, self.powers):
            first = (total[a + length] - total[a]) % prime
            second = (total[a + q + length] - total[a + q]) % prime
            ok &= first * power[q] % prime == second
        return ok

    def extend(self, i: np.ndarray, q: np.ndarray):
        """``(start, end)`` of the longest stretch of period ``q`` around place ``i`` (end: after the later copy)."""
        right, left = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        step = 1 << max(self.n.bit_length() - 1, 0)
        while step:
            fits = np.flatnonzero(i + q + right + step <= self.n)
            if len(fits):
                at = i[fits] + right[fits]
                right[fits[self.same(at, q[fits], step)]] += step
            fits = np.flatnonzero(i - left - step >= 0)
            if len(fits):
                at = i[fits] - left[fits] - step
                left[fits[self.same(at, q[fits], step)]] += step
            step >>= 1
        return i - left, i + q + right


class Found:
    """Runs so far: ``start``, ``end``, ``period``, one a stretch, its smallest period."""

    def __init__(self):
        self.start = self.end = self.period = np.zeros(0, np.int64)

    def add(self, start, end, period):
        long = end - start >= 2 * period
        s, e, q = (np.concatenate([a, b[long]]) for a, b in ((self.start, start), (self.end, end), (self.period, period)))
        order = np.lexsort((q, e, s))
        s, e, q = s[order], e[order], q[order]
        first = np.ones(len(s), bool)
        first[1:] = (s[1:] != s[:-1]) | (e[1:] != e[:-1])
        self.start, self.end, self.period = s[first], e[first], q[first]


def small_periods(w: np.ndarray, found: Found, most: int = SMALL) -> None:
    for q in range(1, min(most, len(w) // 2) + 1):
        same = np.concatenate([[False], w[:-q] == w[q:], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        found.add(edges[::2], edges[1::2] + q, np.full(len(edges) // 2, q, np.int64))


def selected(block: np.ndarray, t: int, found: Found) -> np.ndarray:
    """Places of the synchronising set of scale ``t``; ``block[i]``: hash of the ``t`` words from ``i``."""
    m = len(block)
    mark = np.zeros(m + 1, np.int32)
    dense = (3 * found.period <= t) & (found.end - found.start >= t)
    np.add.at(mark, found.start[dense], 1)
    np.add.at(mark, found.end[dense] - t + 1, -1)
    value = np.where(np.cumsum(mark[:m]) > 0, _NONE, block)
    least, width = value, 1  # smallest of ``width`` consecutive values
    while 2 * width <= t:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = t + 1 - width
    least = np.minimum(least[:len(least) - rest], least[rest:])
    k = len(least)
    return np.flatnonzero((least != _NONE) & ((least == value[:k]) | (least == value[t:t + k])))


def context_pairs(at: np.ndarray, context: np.ndarray, low: int, high: int):
    """``(place, distance)`` of places with equal contexts, ``low <= distance <= high``, one a chain of overlapping contexts."""
    order = np.argsort(context, kind="stable")
    p, c = at[order], context[order]
    places, gaps = [], []
    lag = 1
    while lag < len(p):
        gap = p[lag:] - p[:-lag]
        near = (c[lag:] == c[:-lag]) & (gap <= high)
        if not near.any():
            break
        take = near & (gap >= low)
        places.append(p[:-lag][take])
        gaps.append(gap[take])
        lag += 1
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, q = np.concatenate(places), np.concatenate(gaps)
    order = np.lexsort((i, q))
    i, q = i[order], q[order]
    first = np.ones(len(i), bool)
    first[1:] = (q[1:] != q[:-1]) | (i[1:] - i[:-1] > (low + 1) // 3)
    return i[first], q[first]


def region_pairs(prints: Fingerprints, t: int, found: Found, low: int, high: int):
    """``(place, period)`` proposed by touching regions of one small period (``3 p <= t``)."""
    dense = (3 * found.period <= t) & (found.end - found.start >= low)
    s, e, p = found.start[dense], found.end[dense], found.period[dense]
    order = np.lexsort((s, p))
    s, e, p = s[order], e[order], p[order]
    touch = np.flatnonzero((p[1:] == p[:-1]) & (s[1:] <= e[:-1])) if len(s) else []
    places, gaps = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in touch:
        s1, e1, s2, e2, period = int(s[k]), int(e[k]), int(s[k + 1]), int(e[k + 1]), int(p[k])
        shift = np.arange(period)
        fit = np.flatnonzero(prints.same(s1 + shift, s2 - s1 - shift, period))
        if not len(fit):
            continue
        q = np.arange((s2 - s1 - int(fit[0])) % period, min(high, e1 - s1, e2 - s2, (e2 - s1) // 2) + 1, period)
        q = q[q >= low]
        places.append(np.maximum(s1, s2 - q))
        gaps.append(q)
    return np.concatenate(places), np.concatenate(gaps)


def runs_of(w: np.ndarray, longest: int | None = None, least: int = LEAST):
    """``(start, end, period)`` of all runs of a word sequence (64-bit hashes), by start, then period.

    ``longest``: no run is longer than this (the longest of several parted texts).
    """
    longest = len(w) if longest is None else longest
    found = Found()
    if longest >= least:
        small_periods(w, found)
        prints = None
        block, t = mix(w[:-1] * _U(_ODD) + w[1:]), 2
        while 2 * (3 * t - 1) <= longest:
            low, high = 3 * t - 1, 6 * t - 2
            double = mix(block[:-t] * _U(_ODD) + block[t:])
            at = selected(block, t, found)
            at = at[at < len(double)]
            i, q = context_pairs(at, double[at], low, high)
            prints = prints or Fingerprints(w)
            j, r = region_pairs(prints, t, found, low, high)
            i, q = np.concatenate([i, j]), np.concatenate([q, r])
            if len(i):
                found.add(*prints.extend(i, q), q)
            block, t = double, 2 * t
    keep = found.end - found.start >= least
    s, e, q = found.start[keep], found.end[keep], found.period[keep]
    order = np.lexsort((q, s))
    return s[order], e[order], q[order]


def slice_runs(offsets: np.ndarray, data: np.ndarray, least: int = LEAST):
    """Yield ``(row, words, runs, dropped)`` for a slice of texts: runs as ``(start, length, period)`` rows by word
    number, ``dropped`` marking the words that a run holds after its first period (None: no run)."""
    h, first, _, _ = words(offsets, data, lower=False)
    rows = len(offsets) - 1
    count = np.diff(first)
    # a word of its own after every text
    w = np.empty(len(h) + rows, np.uint64)
    origin = first[:-1] + np.arange(rows)
    w[np.arange(len(h)) + np.repeat(np.arange(rows), count)] = h
    w[origin + count] = mix(np.arange(rows, dtype=np.uint64) + _U(_ODD))
    s, e, q = runs_of(w, int(count.max(initial=0)), least)
    row = np.searchsorted(origin, s, side="right") - 1
    cut = np.searchsorted(row, np.arange(rows + 1))
    for r in range(rows):
        a, b = cut[r], cut[r + 1]
        if a == b:
            yield r, int(count[r]), np.zeros((0, 3), np.int64), None
            continue
        begin, end, period = s[a:b] - origin[r], e[a:b] - origin[r], q[a:b]
        mark = np.zeros(count[r] + 1, np.int64)
        np.add.at(mark, begin + period, 1)
        np.add.at(mark, end, -1)
        yield r, int(count[r]), np.stack([begin, end - begin, period], axis=1), np.cumsum(mark[:-1]) > 0


def _texts(batch, least):
    """Yield ``(row, raw text, words, runs, dropped)`` of an Arrow batch whose second column is the text."""
    for lo, offsets, data in text_slices(batch.column(1)):
        for r, n, runs, dropped in slice_runs(offsets, data, least):
            yield lo + r, data[offsets[r]:offsets[r + 1]], n, runs, dropped


def kept_words(raw: np.ndarray, dropped) -> bytes:
    """A text's words without the dropped ones, joined by one space."""
    ws = raw.tobytes().split()
    return b" ".join(ws if dropped is None else [x for x, gone in zip(ws, dropped) if not gone])


def _input(docs: DataFrame) -> DataFrame:
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``(doc_id, n_words, runs array of (start, length, period))`` per row, runs by start, then period."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for b in batches:
            at, n, out = [], [], []
            for row, _, count, found, _ in _texts(b, least):
                at.append(row)
                n.append(count)
                out.append([dict(zip(("start", "length", "period"), x)) for x in found.tolist()])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(n, pa.int64()),
                                              pa.array(out, kind)], names=["doc_id", "n_words", "runs"])

    return _input(docs).mapInArrow(run, f"doc_id long, n_words long, runs array<{_RUN}>")


def collapsed(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``(doc_id, text)``: words joined by one space, of every run its first period only (and what no other run drops)."""
    def run(batches):
        for b in batches:
            at, out, size = [], [], 0
            for row, raw, _, _, dropped in _texts(b, least):
                at.append(row)
                out.append(kept_words(raw, dropped).decode())
                size += len(out[-1])
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(out, pa.string())],
                                                     names=["doc_id", "text"])
                    at, out, size = [], [], 0
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(out, pa.string())],
                                             names=["doc_id", "text"])

    return _input(docs).mapInArrow(run, "doc_id long, text string")


def run_report(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Per row the number of runs, the longest one, and digests of all runs and of the collapsed text."""
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]

    def run(batches):
        for b in batches:
            at, n, best, marks, texts = [], [], [], [], []
            for row, raw, _, found, dropped in _texts(b, least):
                at.append(row)
                n.append(len(found))
                k = np.lexsort((found[:, 2], found[:, 0], -found[:, 1]))[:1]
                s, length, q = found[k[0]].tolist() if len(k) else (None, None, None)
                best.append((s, length, q, 1000 * length // q if len(k) else None))
                lines = "".join(f"{s},{length},{q}\n" for s, length, q in found.tolist())
                marks.append(hashlib.sha256(lines.encode()).hexdigest())
                texts.append(hashlib.sha256(kept_words(raw, dropped)).hexdigest())
            cols = list(zip(*best)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64())), pa.array(n, pa.int64()), *(pa.array(c, pa.int64()) for c in cols),
                 pa.array(marks, pa.string()), pa.array(texts, pa.string())], names=names)

    kinds = ["long"] * 6 + ["string"] * 2
    return _input(docs).mapInArrow(run, ", ".join(f"{a} {k}" for a, k in zip(names, kinds)))


def with_tails(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)``: with h the crc32 of the decimal id, where 10 divides h the words from the a-th on repeat with
    period p; a = g mod n, p = 1 + (n - a) div (3 + g mod 8), g = h div 10. Null ids have no such tail."""
    h = F.crc32(F.col("doc_id").cast("string"))
    ws = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.filter(
        F.split("text", WORD_BREAKS), lambda x: x != "")).alias("ws")) \
        .select("*", F.size("ws").alias("n"), F.floor(F.col("h") / 10).alias("g"))
    at = ws.select("*", F.when(F.col("n") > 0, F.col("g") % F.col("n")).alias("a")) \
        .select("*", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).alias("p"))
    tail = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - F.lit(1).cast("long")), lambda i: F.get(
        "ws", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    return at.select("doc_id", F.when(F.col("n") > 0, F.array_join(tail, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of every document, a tenth of them with a repeating tail."""
    return run_report(with_tails(spark.read.parquet(f"{sf_dir}/documents.parquet")))


QUERIES = {"op11_periodic_runs": op11_periodic_runs}
# All periods of all texts have no SQL form that ends; tests compare with brute force.
ORACLES: dict[str, str] = {}
