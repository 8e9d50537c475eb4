"""Periodic runs against brute force, on strings rich in repeats, and odd rows."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from concordia.llm import periods
from concordia.llm.shingles import mix

SCHEMA = "doc_id long, text string"


def brute(ws, least=12):
    """All runs by trying every period; a stretch counts with its smallest."""
    n, best = len(ws), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and ws[j] == ws[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                best.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, q, e - s) for (s, e), q in best.items())


def hashed(symbols):
    return mix(np.array([int(x) for x in symbols], dtype=np.uint64) + np.uint64(77))


def found(symbols, least=12):
    s, e, q = periods.runs_of(hashed(symbols), least=least)
    return [(int(a), int(c), int(b - a)) for a, b, c in zip(s, e, q)]


def fibonacci(n):
    a, b = "0", "01"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def thue_morse(n):
    return "".join(str(bin(i).count("1") % 2) for i in range(n))


@pytest.mark.parametrize("letters,n", [(2, 12), (2, 13)])
def test_every_short_binary_string(letters, n):
    for x in itertools.islice(itertools.product("01", repeat=n), 0, None, 3):
        assert found(x, least=2) == brute(x, least=2)


@pytest.mark.parametrize("seed", range(60))
def test_random_strings_with_planted_powers(seed):
    rng = np.random.default_rng(seed)
    out = []
    while len(out) < 300:
        root = list(rng.integers(0, rng.integers(1, 4) + 1, rng.integers(1, 40)))
        times = rng.integers(1, 6)
        out += (root * times)[: int(rng.integers(1, len(root) * times + 1))]
    assert found(out, least=2) == brute(out, least=2)
    assert found(out) == brute(out)


def test_strings_full_of_runs():
    for x in (fibonacci(400), thue_morse(400), "0" * 200, "01" * 100, "0" * 99 + "1" + "0" * 99, ("01" * 30 + "0") * 5,
              ("001" * 20 + "0") * 4 + "1", ("0" * 40 + "1" + "0" * 23 + "1") * 4, "0" * 50 + "1" * 50 + "0" * 50 + "1" * 50):
        assert found(x, least=2) == brute(x, least=2)


@pytest.mark.parametrize("p", [1, 2, 3])
def test_halves_in_touching_regions_of_one_small_period(p):
    # every run between two powers of one root, whatever the cut between them
    root = "0" * (p - 1) + "1"
    for a, b in itertools.product(range(20, 60, 7), range(20, 60, 9)):
        x = (root * 60)[:a] + (root * 60)[1:b] + "2" + root * 3
        assert found(x, least=2) == brute(x, least=2)


def test_a_long_text_and_its_memory():
    # a period of 700 words within 200,000 others
    rng = np.random.default_rng(5)
    w = rng.integers(0, 2**40, 200_000)
    w[50_000:50_000 + 700 * 5] = np.tile(w[50_000:50_700], 5)
    s, e, q = periods.runs_of(mix(w.astype(np.uint64)))
    assert (50_000, 700) in zip(s.tolist(), q.tolist()) and len(s) == 1


def report(doc_id, text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and ws:
        g, n = h // 10, len(ws)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        ws = [ws[i if i < a else a + (i - a) % p] for i in range(n)]
    rs = brute(ws)
    gone = {i for s, q, length in rs for i in range(s + q, s + length)}
    top = min(rs, key=lambda r: (-r[2], r[0], r[1]), default=None)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(rs), *((top[0], top[2], top[1], 1000 * top[2] // top[1]) if top else (None,) * 4),
            digest("".join(f"{s},{length},{q}\n" for s, q, length in rs)),
            digest(" ".join(w for i, w in enumerate(ws) if i not in gone)))


def rows():
    rng = np.random.default_rng(11)
    out = [(None, "a b " * 9), (1, None), (2, ""), (3, " \t\n"), (4, "x " * 11), (5, "x " * 12), (5, "x " * 12),
           (6, "A a " * 8), (7, "ü é\x0bü é\r" * 9), (8, "one two three"), (9, "\x00 " * 20)]
    for i in range(10, 150):
        n = int(rng.integers(1, 90))
        out.append((i, " ".join(f"w{x}" for x in rng.integers(0, 1 + i % 30, n)) + " \n"[i % 2] * (i % 3)))
    return out


def test_query_equals_brute_force(spark, tmp_path):
    given = rows()
    spark.createDataFrame(given, SCHEMA).withColumns({"runs": F.lit(1), "h": F.lit(2), "n": F.lit(3)}) \
        .repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = periods.op11_periodic_runs(spark, str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(report(*r)) for r in given)


def test_tables_of_runs_and_collapsed_texts(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    for r in periods.runs(docs).join(docs, "doc_id").collect():
        want = brute(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        assert [(x["start"], x["period"], x["length"]) for x in r["runs"]] == want
    texts = {r["doc_id"]: r["text"] for r in periods.collapsed(docs).collect()}
    assert texts[5] == "x" and texts[6] == "A a" and texts[1] == "" and texts[8] == "one two three"


def test_very_long_text_and_empty_table(spark):
    body = [f"w{i % 9973}x{i % 101}" for i in range(150_000)]
    body[1000:1000 + 60 * 7] = body[1000:1060] * 7
    docs = spark.createDataFrame([(21, " ".join(body)), (22, "spam " * 300_000)], SCHEMA)
    got = {r["doc_id"]: r for r in periods.run_report(docs).collect()}
    assert (got[21]["n_runs"], got[21]["start"], got[21]["period"], got[21]["length"]) == (1, 1000, 60, 420)
    assert (got[22]["n_runs"], got[22]["start"], got[22]["period"], got[22]["length"]) == (1, 0, 1, 300_000)
    assert periods.run_report(docs.where("doc_id < 0")).collect() == []
