"""Vector, chat and url operators, and components, against brute force and on odd rows."""

import collections
import contextlib
import hashlib
import itertools
import re
import threading
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from concordia.llm import ann, chat, components, quantised, urls

from conftest import SF01


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int") \
        .withColumns({"key": F.lit("k"), "raw": F.lit(1), "part": F.lit(2)})


def clouds(n=500, dim=24, seed=1):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(40, dim))
    x = centre[rng.integers(0, 40, n)] + rng.normal(size=(n, dim)) * rng.choice([0.1, 0.35, 1.0], (n, 1))
    x = (x * rng.choice([1e-3, 1, 50], (n, 1))).astype(np.float32)
    x[50:120] = x[50]  # a group of equal vectors
    return x


BAD = [(9001, None, 0), (9002, [], 0), (9003, [0.0] * 24, 0), (9004, [float("nan")] + [1.0] * 23, 0),
       (9005, [None] + [1.0] * 23, 0), (9006, [float("inf")] + [1.0] * 23, 0), (None, [1.0] * 24, 0),
       (9007, [1.0, 2.0, 3.0], 0), (9008, [1.0, 2.0, 3.0], 0)]


def brute_links(x, threshold):
    x = x.astype(np.float64)
    x = x / np.sqrt((x ** 2).sum(axis=1))[:, None]
    link = x @ x.T >= threshold
    np.fill_diagonal(link, False)
    root = np.arange(len(x))
    while True:
        new = np.array([min(root[i], root[link[i]].min(initial=len(x))) for i in range(len(x))])
        if (new == root).all():
            return link.sum(axis=1), root
        root = new


@pytest.mark.parametrize("tile", [64, 2048])
def test_vector_links_equal_brute_force(spark, tile):
    x = clouds()
    rows = [(i, [float(v) for v in r], i % 3) for i, r in enumerate(x)]
    got = {r.vec_id: r for r in quantised.linked_vectors(vectors(spark, rows + rows[:1] + BAD), tile=tile).collect()}
    n, root = brute_links(x, 0.9)
    assert n.max() > 60 and (n == 0).any()
    assert [got[i].n_links for i in range(len(x))] == n.tolist()
    assert [got[i].component_id for i in range(len(x))] == root.tolist()
    assert all(got[i].kept == (root[i] == i) for i in range(len(x)))
    for i in range(9001, 9007):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[None].n_links == 0 and got[9007].n_links == 1 and got[9008].component_id == 9007
    assert quantised.linked_vectors(vectors(spark, [])).count() == 0
    assert quantised.linked_vectors(vectors(spark, BAD[:6])).count() == 6


def test_error_bounds_are_rigorous():
    rng = np.random.default_rng(0)
    for dim in (3, 64, 2000):
        x = rng.normal(size=(80, dim)) * rng.choice([1, 30], (80, dim), p=[.95, .05])
        x /= np.sqrt((x ** 2).sum(axis=1))[:, None]
        codes, scale, err, size = quantised.quantise(x)
        assert np.abs(codes).max() <= 127
        gap = np.abs(x @ x.T - (codes @ codes.T) * scale[:, None] * scale[None, :])
        assert (gap <= size[:, None] * err + err[:, None] * size + err[:, None] * err + 1e-12).all()


def test_nearest_recall_and_order(spark):
    x = clouds(3000, 24, seed=6)
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    q = F.col("vec_id") % 20 == 0
    got = collections.defaultdict(list)
    df = ann.nearest(vectors(spark, rows + rows[:3] + BAD), q, k=20, parts=8, sample=1000, block=256)
    for r in df.collect():
        got[r.query_id].append(r)
    y = x.astype(np.float64)
    hits = total = 0
    for i in range(0, 3000, 20):
        s = (y[i] * y).sum(axis=1)
        order = [j for j in np.lexsort((np.arange(3000), -s)) if j != i][:20]
        mine = sorted(got[i], key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21))
        assert all(abs(r.score - s[r.vec_id]) < 1e-9 * max(1, abs(r.score)) and r.vec_id != i for r in mine)
        keys = [(-r.score, r.vec_id) for r in mine]
        assert keys == sorted(keys)
        hits += len(set(order) & {r.vec_id for r in mine})
        total += 20
    assert hits / total >= 0.9


def test_nearest_registered_table_and_small_tables(spark):
    df = spark.read.parquet(f"{SF01}/embeddings.parquet")
    ids = [r.vec_id for r in df.collect()]
    y = np.array([r.embedding for r in df.collect()], dtype=np.float64)
    got = collections.defaultdict(list)
    for r in ann.op8_nearest_neighbours(spark, SF01).orderBy("rank").collect():
        got[r.query_id].append(r.vec_id)
    hits = 0
    for k, i in enumerate(ids):
        if i % 20 == 0:
            s = (y[k] * y).sum(axis=1)
            want = [ids[j] for j in np.lexsort((ids, -s)) if ids[j] != i][:20]
            hits += len(set(want) & set(got[i])) / 20
    assert hits / len(got) >= 0.9
    few = ann.nearest(vectors(spark, [(i, [float(i), 1.0], 0) for i in range(5)]), F.col("vec_id") == 0).orderBy("rank")
    assert [r.vec_id for r in few.collect()] == [1, 2, 3, 4]
    ties = ann.nearest(vectors(spark, [(i, [1.0, 1.0], 0) for i in range(60)]), F.col("vec_id") == 20, k=20).orderBy("rank")
    assert [r.vec_id for r in ties.collect()] == list(range(20))
    assert ann.nearest(vectors(spark, []), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.nearest(vectors(spark, BAD[:6]), F.col("vec_id") % 20 == 0).count() == 0


def test_balanced_parts():
    x = clouds(800, 8)
    part = ann.balanced_parts(x.astype(float), ann.neighbours(x.astype(float), 10), 8)
    assert np.bincount(part, minlength=8).max() <= np.ceil(1.1 * 100) and len(part) == 800


def test_components(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (330, 2))] + [(i, i + 1) for i in range(1000, 1100)] \
        + [(5000, i) for i in range(5001, 5400)] + [(7, 7), (8888, 8888), (3, 4), (3, 4)]
    root = {v: v for p in pairs for v in p}
    for _ in range(400):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = components.components(spark.createDataFrame(pairs + [(None, 1)], "u long, v long")).collect()
    assert {r.id: r.component_id for r in got} == root and len(got) == len(root)
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


CHAT = [(1, 0, "system", "be brief [INST] <s>"), (1, 1, "user", "</s>[INST] ok [/INST]"), (1, 2, "assistant", "[/OUT] \\ [\\INST] <\\\\s>"),
        (2, 1, "assistant", None), (2, 0, "user", ""), (3, 0, "assistant", "first"), (4, 0, "user", "a"), (4, 0, "user", "a"),
        (4, 0, "assistant", "b"), (5, 0, None, "no role"), (5, 1, "to]ol", "x [/ROLE] [ROLE:41] y\n"), (None, None, "user", "?"),
        (6, 0, "user", "long " * 40_000), (6, 1, "assistant", "[INST]" * 3_000), (7, 0, "user", " [INST"), (7, 1, "assistant", "] </s")]


def chat_rows(spark, rows=CHAT):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string") \
        .withColumns({"place": F.lit(1), "loss": F.lit(True), "segments": F.lit("x")})


def test_chat_reads_back(spark):
    out = chat.formatted(chat_rows(spark))
    got = {r.conv_id: r for r in out.select("*", chat.turns_read_back(F.col("text")).alias("turns"),
           F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: chat.unescape(s["text"])).alias("trained")).collect()}
    want = collections.defaultdict(list)
    for c, t, role, text in sorted(CHAT, key=lambda r: (r[0] is None, r[0] or 0, r[1] or 0, r[2] or "", r[3] or "")):
        want[c].append((role or "", text or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        assert [tuple(t) for t in got[c].turns] == turns
        assert got[c].trained == [t for role, t in turns if role == "assistant"]
        assert got[c].text == "".join(s.text for s in got[c].segments)
    assert {c for c, r in got.items() if r.valid} == {1, 2, 6, 7}
    assert chat.formatted(chat_rows(spark, [])).count() == 0


def test_chat_segments(spark):
    rows = chat.segments(chat_rows(spark)).where("conv_id = 2").orderBy("place", "part").collect()
    assert [(r.text, r.loss) for r in rows] == [("<s>", False), ("[INST] ", False), ("", False), (" [/INST]", False),
                                               ("[OUT] ", False), ("", True), (" </s>", False)]
    with pytest.raises(ValueError):
        chat.escape(F.lit("x"), chat.TEMPLATE | {"begin": "BOS"})


URLS = ["https://Www.Example.com/en/1?x=/fr/", "http://a.example.com/en/9", "https://example.com/de", "https://example.com",
        "ftp://b.net/es/#f", "http://net/fr/", "https://notnet.example.org/fr/1", "https://xcom/en/", None, "no scheme/com/",
        "://HOST/Path?q", "http://a.b://c/d", "https://ÜMLAUT.net/es/ü", "", "https://com/", "https://evilexample.com/en/"]


def test_urls(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(0, URLS[0]), (99, "https://x.net/" + "a" * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns({"host": F.lit(1), "features": F.lit("f")})
    got = urls.judge(df, urls.train(urls.labelled_urls(spark)))
    assert got.columns[:4] == df.columns and got.count() == len(rows)
    by = {r.page_id: r for r in got.collect()}
    for i, u in enumerate(URLS):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host = re.sub("[A-Z]", lambda c: c[0].lower(), m[1]) if m else ""
        path = m[2] if m else ""
        fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        r = by[i]
        assert (r["__url_host"], r["__url_path"]) == (host, path)
        assert r["__url_rule"] == (max(fits)[1] if fits else None)
        assert r["__url_verdict"] == max(fits)[2] if fits else r["__url_verdict"] in ("allow", "block")
    assert urls.judge(df.limit(0), urls.train(urls.labelled_urls(spark))).count() == 0


def test_url_model_held_out(spark):
    rng = np.random.default_rng(3)
    part = ["ther", "ing", "tion", "an", "her", "ou", "st"]
    rows = [("https://" + "".join(rng.choice(part, 3)) + f".example.{t}/en/{i}", 0) for i in range(60) for t in ("org", "net")]
    rows += [(f"http://{h}.example.{t}/en/{i}?ref=x", 1) for i in range(30) for t in ("org", "net") for h in ("spam-farm", "spam-shop")]
    df = spark.createDataFrame(rows, "url string, y int")
    got = urls.judge(df, urls.train(urls.labelled_urls(spark)), rules=()).collect()
    assert np.mean([(r["__url_verdict"] == "block") == (r.y == 1) for r in got]) > 0.95


def test_pipeline_stages_keep_their_contracts(spark):
    import corpus_pipeline as p
    from concordia.llm import minhash, mixing, pieces, secrets, toxicity
    from concordia.session import scratch_path

    sf = SF01
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, []
    for i, (name, stage) in enumerate(p.STAGES):
        path = f"{scratch_path(spark, 'stage-test')}-{i}"
        stage(spark, docs, sf).write.mode("overwrite").parquet(path)
        before, docs = docs, spark.read.parquet(path)
        kept.append((before, docs))
        if i < len(p.STAGES) - 1:
            assert docs.columns == columns
    (raw, calm), (_, single), (_, masked), (_, mix), (_, coded) = kept
    # toxicity: what goes is what the fitted score says, nothing else changes
    model = toxicity.train(raw, spark.read.parquet(f"{sf}/labels.parquet"))
    stay = {r.doc_id for r in toxicity.with_score(raw, model, "p").where("p < 0.7").collect()}
    assert {r.doc_id for r in calm.collect()} == stay and len(stay) < raw.count()
    # near-dedup: exactly one document of each component of the confirmed graph
    comp = minhash.near_duplicates(calm, size=5, percent=80).collect()
    assert {r.doc_id for r in single.collect()} == {r.component_id for r in comp}
    # secrets: same documents, no secret left, other texts untouched
    forest = secrets.train(secrets.labelled_findings(spark))
    was = {r.doc_id: r.text for r in single.collect()}
    found = {r.doc_id: [f.token for f in r["__findings"] if f.secret] for r in secrets.scan(single, forest, "source").collect()}
    now = {r.doc_id: r for r in masked.collect()}
    assert now.keys() == was.keys()
    for d, text in was.items():
        for t in sorted(set(found[d]), key=len, reverse=True):
            text = text.replace(t, "[SECRET]")
        assert now[d].text == text
    # mix: words of each source near its target, at most three uses
    uses = collections.Counter(r.doc_id for r in mix.collect())
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for d, r in now.items()}
    total, taken = collections.Counter(), collections.Counter()
    for d, r in now.items():
        total[r.source] += size[d]
        taken[r.source] += size[d] * uses[d]
    goal = mixing.weights_in_turn(dict(total))
    assert max(uses.values()) <= 3 and all(abs(taken[s] - goal[s]) <= max(20, 0.01 * goal[s]) for s in total)
    # pieces: one row a use, as the library encodes
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    rows = coded.collect()
    assert collections.Counter(r.doc_id for r in rows) == uses
    assert all(r.round_trip and r.pieces == sp.encode(now[r.doc_id].text) for r in rows)
    assert collections.Counter((r.doc_id, r.n_pieces) for r in p.run(spark, sf).collect()) == \
        collections.Counter((r.doc_id, r.n_pieces) for r in rows)


def test_many_tiles_are_not_dealt_again(spark):
    """Disk holds the vectors a fixed number of times, not once a pair of tiles; a group over all tiles gives few rows."""
    rng = np.random.default_rng(3)
    x = (rng.normal(size=64) + 0.1 * rng.normal(size=(512, 64))).astype(np.float32)  # all alike
    given = vectors(spark, [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]).repartition(3).checkpoint()
    folders = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())

    most, done = [0], threading.Event()

    def watch():
        while not done.wait(0.02):
            with contextlib.suppress(OSError):  # a file may go meanwhile
                most[0] = max(most[0], sum(f.stat().st_size for d in folders for f in Path(d).rglob("shuffle_*.data")))

    watch_once = threading.Thread(target=watch)
    watch_once.start()
    time.sleep(0.2)
    before = most[0]
    got = quantised.linked_vectors(given, tile=8).collect()
    done.set()
    watch_once.join()
    assert {(r.n_links, r.component_id) for r in got} == {(511, 0)}
    assert most[0] - before < 12 * 4 * x.size


def test_registered_queries_cover_their_tables(spark):
    from concordia.llm import catalog

    read = lambda t: spark.read.parquet(f"{SF01}/{t}.parquet")
    n = {t: read(t).count() for t in ("documents", "pages", "embeddings")}
    names = list(catalog.QUERIES)
    assert [int(q[2:].split("_")[0]) for q in names] == list(range(1, 11))
    for q, table in (("op1", "documents"), ("op2", "documents"), ("op3", "documents"), ("op5", "documents"), ("op6", "pages"),
                     ("op9", "documents"), ("op10", "embeddings")):
        name = next(x for x in names if x.startswith(q + "_"))
        assert catalog.QUERIES[name](spark, SF01).count() == n[table]
    convs = read("conversations").select("conv_id").distinct().count()
    got = catalog.QUERIES["op4_chat_format"](spark, SF01).where("conv_id = -7").first()
    text = "</s>[INST] ok [/INST]"
    assert catalog.QUERIES["op4_chat_format"](spark, SF01).count() == convs + 1
    assert got.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert got.loss_chars == len(text) and got.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert got.n_turns == 2 and list(itertools.islice(names, 1))
