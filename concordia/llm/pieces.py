"""Operator 9: subword pieces by suffix-array matching, and back to text.

Inside a task, each Arrow batch is cut into units (a word with its leading
space mark); units not met before are concatenated and indexed by a suffix
array. Every vocabulary piece is binary-searched in it for the range of its
occurrences; the occurrences are edges ``(start, end, piece)``. Edges are sorted
by end position and relaxed: a prefix's encoding ends in exactly one piece,
namely the edge whose piece is compatible with the last piece of the encoding
before it (the merge order would not have joined across the boundary). All
units relax one position at a time, together. Encodings of frequent units are
kept in a bounded store of two generations, so memory does not follow the text.

Units with two or more leading space marks (runs of spaces) are merged pair by
pair in rank order, since runs of marks share one rank; characters outside the
vocabulary become byte pieces.

Defined results: null and empty texts have no pieces and decode to the empty
text; repeated rows encode alike; a literal space mark in a text reads as a
space, as in the vocabulary's own definition.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shipping import ship

MODEL_FILE = "piece_bpe_32k.model"
TOKENIZER_DIR = "/opt/tokenizers"
STORE_UNITS = 120_000
MARK = "▁"  # fixed value: the space mark of the vocabulary
SLICE_BYTES = 2 << 20
#: Of a slice whose ids leave the task beside their texts: arrays held at once go with it.
ENCODED_SLICE_BYTES = 512 << 10
_FAR = np.int64(1) << 60


class Vocabulary:
    """Pieces, merge ranks, and the merge tree of every piece that encodes to itself."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        self.byte_ids = np.zeros(256, np.int32)
        self.raw = []
        for i, p in enumerate(self.pieces):
            if sp.is_byte(i):
                self.byte_ids[int(p[3:5], 16)] = i
                self.raw.append(bytes([int(p[3:5], 16)]))
            else:
                self.raw.append(b"" if special[i] else p.replace(MARK, " ").encode())
        plain = [i for i in range(n) if not special[i] and not sp.is_byte(i)]
        self.id_of = {self.pieces[i]: i for i in plain}
        # rank 0 is the best merge; a single character is never merged into being
        order = sorted(plain, key=lambda i: (-sp.get_score(i), i))
        self.score = {i: sp.get_score(i) for i in plain}
        self.rank = np.full(n, _FAR)
        for r, i in enumerate(order):
            self.rank[i] = r if len(self.pieces[i]) > 1 else -1
        chars = sorted({p for p in self.id_of if len(p) == 1})
        self.unknown = re.compile("([^" + re.escape("".join(chars)) + "])")
        self.code_of = np.zeros(0x110000, np.uint64)
        self.code_of[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1, dtype=np.uint64)
        self.bits = int(len(chars) + 1).bit_length()
        self.per = 63 // self.bits
        self.left = np.full(n, -1)
        self.right = np.full(n, -1)
        reach = []
        for p, i in self.id_of.items():
            if len(p) == 1:
                reach.append(i)
                continue
            got, last = self.merge(p)
            if got == [i]:
                self.left[i], self.right[i] = last
                reach.append(i)
        self.reach = np.array(sorted(reach), dtype=np.int64)
        self.n = n
        pairs = {}
        for p, i in self.id_of.items():
            for k in range(1, len(p)):
                a, b = self.id_of.get(p[:k]), self.id_of.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * n + b] = self.rank[i]
        keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_keys, self.pair_rank = keys, np.array([pairs[int(k)] for k in keys], dtype=np.int64)
        self.longest = max(len(p) for p in self.id_of)
        self._pack_pieces()
        self.raw_len = np.array([len(r) for r in self.raw], dtype=np.int64)
        self.raw_at = np.concatenate([[0], np.cumsum(self.raw_len)])
        self.raw_bytes = np.frombuffer(b"".join(self.raw), dtype=np.uint8)

    def merge(self, text: str):
        """Merge pair by pair, best rank first, leftmost first: ``(ids, the last merge's pair)``."""
        ids = [self.id_of[c] for c in text]
        nxt, prv = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap: list = []

        def offer(i):
            j = nxt[i]
            if j < len(ids):
                k = self.id_of.get(self.pieces[ids[i]] + self.pieces[ids[j]])
                if k is not None:
                    heapq.heappush(heap, (-self.score[k], i, ids[i], ids[j], k))

        for i in range(len(ids) - 1):
            offer(i)
        last = (-1, -1)
        while heap:
            _, i, a, b, k = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j >= len(ids) or ids[j] != b:
                continue
            last = (a, b)
            ids[i], ids[j] = k, -1
            nxt[i] = nxt[j]
            if nxt[i] < len(ids):
                prv[nxt[i]] = i
            if prv[i] >= 0:
                offer(prv[i])
            offer(i)
        return [i for i in ids if i >= 0], last

    def _pack_pieces(self):
        """Pieces as packed keys of ``per`` characters a level: lowest and highest suffix they begin."""
        texts = [self.pieces[i] for i in self.reach]
        levels = -(-self.longest // self.per)
        code = np.zeros((len(texts), levels * self.per), np.uint64)
        for r, t in enumerate(texts):
            code[r, :len(t)] = self.code_of[[ord(c) for c in t]]
        self.piece_len = np.array([len(t) for t in texts], dtype=np.int64)
        top = np.uint64((1 << self.bits) - 1)
        high = np.where(np.arange(code.shape[1])[None, :] < self.piece_len[:, None], code, top)
        self.levels = levels
        self.low_keys = [self.pack(code[:, k * self.per:(k + 1) * self.per]) for k in range(levels)]
        self.high_keys = [self.pack(high[:, k * self.per:(k + 1) * self.per]) for k in range(levels)]

    def pack(self, code: np.ndarray) -> np.ndarray:
        out = np.zeros(len(code), np.uint64)
        for j in range(self.per):
            out = (out << np.uint64(self.bits)) | code[:, j]
        return out

    def pair_rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.n + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_rank[at], _FAR)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the merges of ``a + b`` leave the boundary between the two pieces."""
        ok = np.ones(len(a), dtype=bool)
        live = np.arange(len(a))
        x, y = a.copy(), b.copy()
        limit = np.full(len(a), _FAR)
        while len(live):
            # the pair met before either side's undone merge: joined, so no boundary
            joined = self.pair_rank_of(x, y) < limit
            ok[live[joined]] = False
            go = ~joined & ((self.left[x] >= 0) | (self.left[y] >= 0))
            live, x, y = live[go], x[go], y[go]
            if not len(live):
                break
            rx, ry = self.rank[x], self.rank[y]
            back = rx >= ry  # undo the later merge; of equal ones the right one came later
            limit = np.where(back & (rx != ry), rx, ry + 1)
            eq = rx == ry
            limit = np.where(eq, ry + 1, limit)
            undo_left = back & ~eq
            x, y = np.where(undo_left, self.right[x], x), np.where(undo_left, y, self.left[y])
        return ok

    def encode_units(self, units: list[str]):
        """``(ids, offsets)`` of units whose characters are all in the vocabulary."""
        lens = np.array([len(u) for u in units], dtype=np.int64)
        text = "\0".join(units) + "\0"
        points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        code = self.code_of[points]
        n = len(code)
        begin = np.concatenate([[0], np.cumsum(lens + 1)[:-1]])
        # suffix array over the first two levels of characters; a longer piece's rest is compared where it occurs
        padded = np.concatenate([code, np.zeros(self.levels * self.per, np.uint64)])
        level = np.zeros(n + (self.levels - 1) * self.per, np.uint64)
        for j in range(self.per):
            level = (level << np.uint64(self.bits)) | padded[j:j + len(level)]
        keys = [level[k * self.per:k * self.per + n] for k in range(self.levels)]
        suffixes = np.lexsort((keys[1], keys[0])) if self.levels > 1 else np.argsort(keys[0], kind="stable")
        lo = np.zeros(len(self.reach), np.int64)
        hi = np.full(len(self.reach), n, np.int64)
        for k in range(min(2, self.levels)):
            col = keys[k][suffixes]
            new_lo = self._bisect(col, lo, hi, self.low_keys[k], False)
            hi = self._bisect(col, lo, hi, self.high_keys[k], True)
            lo = new_lo
        count = np.maximum(hi - lo, 0)
        which = np.repeat(np.arange(len(self.reach)), count)
        at = np.arange(len(which))
        at += np.repeat(lo - (np.cumsum(count) - count), count)
        start = suffixes[at]
        size, piece = self.piece_len[which], self.reach[which]
        for k in range(2, self.levels):
            rest = np.flatnonzero(size > k * self.per)
            there = keys[k][start[rest]]
            drop = rest[(there < self.low_keys[k][which[rest]]) | (there > self.high_keys[k][which[rest]])]
            if len(drop):
                which, start, size, piece = (np.delete(a, drop) for a in (which, start, size, piece))
        unit = np.repeat(np.arange(len(units)), lens + 1)
        end = start + size
        depth = end - begin[unit[start]]
        order = np.argsort(depth.astype(np.int32), kind="stable")
        del which, at, size
        start, end, piece, depth = start[order], end[order], piece[order], depth[order]
        last = np.full(n + 1, -1, np.int64)  # last piece of the encoding that ends before this position
        first = np.zeros(n + 1, dtype=bool)
        first[begin] = True
        cuts = np.flatnonzero(np.diff(depth)) + 1
        for lo_e, hi_e in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(depth)]])):
            s, e, p = start[lo_e:hi_e], end[lo_e:hi_e], piece[lo_e:hi_e]
            at_first = first[s]
            last[e[at_first]] = p[at_first]
            s, e, p = s[~at_first], e[~at_first], p[~at_first]
            known = last[s] >= 0
            s, e, p = s[known], e[known], p[known]
            if len(s):
                good = self.compatible(last[s], p)
                last[e[good]] = p[good]
        # walk back from every unit's end, all units a piece at a time
        length = np.zeros(self.n, np.int64)
        length[self.reach] = self.piece_len
        at, who = begin + lens, np.arange(len(units))
        ids, owner = [], []
        while len(who):
            p = last[at]
            ids.append(p)
            owner.append(who)
            at = at - length[p]
            more = at > begin[who]
            at, who = at[more], who[more]
        ids, owner = np.concatenate(ids), np.concatenate(owner)
        order = np.argsort(owner[::-1], kind="stable")
        ids = ids[::-1][order]
        return ids.astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(units)))])

    @staticmethod
    def _bisect(col, lo, hi, key, after):
        lo, hi = lo.copy(), hi.copy()
        while True:
            open_ = lo < hi
            if not open_.any():
                return lo
            mid = (lo + hi) >> 1
            v = col[np.minimum(mid, len(col) - 1)]
            right = open_ & ((v <= key) if after else (v < key))
            lo = np.where(right, mid + 1, lo)
            hi = np.where(open_ & ~right, mid, hi)


def _spread(first: np.ndarray, counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Positions of ``counts[i]`` items from ``first[i]`` on, for every i in turn."""
    out = np.arange(total[-1])
    out -= np.repeat(total[:-1] - first, counts)
    return out


class Encoder:
    """Encodes batches; frequent units stay in two bounded generations."""

    def __init__(self, vocab: Vocabulary, store: int = STORE_UNITS, group: int = 25_000):
        self.v, self.store, self.group = vocab, store, group
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _resolve(self, units: list[str]) -> list[bytes]:
        """Encodings of units (``mark + word``, or a part of a word), as little-endian int32 bytes."""
        new, old = self.new, self.old
        out = list(map(new.get, units))
        ask = []
        for i in [i for i, g in enumerate(out) if g is None]:
            u = units[i]
            got = old.get(u)
            if got is None:
                if u.startswith(MARK + MARK):
                    got = np.array(self.v.merge(u)[0], np.int32).tobytes()
                else:
                    ask.append(i)
                    continue
            out[i] = new[u] = got
        lo = 0
        while lo < len(ask):
            hi, chars = lo, 0
            while hi < len(ask) and hi - lo < self.group and chars < 8 * self.group:
                chars += len(units[ask[hi]]) + 1
                hi += 1
            part = [units[i] for i in ask[lo:hi]]
            ids, at = self.v.encode_units(part)
            raw, at = ids.tobytes(), (4 * at).tolist()
            for i, u, x, y in zip(ask[lo:hi], part, at, at[1:]):
                out[i] = got = raw[x:y]
                if y - x <= 256:
                    new[u] = got
            lo = hi
        if len(new) > self.store:
            self.old, self.new = new, {}
        return out

    def words(self, words: list[str]) -> list[bytes]:
        """Encodings of distinct words, each with its leading mark(s)."""
        points = np.frombuffer("\0".join(words).encode("utf-32-le", "replace"), dtype=np.uint32)
        ends = np.cumsum(np.array([len(w) for w in words], dtype=np.int64) + 1)
        odd = self.v.code_of[points] == 0
        odd[ends[:-1] - 1] = False  # the joints between words
        odd = np.unique(np.searchsorted(ends, np.flatnonzero(odd), side="right")).tolist()
        if not odd:
            return self._resolve(words)
        # characters outside the vocabulary part a word; they become byte pieces
        split = self.v.unknown.split
        parts = {i: split(words[i]) for i in odd}
        plain = [w for i, w in enumerate(words) if i not in parts]
        extra = list({c: None for cut in parts.values() for c in cut[::2] if c}.keys() - set(plain))
        got = self._resolve(plain + sorted(extra))
        by = dict(zip(plain, got)) | dict(zip(sorted(extra), got[len(plain):])) | {"": b""}
        rest = iter(got)
        return [next(rest) if i not in parts else b"".join(
            by[c] if k % 2 == 0 else self.v.byte_ids[list(c.encode("utf-8", "replace"))].tobytes()
            for k, c in enumerate(parts[i])) for i in range(len(words))]

    def encode(self, texts: pa.Array):
        """``(ids, offsets)`` of a text column; nulls are empty."""
        col = pc.replace_substring(texts.cast(pa.large_string()).fill_null(""), MARK, " ")
        empty = pc.equal(pc.binary_length(col), 0)
        runs = pc.or_(pc.match_substring(col, "  "), pc.or_(pc.starts_with(col, " "), pc.ends_with(col, " ")))
        n = len(col)
        if pc.any(runs).as_py():
            # a run of spaces belongs to the word behind it
            lists = [re.findall(" +[^ ]*", " " + t) if t else [] for t in col.to_pylist()]
            flat = pa.array([MARK * (len(u) - len(u.lstrip(" "))) + u.lstrip(" ") for x in lists for u in x], pa.string())
            counts = np.array([len(x) for x in lists], dtype=np.int64)
        else:
            split = pc.split_pattern(col, " ")
            counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
            keep = ~empty.to_numpy(zero_copy_only=False)
            flat = pc.binary_join_element_wise("", pc.list_flatten(split).cast(pa.string()), MARK)
            if not keep.all():
                flat = flat.filter(pa.array(np.repeat(keep, counts)))
                counts = np.where(keep, counts, 0)
        coded = flat.dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        got = self.words(coded.dictionary.to_pylist())
        size = np.array([len(g) for g in got], dtype=np.int64) // 4
        at = np.concatenate([[0], np.cumsum(size)])
        store = np.frombuffer(b"".join(got), np.int32)
        idx = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        per_word = size[idx]
        total = np.concatenate([[0], np.cumsum(per_word)])
        ids = store[_spread(at[idx], per_word, total)] if len(idx) else store[:0]
        bounds = np.concatenate([[0], np.cumsum(counts)])
        return ids, total[bounds]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """Texts of id sequences; bytes that are no UTF-8 become U+FFFD."""
        v = self.v
        per = v.raw_len[ids]
        total = np.concatenate([[0], np.cumsum(per)])
        raw = v.raw_bytes[_spread(v.raw_at[ids], per, total)]
        bounds = total[offsets]
        # the mark put before every text goes again
        filled = bounds[:-1] < bounds[1:]
        lead = np.zeros(len(bounds) - 1, np.int64)
        lead[filled] = raw[bounds[:-1][filled]] == 32
        data = raw.tobytes()
        texts = [data[bounds[i] + lead[i]:bounds[i + 1]].decode("utf-8", "replace") for i in range(len(lead))]
        return pa.array(texts, pa.string())


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per Python worker and model file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(Vocabulary(path))
    return _ENCODERS[path]


def model_path() -> str:
    return os.path.join(os.environ.get("TOKENIZER_DIR", TOKENIZER_DIR), MODEL_FILE)


def slices(b: pa.RecordBatch, text_at: int, limit: int = SLICE_BYTES):
    """Runs of rows of about ``limit`` bytes of text."""
    col = b.column(text_at).cast(pa.large_string()).fill_null("")
    size = np.concatenate([[0], np.cumsum(pc.binary_length(col).to_numpy(zero_copy_only=False).astype(np.int64))])
    lo = 0
    while lo < b.num_rows:
        hi = max(int(np.searchsorted(size, size[lo] + limit, side="right")) - 1, lo + 1)
        yield b.slice(lo, hi - lo), col.slice(lo, hi - lo)
        lo = hi


def encoded(batches, path: str):
    """Batches of (doc_id, text) as batches of (doc_id, n_pieces, pieces, round_trip), a slice of texts each."""
    pa.default_memory_pool().release_unused()  # what an earlier stage left in this worker
    enc = encoder(path)
    for batch in batches:
        for b, text in slices(batch, 1, ENCODED_SLICE_BYTES):
            ids, offs = enc.encode(text)
            back = enc.decode(ids, offs)
            plain = pc.replace_substring(text.cast(pa.string()), MARK, " ")
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.diff(offs), pa.int64()),
                 pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(ids, pa.int32())),
                 pc.equal(back, plain)],
                names=["doc_id", "n_pieces", "pieces", "round_trip"])


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, n_pieces, pieces, round_trip)`` per row: piece ids of the whole text, decoded again and compared."""
    path = path or model_path()
    ship(docs.sparkSession)

    def run(batches):
        yield from encoded(batches, path)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(run, "doc_id long, n_pieces long, pieces array<int>, round_trip boolean")


def piece_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """As :func:`encode`, with the ids' digest instead of the ids, so no id leaves the task."""
    path = path or model_path()
    ship(docs.sparkSession)

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            for b, text in slices(batch, 1):
                ids, offs = enc.encode(text)
                back = enc.decode(ids, offs)
                plain = pc.replace_substring(text.cast(pa.string()), MARK, " ")
                raw = ids.astype("<i4").tobytes()
                sums = [hashlib.sha256(raw[4 * offs[i]:4 * offs[i + 1]]).hexdigest() for i in range(b.num_rows)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(np.diff(offs), pa.int64()), pa.array(sums, pa.string()),
                     pc.equal(back, plain)], names=["doc_id", "n_pieces", "pieces_sha256", "round_trip"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(run, "doc_id long, n_pieces long, pieces_sha256 string, round_trip boolean")


def op9_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Every document's pieces: count, digest of the ids, and whether decoding gives the text again."""
    return piece_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op9_sentencepiece": op9_sentencepiece}
ORACLES: dict[str, str] = {}
