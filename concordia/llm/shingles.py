"""Vectorised word and shingle hashing for Arrow text columns (runs inside tasks).

A word is a maximal run of bytes outside ``{0x20, 0x09-0x0D}``; A-Z are
lower-cased first. Words are hashed without building Python strings: a prefix
polynomial over the bytes gives every word's hash by one subtraction. Texts are
taken in slices of a few MB, so memory follows the slice (or one very long
document), never the Arrow batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_U = np.uint64
# Odd multiplier of the byte polynomial and its seed.
_BASE = 0x9E3779B97F4A7C15
_SEED = 20240917

_rng = np.random.default_rng(_SEED)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
# Letters, digits and every byte of a multi-byte character; all else parts words.
NOT_LETTER = np.ones(256, dtype=bool)
NOT_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_MIX = tuple(int(v) | 1 for v in _rng.integers(1, 2**63, 4, dtype=np.uint64))
_POW = np.ones(1, dtype=np.uint64)
_INV = np.ones(1, dtype=np.uint64)


def _powers(n: int):
    global _POW, _INV
    if len(_POW) < n:
        m = 1 << (n - 1).bit_length()
        p = np.full(m, _BASE, dtype=np.uint64)
        q = np.full(m, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
        p[0] = q[0] = 1
        _POW, _INV = np.multiply.accumulate(p), np.multiply.accumulate(q)
    return _POW[:n], _INV[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x = x ^ (x >> _U(27))
    x = x * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def text_slices(col: pa.Array, limit: int = SLICE_BYTES):
    """Yield ``(first_row, offsets, bytes)`` for runs of rows of about ``limit`` bytes; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    n = len(col)
    if n == 0:
        return
    bufs = col.buffers()
    offs = np.frombuffer(bufs[1], dtype=np.int64)[col.offset: col.offset + n + 1]
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, offs[lo:hi + 1] - offs[lo], data[offs[lo]:offs[hi]]
        lo = hi


def words(offsets: np.ndarray, data: np.ndarray, lower: bool = True, separators: np.ndarray = _SPACE,
          prefix: int | None = None):
    """``(hash per word, first word of each row, start, end)`` for one slice of texts; ``prefix``: of so many bytes only."""
    n = len(data)
    rows = len(offsets) - 1
    if n == 0:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64), z, z
    inside = ~separators[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cut = offsets[(offsets > 0) & (offsets < n)]  # a row's edge ends a word
    begins[cut] = inside[cut]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[cut - 1] = inside[cut - 1]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    if prefix:
        end = np.minimum(end, start + prefix)
    p, inv = _powers(n)
    total = np.empty(n + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * p, out=total[1:])
    h = mix((total[end] - total[start]) * inv[start] + (end - start).astype(np.uint64))
    return h, np.searchsorted(start, offsets), start, end


def shingle_sets(h: np.ndarray, first: np.ndarray, size: int):
    """Yield each row's sorted distinct ``size``-word shingle hashes (fewer words: the whole sequence as one)."""
    a, b, c = (_U(v) for v in _MIX[:3])
    if len(h) >= size:
        acc = np.zeros(len(h) - size + 1, dtype=np.uint64)
        for j in range(size):
            acc = (acc ^ (acc >> _U(29))) * a + h[j: j + len(acc)] * b
        grams = mix(acc + c)
    else:
        grams = np.zeros(0, np.uint64)
    for i in range(len(first) - 1):
        lo, hi = int(first[i]), int(first[i + 1])
        k = hi - lo
        if k == 0:
            yield np.zeros(0, np.uint64)
        elif k < size:
            acc = np.uint64(k)
            with np.errstate(over="ignore"):
                for x in h[lo:hi]:
                    acc = (acc ^ (acc >> _U(29))) * a + x * b
            yield mix(np.array([acc], dtype=np.uint64) + _U(_MIX[3]))
        else:
            yield np.unique(grams[lo: hi - size + 1])


def minhash_params(k: int, seed: int):
    rng = np.random.default_rng(seed)
    return rng.integers(1, 2**63, k, dtype=np.uint64) | _U(1), rng.integers(1, 2**63, k, dtype=np.uint64)


def minhash(u: np.ndarray, params) -> np.ndarray:
    """Signature of ``k`` 63-bit minima over a set of shingle hashes: wide enough that unrelated sets share none by chance."""
    a, b = params
    out = np.full(len(a), np.iinfo(np.uint64).max, dtype=np.uint64)
    for lo in range(0, len(u), 2048):
        part = u[lo: lo + 2048]
        for_each = part[:, None] * a[None, :]
        for_each += b
        np.minimum(out, for_each.min(axis=0), out=out)
    return (out >> _U(1)).astype(np.int64)
