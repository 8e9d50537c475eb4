"""Operator 7: token counts by offset-mapped attribution.

A document is encoded once, as a whole; the byte-level vocabulary makes every
token a byte span, which the span's characters turn into a character span. The
spans are interval-joined to the document's sections (a partition of the text:
by default its lines, each with its line break), and a token that crosses a
boundary is allocated by an explicit rule:

``start``     to the section of its first character
``end``       to the section of its last character
``majority``  to the section that holds most of its characters, ties to the first
``split``     to every section it touches, in proportion to the characters there

Any rule's counts add up to the document's token count. A token that begins or
ends within a character covers that character.

Defined results: null and empty texts have one empty section and no tokens;
repeated rows are counted each; documents are independent, so nothing is
shuffled, and memory follows the longest document. Very long runs of white
space, letters, digits or signs are encoded like any text.
"""

from __future__ import annotations

import base64
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shipping import ship

RANKS_FILE = "byte_bpe_50k.tiktoken"
TOKENIZER_DIR = "/opt/tokenizers"
# Fixed value: the vocabulary's own pre-splitting pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RULES = ("start", "end", "majority", "split")
#: Runs of white space over this length are encoded apart from the text around them.
LONG_SPACE = 10_000
# What the pattern's white space is.
_LONG = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % (LONG_SPACE + 1))
_ENCODERS: dict[str, tuple] = {}


def ranks_path() -> str:
    return os.path.join(os.environ.get("TOKENIZER_DIR", TOKENIZER_DIR), RANKS_FILE)


def encoder(path: str):
    """``(encoding, byte length of every token)``, loaded once per Python worker."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for raw, i in ranks.items():
            sizes[i] = len(raw)
        _ENCODERS[path] = (tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes)
    return _ENCODERS[path]


def encode_whole(enc, text: str) -> list[int]:
    """A text's ids. The library's pattern search recurses through white space, so a long run is cut out: the pattern
    takes all of it but the last character before a word as one piece, which is encoded as such."""
    out, done = [], 0
    for run in _LONG.finditer(text):
        a, b = run.span()
        if b < len(text):
            b -= 1
        out += enc.encode_ordinary(text[done:a])
        out += enc._encode_single_piece(text[a:b].encode())
        done = b
    return out + enc.encode_ordinary(text[done:]) if done else enc.encode_ordinary(text)


def token_spans(path: str, text: str):
    """``(ids, first character, end character)`` of a text's tokens."""
    enc, sizes = encoder(path)
    ids = np.array(encode_whole(enc, text), dtype=np.int64)
    ends = np.cumsum(sizes[ids])
    raw = np.frombuffer(text.encode(), np.uint8)
    if len(raw) == len(text):
        return ids, ends - sizes[ids], ends
    char = np.cumsum((raw & 0xC0) != 0x80) - 1  # the character of every byte
    return ids, char[ends - sizes[ids]], char[ends - 1] + 1


def line_starts(text: str) -> np.ndarray:
    """First character of every line; a final line break opens no further line."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    at = np.flatnonzero(points == 10) + 1
    return np.concatenate([[0], at[at < len(points)]])


def allocate(start: np.ndarray, end: np.ndarray, sections: np.ndarray, length: int, rule: str):
    """Tokens per section, and how many tokens cross a boundary. ``sections``: ascending first characters."""
    n = len(sections)
    first = np.searchsorted(sections, start, side="right") - 1
    last = np.searchsorted(sections, np.maximum(end - 1, start), side="right") - 1
    crossing = first < last
    if rule == "start" or not crossing.any():
        return np.bincount(first, minlength=n).astype(np.float64), int(crossing.sum())
    if rule == "end":
        return np.bincount(last, minlength=n).astype(np.float64), int(crossing.sum())
    out = np.bincount(first[~crossing], minlength=n).astype(np.float64)
    bounds = np.append(sections, length)
    for a, b, lo, hi in zip(start[crossing], end[crossing], first[crossing], last[crossing]):
        k = np.arange(lo, hi + 1)
        part = np.minimum(b, bounds[k + 1]) - np.maximum(a, bounds[k])
        if rule == "majority":
            out[k[np.argmax(part)]] += 1
        else:
            out[k] += part / part.sum()
    return out, int(crossing.sum())


def section_tokens(docs: DataFrame, rule: str = "start", path: str | None = None, sections: str | None = None) -> DataFrame:
    """``(doc_id, section, first_char, end_char, n_tokens, n_crossing)`` per section of every row.

    ``sections``: an array column of first characters (0 is added, others put in
    order); without it sections are lines. ``n_crossing`` is the document's.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = path or ranks_path()
    ship(docs.sparkSession)

    def run(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            cuts = b.column(2).to_pylist()
            out = [[], [], [], [], [], []]
            held = 0
            for i, text in enumerate(b.column(1)):
                text = text.as_py() or ""
                _, start, end = token_spans(path, text)
                if cuts[i] is None:
                    at = line_starts(text)
                else:
                    at = np.unique([0, *(c for c in cuts[i] if c is not None and 0 < c < len(text))]).astype(np.int64)
                got, crossing = allocate(start, end, at, len(text), rule)
                for k, v in enumerate((np.full(len(at), i), np.arange(len(at)), at, np.append(at[1:], len(text)),
                                       got, np.full(len(at), crossing))):
                    out[k].append(v)
                held += len(at)
                if held > 100_000 or i == len(ids) - 1:
                    row, *cols = (np.concatenate(c) for c in out)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(row)), *(pa.array(c, pa.int64()) for c in cols[:3]),
                         pa.array(cols[3], pa.float64()), pa.array(cols[4], pa.int64())],
                        names=["doc_id", "section", "first_char", "end_char", "n_tokens", "n_crossing"])
                    out, held = [[], [], [], [], [], []], 0

    cut = F.col(sections).cast("array<long>") if sections else F.lit(None).cast("array<long>")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       cut.alias("cuts")).mapInArrow(
        run, "doc_id long, section long, first_char long, end_char long, n_tokens double, n_crossing long")


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document; a token across lines counts where it begins."""
    got = section_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), rule="start")
    return got.withColumn("n_tokens", F.col("n_tokens").cast("long"))


QUERIES = {"op7_token_counts": op7_token_counts}
ORACLES: dict[str, str] = {}
