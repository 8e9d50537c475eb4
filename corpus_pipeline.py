"""Corpus preparation as a chain of stages over ``documents``.

Every stage is ``(spark, docs, sf_dir) -> DataFrame``. ``run`` writes each
result as Parquet into the shared checkpoint folder and rereads it as the next
stage's ``docs``, so a lost executor never repeats more than one stage.

Stages judge rows: ids may be null or repeat, and rows that share an id but
differ are kept or dropped each on its own (equal rows count as one in
near-dedup).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from concordia.llm import minhash, mixing, pieces, secrets, toxicity
from concordia.session import scratch_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scoring 0.7 or more go; the classifier learns from the labelled ones."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8) stays."""
    return minhash.keep_one(docs, size=5, percent=80)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are masked."""
    return secrets.redact(docs, secrets.train(secrets.labelled_findings(spark)), "source")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources (weights 1, 2, 3 in turn) uses them."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, and whether decoding them gives the text again."""
    return pieces.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", near_dedup),
    ("secret_scan", mask_secrets),
    ("source_mixing", mix_sources),
    ("sentencepiece", encode),
]

# A fitted classifier and forest, and subword ids, have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = scratch_path(spark, f"pipeline-{uuid.uuid4().hex}")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{base}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
