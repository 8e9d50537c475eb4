"""Spark session helpers.

The library never creates machine-local scratch space on a cluster: the
checkpoint folder is read from ``spark.checkpoint.dir``; only when that is
unset (local tests, the bench) is a fresh temporary folder assigned.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # checkpoints go once nothing refers to them any more
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # small dimension tables (level lists, pair lists, fitted edges) are
    # broadcast explicitly behind size checks; keep the automatic threshold
    # at Spark's default so large sides never get broadcast by accident.
    "spark.sql.autoBroadcastJoinThreshold": str(10 * 1024 * 1024),
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "concordia", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, assigning a local one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="concordia-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for written intermediate tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "tables", name)


#: Shuffle files of a query go when it ends, not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Tasks that a table's small files are read by at least.
READERS = "spark.sql.files.minPartitionNum"


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value):
    """A setting of the session for what is planned meanwhile."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(value))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


#: Paths of tables that :func:`dropping` takes away, for every call that is under way.
_DROPPED: list[list[str]] = []


@contextlib.contextmanager
def dropping(spark: SparkSession):
    """Tables :func:`written` meanwhile go at the end, but those asked to be ``kept``."""
    _DROPPED.append([])
    try:
        yield
    finally:
        jvm = spark._jvm.org.apache.hadoop.fs
        for path in _DROPPED.pop():
            at = jvm.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df, *more, kept: bool = False):
    """Write a frame (``more``: its other parts, one after another) that several jobs read as a Parquet table under the shared checkpoint folder and read it back.

    For frames whose size counts: columns are compressed (one a feature beats an
    array), a reader takes those it needs, and the shuffles of this write leave
    the disk with it. ``kept``: it outlives :func:`dropping`.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"written-{uuid.uuid4().hex}")
    if _DROPPED and not kept:
        _DROPPED[-1].append(path)
    with setting(spark, CLEANUP, "true"):
        for part in (df, *more):
            part.write.mode("append").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize(df):
    """Write a frame that several jobs read to the shared checkpoint folder
    once (reliable checkpoint, lineage cut), instead of recomputing its
    upstream joins and aggregates in every consumer."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
