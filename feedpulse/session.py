"""Session defaults shared by jobs, tests and the bench.

Everything here is plain Spark configuration: UTC session time zone (the
reference parses ISO timestamps as UTC), AQE on so shuffle partition counts
and skewed joins are re-planned at run time, and no web UI.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # dictionary joins stay broadcast only while the small side is proven small
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


# Settings for a large cluster (~100 TB inputs): start with many shuffle partitions and let
# AQE coalesce them towards the advisory size; split skewed partitions; larger file splits.
CLUSTER_DEFAULTS = {
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 1024 * 1024),
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": str(64 * 1024 * 1024),
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
    "spark.sql.parquet.aggregatePushdown": "true",
}


def build_session(master: str | None = None, app: str = "feedpulse",
                  shuffle_partitions: int | None = None, profile: str | None = None) -> SparkSession:
    """Local by default; ``profile='cluster'`` (or FEEDPULSE_PROFILE=cluster) adds CLUSTER_DEFAULTS
    and leaves the master to spark-submit."""
    profile = profile or os.environ.get("FEEDPULSE_PROFILE", "local")
    b = SparkSession.builder.appName(app)
    if profile != "cluster":
        b = b.master(master or os.environ.get("FEEDPULSE_MASTER", "local[8]"))
    for k, v in DEFAULTS.items():
        b = b.config(k, v)
    if profile == "cluster":
        for k, v in CLUSTER_DEFAULTS.items():
            b = b.config(k, v)
    if profile != "cluster":
        b = b.config("spark.driver.memory", os.environ.get("FEEDPULSE_DRIVER_MEM", "16g"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder is set by the cluster (a shared file system). Only a
    local master may go without: a folder is then made for the context. The
    setting itself is never changed at run time (Spark refuses that).
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="feedpulse-ckpt-", dir="/tmp")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for written intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table of its own under the shared folder, read back: it is computed once, its
    lineage ends there, and a lost executor cannot change its rows."""
    spark = df.sparkSession
    path = scratch_path(spark, f"tables/{name}-{uuid.uuid4().hex[:16]}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """A session setting for the jobs of a block of code; afterwards it is as before."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)
