"""Session construction and shared-folder helpers."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on: UTC so dates never shift, AQE so joins and
# partition counts are re-planned from real shuffle sizes, skew-join splitting
# for hot loan numbers / directories.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # AQE may replace a sort-merge join by a shuffled hash join (no sort of
    # the large side) when every measured build partition fits in 64 MB.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Generated code of the wide report projections exceeds the JIT's 8 KB
    # method limit; let HotSpot compile it instead of interpreting it.
    "spark.driver.extraJavaOptions": "-XX:-DontCompileHugeMethods",
    "spark.executor.extraJavaOptions": "-XX:-DontCompileHugeMethods",
}

# Suggested settings for a large cluster (about 100 TB of input): AQE sizes
# shuffle partitions from the data, splits skewed join partitions and turns
# joins into broadcasts only when the measured side is small.
CLUSTER_CONF = {
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64m",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "256m",
    "spark.sql.files.maxPartitionBytes": "512m",
    "spark.sql.parquet.filterPushdown": "true",
}


def get_session(master: str | None = None, app_name: str = "strata",
                shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster-shared folder for written intermediate tables.

    Read from ``spark.checkpoint.dir`` (or the context's checkpoint dir).  On a
    cluster one of them must be set: a machine-local folder would hold only
    that machine's part files, so there is no fallback and this raises.  Only
    a ``local[...]`` session -- one process, as in tests -- gets a fresh folder
    of its own, registered so that later calls agree.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        return conf_dir.rstrip("/")
    try:  # classic sessions only; Spark Connect has no SparkContext
        ctx = spark.sparkContext
    except Exception:  # noqa: BLE001
        ctx = None
    ctx_dir = ctx.getCheckpointDir() if ctx is not None else None
    if ctx_dir:
        return ctx_dir.rstrip("/")
    if ctx is None or not re.fullmatch(r"local(\[[^\]]*\])?", ctx.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    ctx.setCheckpointDir(os.path.join(os.environ.get("STRATA_SCRATCH", "/tmp"), f"strata-ckpt-{uuid.uuid4().hex[:12]}"))
    return ctx.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
