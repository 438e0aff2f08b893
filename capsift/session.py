"""Session defaults and the one place that decides where durable scratch goes."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

#: Settings a job needs on any cluster size.  Shuffle partitions are a starting
#: point that adaptive execution coalesces; size it to cores x 2..3 on a cluster.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # Noting the call site of every column expression costs several calls to the JVM each.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "capsift", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's defaults; keyword ``a__b`` becomes ``a.b``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULT_CONF, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def durable_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and written intermediates.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local master may
    fall back to a temporary folder: on a cluster executors could not see it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return tempfile.mkdtemp(prefix="capsift-")
    raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
