"""Sinks: ledger rows by date and batch, kept failures by tool."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from capsift.operators.ledger import recent_failures

_VERSION = "version="


def append_ledger(rows: DataFrame, path: str, batch: str | None = None) -> None:
    """Appends usage rows as parquet under ``date=.../batch=...``.

    A call that names a ``batch`` again replaces what that batch wrote on its dates, so a job
    that runs twice counts once, and one that failed half-way is mended by running again.
    Without a name every call is a batch of its own.  Adaptive execution splits a busy day by
    its measured size and joins quiet ones, so writers grow with the data and a quiet day
    leaves no swarm of small files.  Rows need a ``ts``; usage and blocked rows have it where
    their input does.
    """
    if "ts" not in rows.columns:
        raise ValueError("ledger rows need a column ts: give the captures or commands one")
    dated = rows.withColumns({"date": F.to_date("ts"), "batch": F.lit(batch or uuid.uuid4().hex)})
    (dated.hint("rebalance", "date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("date", "batch").parquet(path))


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Versions of kept failures that were written whole, oldest first."""
    at, system = _file_system(spark, path)
    if not system.exists(at):
        return []
    found = []
    for entry in system.listStatus(at):
        name = entry.getPath().getName()
        if name.startswith(_VERSION) and system.exists(spark._jvm.org.apache.hadoop.fs.Path(entry.getPath(), "_SUCCESS")):
            found.append(int(name[len(_VERSION):]))
    return sorted(found)


def read_failures(spark: SparkSession, path: str) -> DataFrame:
    """The failures that ``write_failures`` keeps with a limit: its newest whole version."""
    versions = _versions(spark, path)
    if not versions:
        raise FileNotFoundError(f"no kept failures in {path}")
    return spark.read.parquet(f"{path}/{_VERSION}{versions[-1]}")


def write_failures(captures: DataFrame, path: str, n: int | None = None) -> None:
    """Raw output of failed captures, all appended, or the newest ``n`` of those kept before and these.

    With a limit each call writes a new version from the last whole one and the new rows (a capture
    that is there already counts once), and then removes the old ones.  A call that dies leaves the
    last whole version in place; what it left unfinished is not read and is overwritten later.
    One writer at a time.
    """
    if n is None:
        failed = captures.where(F.col("exit_code") != 0)
        failed.hint("rebalance", "tool").write.mode("append").partitionBy("tool").parquet(path)
        return
    spark, versions = captures.sparkSession, _versions(captures.sparkSession, path)
    failed = captures.where(F.col("exit_code") != 0)
    if versions:
        failed = failed.unionByName(read_failures(spark, path), allowMissingColumns=True)
    failed = failed.dropDuplicates([c for c in ("capture_id", "ts") if c in failed.columns])
    latest = (versions[-1] if versions else 0) + 1
    recent_failures(failed, n).write.mode("overwrite").partitionBy("tool").parquet(f"{path}/{_VERSION}{latest}")
    for version in versions:
        at, system = _file_system(spark, f"{path}/{_VERSION}{version}")
        system.delete(at, True)
