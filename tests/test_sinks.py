"""Sinks that are called again: batches, retention, calls that fail."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from capsift.operators import ledger
from capsift.plans.compress import compress
from capsift.sources import sinks

FAILED = "capture_id long, ts timestamp, tool string, exit_code int, raw string"


def failures(spark, ids, tool="t"):
    return spark.createDataFrame([(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), f"{tool}{i % 3}", i % 5, f"out {i}") for i in ids], FAILED)


def kept(spark, path):
    return sorted(r.capture_id for r in sinks.read_failures(spark, path).collect())


def test_two_calls_leave_the_newest(spark, tmp_path):
    path = str(tmp_path / "f")
    sinks.write_failures(failures(spark, range(30)), path, 6)
    sinks.write_failures(failures(spark, [*range(25, 30), 31, 34, 2]), path, 6)
    want = sorted([i for i in [*range(30), 31, 34] if i % 5], reverse=True)[:6]
    assert kept(spark, path) == sorted(want)
    assert spark.read.parquet(path).count() == 6  # old versions are gone


def test_a_failed_call_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "f")
    sinks.write_failures(failures(spark, range(10)), path, 3)
    before = kept(spark, path)
    broken = failures(spark, range(10, 40)).withColumn("raw", F.when(F.col("capture_id") > 20, F.raise_error(F.lit("lost"))).otherwise(F.col("raw")))
    with pytest.raises(Exception, match="lost"):
        sinks.write_failures(broken, path, 3)
    assert kept(spark, path) == before
    sinks.write_failures(failures(spark, range(10, 40)), path, 3)
    assert kept(spark, path) == [37, 38, 39]


def test_missing_store(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        sinks.read_failures(spark, str(tmp_path / "none"))


def test_compressed_captures_go_to_the_ledger_once(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1 + i % 3), "git status", "git", "M  a.py\n" * (i + 1)) for i in range(9)]
    captures = spark.createDataFrame(rows, "capture_id long, ts timestamp, command string, tool string, raw string")
    path = str(tmp_path / "ledger")
    for _ in range(2):
        sinks.append_ledger(ledger.capture_savings(compress(captures), captures), path, "night-1")
    once = ledger.ledger_summary(spark.read.parquet(path)).first()
    assert once.runs == 9 and once.blocked_runs == 0 and once.tokens_saved >= 0
    sinks.append_ledger(ledger.capture_savings(compress(captures), captures), path, "night-2")
    sinks.append_ledger(ledger.capture_savings(compress(captures.where("capture_id < 2")), captures), path)
    assert ledger.ledger_summary(spark.read.parquet(path)).first().runs == 20
    assert ledger.ledger_daily(spark.read.parquet(path)).count() == 3
