"""Daily ledger totals over a stream of usage rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from capsift.functions.text import bigint


def stream_ledger_daily(ledger: DataFrame, delay: str = "1 day") -> DataFrame:
    """Runs and savings per UTC day; a day closes once the watermark passes it."""
    timed = ledger.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    days = timed.groupBy(F.window("ts", "1 day").alias("w")).agg(
        bigint(F.count(F.lit(1))).alias("runs"), bigint(F.sum("tokens_saved")).alias("tokens_saved"))
    return days.select(F.to_date(F.col("w.start")).alias("date"), "runs", "tokens_saved")
