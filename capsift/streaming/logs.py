"""Log template counts per tumbling window over a stream of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from capsift.functions.text import bigint, normalize_log_line
from capsift.operators.logs import with_severity


def stream_log_templates(lines: DataFrame, window: str = "1 hour", delay: str = "1 day",
                         dedupe: bool = True) -> DataFrame:
    """Counts per window, severity and template.

    ``lines`` carries ``ts``.  With ``dedupe`` a replayed line (same capture and
    line number) within the watermark counts once.
    """
    timed = lines.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    if dedupe:
        timed = timed.dropDuplicatesWithinWatermark(["capture_id", "line_no"])
    marked = with_severity(timed, ("error", "warn"))
    return (marked.withColumn("template", normalize_log_line(F.col("line")))
            .groupBy(F.window("ts", window).alias("w"), "severity", "template")
            .agg(bigint(F.count(F.lit(1))).alias("n"))
            .select(F.col("w.start").alias("window_start"), "severity", "template", "n"))
