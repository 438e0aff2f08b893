"""Errors and warnings of build tools."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from capsift import rules as R
from capsift.functions.text import bigint, trim_ws
from capsift.operators.lines import capped, capped_tally, classed, filled, most, with_caps, within_caps

Caps = Mapping[str, int | None]


def _trimmed(lines: DataFrame) -> DataFrame:
    return filled(lines).select("capture_id", "line_no", trim_ws(F.col("line")).alias("line"))


def _issue_columns(rows: DataFrame) -> DataFrame:
    return rows.select("capture_id", "section", "rank", "line", bigint("line_no").alias("first_line_no"),
                       bigint("total").alias("total"), bigint("n_distinct").alias("n_distinct"))


def build_issues(lines: DataFrame, caps: Caps | None = None) -> DataFrame:
    """Distinct error and warning lines; totals count every such line.

    ``caps`` replaces the default caps by section, ``None`` for all rows.
    """
    caps = with_caps(R.BUILD_CAPS, caps)
    line = F.col("line")
    section = (F.when(line.rlike(R.BUILD_ERROR) & ~line.startswith("0 error"), "error")
               .when(line.rlike(R.BUILD_WARNING) & ~line.startswith("0 warning"), "warning"))
    rows = _trimmed(lines).withColumn("section", section).where(F.col("section").isNotNull())
    listed = capped_tally(rows, ["capture_id", "section"], most(*caps.values()))
    return _issue_columns(within_caps(listed, caps))


def gradle_issues(lines: DataFrame, caps: Caps | None = None, short: int | None = R.GRADLE_WARNING_SHORT) -> DataFrame:
    """Result and time lines, failed tasks, errors and warnings of a Gradle build.

    More warning lines than their cap are cut to the first ``short``; ``None`` stands for all rows.
    """
    caps = with_caps(R.GRADLE_CAPS, caps)
    line = F.col("line")
    rows = classed(_trimmed(lines), [
        F.when(line.rlike(R.GRADLE_RESULT), "result"),
        F.when(line.rlike(R.GRADLE_TIME), "time"),
        F.when(line.rlike(R.GRADLE_FAILED_TASK), "failed_task"),
        F.when(line.rlike(R.GRADLE_ERROR) & ~line.startswith("0 error"), "error"),
        F.when(line.rlike(R.GRADLE_WARNING) & ~line.startswith("0 warning"), "warning")])
    # One combining pass: failed tasks stay rows of their own, of results and times the last one counts.
    kind = F.col("section")
    newest, task = kind.isin("result", "time"), kind == "failed_task"
    counted = rows.groupBy("capture_id", "section", "line", F.when(task, F.col("line_no")).alias("_own")).agg(
        F.count(F.lit(1)).alias("n"), F.min("line_no").alias("_first"), F.max("line_no").alias("_last"))
    counted = counted.withColumn("line_no", F.when(newest, F.col("_last")).otherwise(F.col("_first")))
    order = [F.when(newest, -F.col("line_no")).otherwise(F.col("line_no")), line]
    listed = capped(counted, ["capture_id", "section"], order, most(*caps.values()),
                    {"total": ("sum", F.col("n")), "n_distinct": ("sum", F.lit(1))})
    listed = within_caps(listed, {**caps, "result": 1, "time": 1}).where(
        (kind != "warning") | (F.col("total") <= most(caps["warning"])) | (F.col("rank") <= most(short)))
    return _issue_columns(listed.withColumn("n_distinct", F.when(newest, 1).otherwise(F.col("n_distinct"))))


def next_issues(lines: DataFrame, caps: Caps | None = None) -> DataFrame:
    """Errors and warnings of a Next.js build, plus its success line if any."""
    caps = with_caps(R.NEXT_CAPS, caps)
    line = F.col("line")
    done = line.rlike(R.NEXT_TICK) & line.rlike(R.NEXT_DONE)
    kept = _trimmed(lines).where(~line.rlike(R.NEXT_PROGRESS) & ~line.rlike(R.NEXT_ROUTE))
    rows = classed(kept, [
        F.when(done, "success"),
        F.when(~done & line.rlike(R.NEXT_ERROR), "error"),
        F.when(~done & line.rlike(R.NEXT_WARNING), "warning")])
    listed = capped(rows, ["capture_id", "section"], [F.col("line_no")], most(*caps.values()),
                    {"total": ("sum", F.lit(1))}, limit_first=True)
    listed = within_caps(listed, {**caps, "success": 1})
    return _issue_columns(listed.withColumn("n_distinct", F.col("total")))
