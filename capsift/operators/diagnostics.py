"""Linter and compiler diagnostics as typed rows, and their groupings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from capsift import rules as R
from capsift.functions.text import bigint, groups, trim_ws
from capsift.operators.lines import capped, capped_tally


#: tool -> (pattern, groups, cheap test that must hold first, where each field comes from);
#: integers name groups, strings are constants.
_FORMATS = {
    "tsc": (R.TSC, 6, lambda s: s.contains("): "), {"file": 1, "row": 2, "col": 3, "severity": 4, "rule": 5, "message": 6}),
    "eslint": (R.ESLINT, 5, lambda s: s.rlike(r"^\s+\d"), {"row": 1, "col": 2, "severity": 3, "message": 4, "rule": 5}),
    "biome": (R.BIOME, 4, lambda s: s.contains("━"), {"file": 1, "row": 2, "col": 3, "severity": "error", "rule": "lint", "message": 4}),
    "ruff": (R.RUFF, 5, lambda s: s.rlike(r":\d+: [A-Z]\d"), {"file": 1, "row": 2, "col": 3, "severity": "error", "rule": 4, "message": 5}),
}


def _diagnostic(tool: str, fields: dict) -> Column:
    parts = F.col(f"_{tool}")

    def value(name: str) -> Column:
        source = fields.get(name)
        return F.get(parts, F.lit(source)) if isinstance(source, int) else F.lit(source).cast("string")

    return F.when(parts.isNotNull(), F.struct(
        F.lit(tool).alias("tool"), value("severity").alias("severity"), trim_ws(value("file")).alias("file"),
        value("row").cast("bigint").alias("row"), value("col").cast("bigint").alias("col"),
        value("rule").alias("rule"), trim_ws(value("message")).alias("message")))


def diagnostics(lines: DataFrame, tools: tuple[str, ...] = tuple(_FORMATS)) -> DataFrame:
    """One row per recognised diagnostic line; narrow, no shuffle.

    Each pattern runs at most once per line, behind a cheap test.  ``tools`` are the formats looked for.
    """
    line = F.col("line")
    formats = {tool: _FORMATS[tool] for tool in tools}
    rows = lines.select("capture_id", "line_no", *[
        F.when(hint(line), groups(line, pattern, n)).alias(f"_{tool}")
        for tool, (pattern, n, hint, _) in formats.items()])
    found = F.coalesce(*[_diagnostic(tool, fields) for tool, (_, _, _, fields) in formats.items()])
    return rows.select("capture_id", "line_no", F.inline(F.array_compact(F.array(found))))


def json_diagnostics(captures: DataFrame) -> DataFrame:
    """Issues out of ruff and golangci JSON reports in ``raw``; narrow."""
    raw = F.col("raw")
    ruff = F.transform(
        F.from_json(F.when(raw.rlike(r"^\s*\["), raw), R.RUFF_SCHEMA),
        lambda r: F.struct(F.lit("ruff").alias("tool"), F.lit("error").alias("severity"),
                           r["filename"].alias("file"), r["location"]["row"].alias("row"),
                           r["location"]["column"].alias("col"), r["code"].alias("rule"),
                           r["message"].alias("message")))
    golangci = F.transform(
        F.from_json(F.when(raw.rlike(r"^\s*\{"), raw), R.GOLANGCI_SCHEMA)["Issues"],
        lambda r: F.struct(F.lit("golangci").alias("tool"), F.lit("error").alias("severity"),
                           r["Pos"]["Filename"].alias("file"), r["Pos"]["Line"].alias("row"),
                           F.lit(None).cast("bigint").alias("col"), r["FromLinter"].alias("rule"),
                           r["Text"].alias("message")))
    issues = captures.select("capture_id", "line_no", F.posexplode(F.coalesce(ruff, golangci)).alias("pos", "d"))
    return issues.select("capture_id", "line_no", bigint("pos").alias("pos"), "d.*")


def diag_by_file(found: DataFrame, tool: str, cap: int = R.PER_FILE_CAP) -> DataFrame:
    """First ten diagnostics per file; totals count errors and warnings apart."""
    if "pos" not in found.columns:
        found = found.withColumn("pos", F.lit(0).cast("bigint"))
    listed = capped(found.where(F.col("tool") == tool), ["capture_id", "file"],
                    [F.col("line_no"), F.col("pos")], cap,
                    {"n_in_file": ("sum", F.lit(1)), "first_line_no": ("min", F.col("line_no")),
                     "first_pos": ("min", F.col("pos")),
                     "n_errors": ("sum", F.when(F.col("severity") == "error", 1).otherwise(0))}, limit_first=True)
    return listed.select("capture_id", "file", bigint("first_line_no").alias("first_line_no"),
                         bigint("first_pos").alias("first_pos"), "rank", "severity", "row", "col", "rule", "message",
                         bigint("n_in_file").alias("n_in_file"), bigint("n_errors").alias("n_errors"))


def diag_by_rule(found: DataFrame, cap: int = R.PER_RULE_CAP) -> DataFrame:
    """First five distinct messages per level and rule (eslint, biome)."""
    rows = found.where(F.col("tool").isin("eslint", "biome"))
    listed = capped_tally(rows, ["capture_id", "severity", "rule"], cap, "message")
    # "n" repeats of this message; "first_line_no" places the whole rule.
    return listed.select("capture_id", "severity", "rule", "rank", "message", bigint("n").alias("n"),
                         bigint("first_line_no").alias("first_line_no"),
                         bigint("total").alias("total"), bigint("n_distinct").alias("n_distinct"))


def diag_by_linter(found: DataFrame, cap: int = R.PER_LINTER_CAP) -> DataFrame:
    """First five issues per linter (golangci)."""
    listed = capped(found.where(F.col("tool") == "golangci"), ["capture_id", "rule"],
                    [F.col("line_no"), F.col("pos")], cap,
                    {"total": ("sum", F.lit(1)), "first_line_no": ("min", F.col("line_no")),
                     "first_pos": ("min", F.col("pos"))}, limit_first=True)
    place = F.when(F.col("file").isNotNull(), F.concat("file", F.lit(":"), F.col("row").cast("string")))
    return listed.select("capture_id", F.col("rule").alias("linter"), "rank",
                         F.coalesce(place, F.lit("?")).alias("place"), "message",
                         bigint("total").alias("total"), bigint("first_line_no").alias("first_line_no"),
                         bigint("first_pos").alias("first_pos"))


def diagnostic_totals(found: DataFrame) -> DataFrame:
    """Errors, warnings and files per capture and tool."""
    per_file = found.groupBy("capture_id", "tool", "file").agg(
        F.count_if(F.col("severity") == "error").alias("e"),
        F.count_if(F.col("severity") == "warning").alias("w"))
    return per_file.groupBy("capture_id", "tool").agg(
        bigint(F.sum("e")).alias("errors"), bigint(F.sum("w")).alias("warnings"),
        bigint(F.count("file")).alias("files"))
