"""Outcomes of test runners: counts per format and distinct failure lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from capsift import rules as R
from capsift.functions.text import bigint, first_chars, groups, number_in, not_blank, trim_ws
from capsift.operators.lines import CHUNK, capped_tally, carry

FORMATS = ("generic", "cargo", "pytest", "go", "vitest", "playwright")


def _last(value: Column, when: Column) -> Column:
    """Value on the last line where ``when`` holds."""
    return F.max_by(value, F.when(when, F.col("line_no")))


def _total(value: Column, when: Column) -> Column:
    return F.coalesce(F.sum(F.when(when, value)), F.lit(0))


def _zero(col: str | Column) -> Column:
    return bigint(F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(0)))


def _counters(lines: DataFrame) -> DataFrame:
    """One row per capture holding what every format needs, in one aggregation."""
    line = F.col("line")
    # Numbers are read once per line, and only next to their word.
    lines = lines.select(
        "capture_id", "line_no", "line",
        F.when(line.contains("passed"), number_in(line, R.PASSED)).alias("p"),
        F.when(line.contains("failed"), number_in(line, R.FAILED)).alias("f"),
        (line.contains("Tests:") & line.rlike(R.JEST_SUMMARY)).alias("jest"),
        F.when(line.contains("test result:"), groups(line, "^.*" + R.CARGO_SUMMARY + ".*$", 3)).alias("cargo"))
    passed, failed, jest, cargo = F.col("p"), F.col("f"), F.col("jest"), F.col("cargo").isNotNull()
    plain = ~jest & ~cargo & passed.isNotNull()
    cargo_passed, cargo_failed = F.get("cargo", F.lit(2)), F.get("cargo", F.lit(3))
    pytest = line.contains(R.PYTEST_RULE) & (passed.isNotNull() | failed.isNotNull())
    go_json = line.contains(R.GO_JSON)
    event = F.from_json(F.when(line.startswith("{"), line), "Action string, Test string")
    action, has_test = event["Action"], F.coalesce(event["Test"], F.lit("")) != ""
    summary = passed.isNotNull() | failed.isNotNull()
    vitest, play = summary & line.rlike(R.VITEST_SUMMARY), summary & line.rlike(R.PLAYWRIGHT_SUMMARY)
    play_tick = line.rlike(R.PLAYWRIGHT_PASS) & line.rlike(R.PLAYWRIGHT_TIMING)
    return lines.groupBy("capture_id").agg(
        F.count_if(jest).alias("jest_n"), F.count_if(cargo).alias("cargo_n"),
        F.max_by(jest, F.when(jest | cargo, F.col("line_no"))).alias("jest_last"),
        _last(passed, jest).alias("jest_passed"), _last(failed, jest).alias("jest_failed"),
        _last(number_in(line, R.JEST_TOTAL), jest).alias("jest_total"),
        _total(cargo_passed.cast("bigint"), cargo).alias("cargo_passed"),
        _total(cargo_failed.cast("bigint"), cargo).alias("cargo_failed"),
        F.min_by(F.struct(passed.alias("p"), failed.alias("f")),
                 F.when(plain, F.col("line_no"))).alias("plain"),
        _last(passed, pytest).alias("pytest_passed"), _last(failed, pytest).alias("pytest_failed"),
        F.coalesce(F.max(go_json), F.lit(False)).alias("go_json"),
        F.count_if((action == "pass") & has_test).alias("goj_passed"),
        F.count_if((action == "fail") & has_test).alias("goj_failed"),
        F.count_if((action == "fail") & ~has_test).alias("goj_packages"),
        F.count_if(line.rlike(R.GO_PASS_TEST) | line.rlike(R.GO_PASS_PACKAGE)).alias("go_passed"),
        F.count_if(line.rlike(R.GO_FAIL_TEST)).alias("go_failed"),
        F.count_if(line.rlike(R.GO_FAIL_PACKAGE)).alias("go_packages"),
        F.count_if(vitest).alias("vitest_n"),
        _last(passed, vitest).alias("vitest_passed"), _last(failed, vitest).alias("vitest_failed"),
        F.count_if(line.rlike(R.VITEST_PASS)).alias("vitest_ticks"),
        F.count_if(line.rlike(R.VITEST_FAIL)).alias("vitest_crosses"),
        F.count_if(play).alias("play_n"),
        _last(passed, passed.isNotNull()).alias("play_passed"),
        _last(failed, failed.isNotNull()).alias("play_failed"),
        F.count_if(play_tick).alias("play_ticks"),
        F.count_if(line.rlike(R.PLAYWRIGHT_FAIL)).alias("play_crosses"))


def test_outcomes(lines: DataFrame, formats: tuple[str, ...] = FORMATS) -> DataFrame:
    """``passed, failed, total, failed_packages`` per capture and format.

    Every counter is read on its own, summaries win over tick lines, failing
    tests and failing packages are counted apart.
    """
    zero = F.lit(0).cast("bigint")

    def row(label: str, passed: Column, failed: Column, total: Column | None = None,
            packages: Column = zero) -> Column:
        passed, failed = _zero(passed), _zero(failed)
        return F.struct(F.lit(label).alias("format"), passed.alias("passed"), failed.alias("failed"),
                        (passed + failed if total is None else _zero(total)).alias("total"),
                        bigint(packages).alias("failed_packages"))

    c = F.col
    jest_last, cargo_seen = F.coalesce(c("jest_last"), F.lit(False)), c("cargo_n") > 0
    vitest_sum, play_sum = c("vitest_n") > 0, c("play_n") > 0
    go = {name: F.when(c("go_json"), c(f"goj_{name}")).otherwise(c(f"go_{name}"))
          for name in ("passed", "failed", "packages")}
    passed = F.when(jest_last, c("jest_passed")).when(cargo_seen, c("cargo_passed")).otherwise(c("plain.p"))
    failed = F.when(jest_last, c("jest_failed")).when(cargo_seen, c("cargo_failed")).otherwise(c("plain.f"))
    rows = {
        "generic": row("generic", passed, failed,
                       F.when(jest_last, c("jest_total")).otherwise(_zero(passed) + _zero(failed))),
        "cargo": row("cargo", c("cargo_passed"), c("cargo_failed")),
        "pytest": row("pytest", c("pytest_passed"), c("pytest_failed")),
        "go": row("go", go["passed"], go["failed"], packages=go["packages"]),
        "vitest": row("vitest", F.when(vitest_sum, c("vitest_passed")).otherwise(c("vitest_ticks")),
                      F.when(vitest_sum, c("vitest_failed")).otherwise(c("vitest_crosses"))),
        "playwright": row("playwright", F.when(play_sum, c("play_passed")).otherwise(c("play_ticks")),
                          F.when(play_sum, c("play_failed")).otherwise(c("play_crosses"))),
    }
    return _counters(lines).select("capture_id", F.inline(F.array(*[rows[f] for f in formats])))


def _failure_text(fmt: str) -> Column:
    """The failure text a line contributes under a format, or null."""
    line, text = F.col("line"), trim_ws(F.col("line"))
    if fmt == "generic":
        return F.when(line.rlike(R.GENERIC_FAILURE) & not_blank(line) & ~line.contains("test result:"), text)
    if fmt == "cargo":
        return F.when(text.rlike(R.CARGO_FAILURE), text)
    if fmt == "pytest":
        in_block = F.coalesce(F.col("pytest_block"), F.lit(False))
        return (F.when(line.rlike("^FAILED "), text)
                .when(in_block & line.rlike(R.PYTEST_ASSERT), first_chars(text, 120)))
    if fmt == "go":
        event = F.from_json(F.when(line.startswith("{"), line), "Action string, Test string")
        return (F.when(line.rlike(R.GO_FAIL_TEST), text)
                .when((event["Action"] == "fail") & (event["Test"] != ""),
                      F.concat(F.lit("FAIL "), event["Test"])))
    if fmt == "vitest":
        return (F.when(line.rlike(R.VITEST_FAIL), text)
                .when(line.rlike(R.VITEST_DETAIL), first_chars(text, 120)))
    after = F.col("play_failure").isNotNull()
    return (F.when(line.rlike(R.PLAYWRIGHT_FAIL), text)
            .when(after & line.rlike(R.PLAYWRIGHT_DETAIL), F.concat(F.lit("  "), first_chars(text, 100))))


def test_failures(lines: DataFrame, formats: tuple[str, ...] = FORMATS, cap: int = R.TEST_CAP,
                  chunk: int | None = CHUNK) -> DataFrame:
    """First 20 distinct failure lines per capture and format."""
    line = F.col("line")
    marks = {}
    if "pytest" in formats:
        marks["pytest_block"] = (F.when(line.rlike(R.PYTEST_BLOCK_OPEN), True)
                                 .when(line.rlike(R.PYTEST_BLOCK_CLOSE), False))
    if "playwright" in formats:
        marks["play_failure"] = F.when(line.rlike(R.PLAYWRIGHT_FAIL), F.col("line_no"))
    rows = carry(lines, marks, chunk) if marks else lines
    entries = F.array(*[F.struct(F.lit(f).alias("format"), _failure_text(f).alias("text")) for f in formats])
    found = (rows.select("capture_id", "line_no", F.inline(entries))
             .where(F.col("text").isNotNull()))
    listed = capped_tally(found, ["capture_id", "format"], cap, "text")
    return listed.select("capture_id", "format", "rank", F.col("text").alias("line"),
                         bigint("line_no").alias("first_line_no"), bigint("total").alias("total"),
                         bigint("n_distinct").alias("n_distinct"))
