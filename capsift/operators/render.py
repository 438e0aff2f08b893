"""Compact text for formats that group lines, from the operators' tables.

FIXED VALUES: the phrases of the texts, as in ``compact``.

A *page* is ``capture_id, o1, o2, o3, text``: lines of output with their order.
Pages come from capped tables, so they are small next to the input.  Tokens of
a page are summed without building its text (:func:`page_tokens`);
:func:`page_text` assembles the text where it is wanted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from capsift import rules as R
from capsift.functions.text import bigint, not_blank, tokens_of_length, trim_ws
from capsift.operators import diagnostics as diag
from capsift.operators import gitops, listing, logs, matches, testruns
from capsift.operators.cut import generic_text
from capsift.operators.lines import CHUNK, explode_lines

LAST = 1 << 62  # sorts after every line number


def emit(rows: DataFrame, *parts: tuple) -> DataFrame:
    """Page lines from ``rows`` in one pass.

    Each part is ``(condition or None, text, o1, o2, o3)``; a row gives one line
    per part whose condition holds.
    """
    def order(value: Column | int) -> Column:
        return bigint(value if isinstance(value, Column) else F.lit(value))

    structs = []
    for when, text, *at in parts:
        o1, o2, o3 = (*at, 0, 0, 0)[:3]
        entry = F.struct(order(o1).alias("o1"), order(o2).alias("o2"), order(o3).alias("o3"), text.alias("text"))
        structs.append(entry if when is None else F.when(when, entry))
    return rows.select("capture_id", F.inline(F.array_compact(F.array(*structs))))


def sized_pages(lines: DataFrame) -> DataFrame:
    """``capture_id, filtered, chars``: a capture's page joined into one text, and its length.

    Runs of ``CHUNK`` in the order are joined first, so no task sorts the lines of a
    large page; what meets per capture is the page's text in a few pieces.  A line
    without text leaves no trace, and a page of such lines is empty.  ``chars`` is summed
    beside the text: where only it is used, no text is put together.
    """
    run = ["capture_id", "o1", F.floor(F.col("o2") / CHUNK).alias("run")]

    def joined(rows: DataFrame, keys: list, *order: str) -> DataFrame:
        listed = rows.groupBy(*keys).agg(F.count("chars").alias("n"), F.sum("chars").alias("_chars"),
                                         F.array_sort(F.collect_list(F.struct(*order, "text"))).alias("rows"))
        text = F.when(F.col("n") > 0, F.array_join(F.transform("rows", lambda r: r["text"]), "\n"))
        chars = F.when(F.col("n") > 0, F.col("_chars") + F.col("n") - 1)
        return listed.withColumns({"text": text, "chars": chars}).drop("rows", "n", "_chars")

    lines = lines.withColumn("chars", bigint(F.length("text")))
    pages = joined(joined(lines, run, "o2", "o3"), ["capture_id"], "o1", "run")
    return pages.select("capture_id", F.coalesce("text", F.lit("")).alias("filtered"), F.coalesce("chars", F.lit(0).cast("bigint")).alias("chars"))


def page_text(lines: DataFrame) -> DataFrame:
    """``capture_id, filtered`` of :func:`sized_pages`."""
    return sized_pages(lines).select("capture_id", "filtered")


def page_tokens(lines: DataFrame) -> DataFrame:
    """Token estimate of each page, by aggregation only."""
    size = F.sum(F.length("text")) + F.count(F.lit(1)) - 1
    return lines.groupBy("capture_id").agg(tokens_of_length(size).alias("filtered_tokens"))


def with_default(captures: DataFrame, text: DataFrame, default: Column, heading: Column | None = None) -> DataFrame:
    """``text`` for every capture, ``default`` where it has none.

    ``heading`` is a first line computed from the capture itself.  Other columns
    of ``captures`` stay, its ``raw`` text does not.
    """
    kept = [c for c in captures.columns if c not in ("raw", "command")]
    base = captures.select(*kept, default.alias("_default"),
                           (F.lit(None).cast("string") if heading is None else heading).alias("_heading"))
    body = F.col("filtered") if heading is None else F.concat("_heading", F.lit("\n"), "filtered")
    return base.join(text, "capture_id", "left").select(
        *kept, F.coalesce(body, F.col("_default")).alias("filtered"))


def _n(fmt: str, *cols: str) -> Column:
    return F.format_string(fmt, *[F.col(c) for c in cols])


# --- logs ----------------------------------------------------------------------------

QUIET_LOG = "Log Summary\n  [error] 0 errors (0 unique)\n  [warn] 0 warnings (0 unique)\n  [info] 0 info messages\n"


def log_page(lines: DataFrame) -> DataFrame:
    """Totals and top templates, in one pass; captures with nothing to count are left out."""
    found = logs.log_templates(lines, {**R.LOG_TOP, "info": 1})
    severity, rank, cap = F.col("severity"), F.col("rank"), F.lit(0)
    for name, k in R.LOG_TOP.items():
        cap = F.when(severity == name, k).otherwise(cap)
    # A capture has at most 16 rows left, so its totals are a small window.
    whole = Window.partitionBy("capture_id")
    totals = {f"{name}_{col}": F.coalesce(F.max(F.when(severity == name, F.col(col))).over(whole), F.lit(0))
              for name in ("error", "warn", "info") for col in ("total", "n_unique")}
    found = found.withColumns({**totals, "lead": F.min("severity").over(whole)})
    listed, begins = severity != "info", (rank == 1) & (severity != "info")
    leads = (rank == 1) & (severity == F.col("lead"))
    section = F.when(severity == "error", 1).otherwise(2)
    shown = F.when(F.col("n") > 1, F.format_string("  [x%d] %s", "n", "exemplar")).otherwise(
        F.concat(F.lit("  "), "exemplar"))
    word = F.when(severity == "error", "errors").otherwise("warnings")
    return emit(
        found, (leads, F.lit("Log Summary"), 0, 0),
        (leads, _n("  [error] %d errors (%d unique)", "error_total", "error_n_unique"), 0, 1),
        (leads, _n("  [warn] %d warnings (%d unique)", "warn_total", "warn_n_unique"), 0, 2),
        (leads, _n("  [info] %d info messages", "info_total"), 0, 3), (leads, F.lit(""), 0, 4),
        (begins, F.when(severity == "error", "[ERRORS]").otherwise("[WARNINGS]"), section, 0),
        (listed, shown, section, rank),
        (begins & (F.col("n_unique") > cap),
         F.format_string("  ... +%d more unique %s", F.col("n_unique") - cap, word), section, LAST),
        (begins & (severity == "error"), F.lit(""), section, LAST, 1))


def log_text(captures: DataFrame) -> DataFrame:
    return with_default(captures, page_text(log_page(explode_lines(captures))), F.lit(QUIET_LOG))


# --- search results, paths, listings, tasks ---------------------------------------------


def grep_page(lines: DataFrame, pattern: str | None = None) -> DataFrame:
    found = matches.matches_by_file(lines, pattern)
    # At most 50 rows per capture are left: where files end and the count shown.
    whole, file = Window.partitionBy("capture_id"), Window.partitionBy("capture_id", "file")
    found = found.withColumns({"shown": F.count(F.lit(1)).over(whole), "last": F.max("rank").over(file)})
    rank, first, ends = F.col("rank"), F.col("file_rank") == 1, F.col("rank") == F.col("last")
    digits = F.col("row").cast("string")
    number = F.when(F.col("row") > 0, F.concat(
        F.repeat(F.lit(" "), F.greatest(F.lit(0), 4 - F.length(digits))), digits)).otherwise("   ?")
    rest = F.col("total") - F.col("shown")
    return emit(
        found, (rank == 1, _n("%d matches in %dF:\n", "total", "n_files"), -1),
        (first, _n("[file] %s (%d):", "file_display", "n_in_file"), rank, 0),
        (None, F.concat(F.lit("  "), number, F.lit(": "), "content"), rank, 1),
        (ends & (F.col("n_in_file") > R.GREP_PER_FILE),
         F.format_string("  +%d", F.col("n_in_file") - R.GREP_PER_FILE), rank, 2),
        (ends, F.lit(""), rank, 3), ((rank == 1) & (rest > 0), F.format_string("... +%d", rest), LAST))


def grep_text(captures: DataFrame) -> DataFrame:
    """Long matches are cut around the pattern that the command searched for."""
    wanted = captures.withColumn("pattern", F.regexp_extract(F.lower("command"), R.SEARCH_PATTERN, 1))
    text = page_text(grep_page(explode_lines(wanted, keep=("pattern",)))).withColumn(
        "filtered", F.regexp_replace("filtered", r"\s+$", ""))
    kept = F.filter(F.split("raw", "\n", -1), not_blank)
    default = F.when(F.size(kept) == 0, "(no matches)").otherwise(F.array_join(F.slice(kept, 1, 20), "\n"))
    return with_default(captures, text, default)


def find_page(lines: DataFrame) -> DataFrame:
    """One line per directory; a directory's names are at most five."""
    found = matches.dir_groups(matches.split_path(lines))
    dirs = found.groupBy("capture_id", "dir", "first_line_no", "n").agg(
        F.array_sort(F.collect_list(F.struct("rank", "name"))).alias("names"))
    names = F.array_join(F.transform("names", lambda r: r["name"]), ", ")
    more = F.when(F.col("n") > R.FIND_ALL, F.format_string(" ... +%d more", F.col("n") - R.FIND_HEAD)).otherwise("")
    return emit(dirs, (None, F.concat(_n("%s/ (%d): ", "dir", "n"), names, more), F.col("first_line_no")))


def find_text(captures: DataFrame) -> DataFrame:
    """Up to 30 paths as they are (narrow), more of them by directory."""
    kept = F.filter(F.split("raw", "\n", -1), not_blank)
    n, rows = F.size("_kept"), captures.withColumn("_kept", kept)
    short = F.when(n == 0, "(no results)").when(n <= R.FIND_PASS, F.array_join("_kept", "\n"))
    text = page_text(find_page(explode_lines(captures.where(F.size(kept) > R.FIND_PASS))))
    return with_default(rows, text, short, F.format_string("%d files found", n)).drop("_kept")


def ls_page(lines: DataFrame, show_all: bool = False) -> DataFrame:
    """Every entry, and below them a summary from the same parsed rows."""
    entries = listing.listing_entries(lines, show_all)
    exts = listing.listing_summary(entries).groupBy("capture_id", "n_files", "n_dirs", "n_ext").agg(
        F.array_sort(F.collect_list(F.when(F.col("ext") != "(dirs)", F.struct(
            "rank", F.format_string("%d %s", "n", "ext").alias("t"))))).alias("exts"))  # at most five
    parts = F.array_join(F.transform("exts", lambda r: r["t"]), ", ")
    more = F.when(F.col("n_ext") > R.EXT_CAP, F.format_string(", +%d more", F.col("n_ext") - R.EXT_CAP)).otherwise("")
    tail = F.concat(_n("\n%d files, %d dirs", "n_files", "n_dirs"), F.when(
        F.col("n_ext") > 0, F.concat(F.lit(" ("), parts, more, F.lit(")"))).otherwise(""))
    listed = emit(entries, (F.col("is_dir"), F.concat("name", F.lit("/")), 0, F.col("line_no")),
                  (~F.col("is_dir"), F.concat_ws(" ", "name", "size_text"), 1, F.col("line_no")))
    return listed.unionByName(emit(exts, (None, tail, 2)))


def ls_text(captures: DataFrame) -> DataFrame:
    return with_default(captures, page_text(ls_page(explode_lines(captures))), F.lit("(empty)"))


def tasks_page(lines: DataFrame, chunk: int | None = CHUNK) -> DataFrame:
    found = listing.tasks_by_group(lines, chunk=chunk)
    at, first, total = F.col("first_line_no"), F.col("rank") == 1, F.col("total")
    return emit(found, (first, _n("%s (%d):", "task_group", "total"), at, 0),
                (None, F.concat(F.lit("  "), "task"), at, F.col("rank")),
                (first & (total > R.TASK_CAP), F.format_string("  ... +%d more", total - R.TASK_CAP), at, LAST))


def tasks_text(captures: DataFrame) -> DataFrame:
    tasks = F.filter(F.split("raw", "\n", -1), lambda s: s.rlike("^[A-Za-z0-9_]") & s.contains(" - "))
    text = page_text(tasks_page(explode_lines(captures), chunk=None))
    return with_default(captures, text, generic_text(F.col("raw")),
                        F.format_string("%d tasks available", F.size(tasks)))


# --- version control ------------------------------------------------------------------------


def diff_page(lines: DataFrame, plain: bool = True, chunk: int | None = CHUNK) -> DataFrame:
    shown = gitops.diff_condense(lines, plain, chunk=chunk)
    hunk, whole = Window.partitionBy("capture_id", "hunk_at"), Window.partitionBy("capture_id")
    # At most 200 rows per capture are left.
    shown = shown.withColumns({
        "hunk_end": F.max("line_no").over(hunk), "any_cut": F.max("truncated").over(whole),
        "files": F.sum(F.when(F.col("kind") == "file", 1).otherwise(0)).over(whole)})
    kind, at = F.col("kind"), F.col("file_at")
    text = (F.when(kind == "file", F.concat(F.lit("\n"), "line"))
            .when(kind == "hunk", F.concat(F.lit("  @@ "), "line", F.lit(" @@")))
            .otherwise(F.concat(F.lit("  "), "line")))
    over = F.col("n_rows") > R.DIFF_CAP
    first = F.col("rank") == 1
    body = emit(
        shown, (None, text, at, F.col("line_no"), 0),
        (F.col("truncated") & (F.col("line_no") == F.col("hunk_end")), F.lit("  ... (truncated)"), at, F.col("line_no"), 1),
        (first & over, F.lit("\n... (more changes truncated)"), LAST, 0),
        (first & (over | F.col("any_cut")), F.lit("[full diff available — use git diff directly]"), LAST, 1))
    stats = gitops.diff_stat(lines, plain, chunk=chunk).where(F.col("added") + F.col("removed") > 0)
    heads = shown.where(kind == "file").select("capture_id", "file_at")
    return body.unionByName(emit(stats.join(heads, ["capture_id", "file_at"], "left_semi"),
                                 (None, F.format_string("  +%d -%d", "added", "removed"), at, LAST)))


def diff_text(captures: DataFrame, plain: bool = True) -> DataFrame:
    return with_default(captures, page_text(diff_page(explode_lines(captures), plain, chunk=None)), F.lit(""))


def git_diff_text(captures: DataFrame) -> DataFrame:
    return diff_text(captures, plain=False)


def history_text(captures: DataFrame) -> DataFrame:
    """Histories without an end-of-commit marker, one line per commit."""
    commits = gitops.commit_log_verbose(explode_lines(captures), chunk=None)
    text = page_text(emit(commits, (None, F.col("commit"), F.col("line_no"))))
    return with_default(captures, text, trim_ws(F.col("raw")))


# --- diagnostics ------------------------------------------------------------------------------


def _file_page(found: DataFrame, tool: str, heading: str, item: Column, cap: int) -> DataFrame:
    rows = diag.diag_by_file(found, tool, cap)
    whole, first = Window.partitionBy("capture_id"), F.col("rank") == 1

    def total(value: Column) -> Column:
        return F.sum(F.when(first, value).otherwise(0)).over(whole)

    rows = rows.withColumns({"errors": total(F.col("n_errors")), "issues": total(F.col("n_in_file")),
                             "files": total(F.lit(1)), "lead": F.min(F.struct("first_line_no", "first_pos")).over(whole)})
    at, tie = F.col("first_line_no"), F.col("first_pos")
    leads = first & (F.col("lead") == F.struct("first_line_no", "first_pos"))
    return emit(rows, (leads, _n(heading, "errors" if tool == "tsc" else "issues", "files"), -1),
                (first, F.col("file"), at, tie, 0), (None, item, at, tie, F.col("rank")),
                (first & (F.col("n_in_file") > cap),
                 F.format_string("  ... +%d more", F.col("n_in_file") - cap), at, tie, LAST))


def tsc_page(found: DataFrame) -> DataFrame:
    level = F.when(F.col("severity") == "error", "E").otherwise("W")
    item = F.format_string("  %s %d:%d %s: %s", level, F.col("row"), F.col("col"), F.col("rule"), F.col("message"))
    return _file_page(found, "tsc", "%d TypeScript error(s) in %d file(s):", item, R.PER_FILE_CAP)


def tsc_text(captures: DataFrame) -> DataFrame:
    text = page_text(tsc_page(diag.diagnostics(explode_lines(captures))))
    default = F.when(F.col("raw").contains("error TS"), generic_text(F.col("raw"))).otherwise("tsc ok")
    return with_default(captures, text, default)


def ruff_page(found: DataFrame) -> DataFrame:
    place = F.when(F.col("row").isNull(), "?").otherwise(F.format_string("%d:%d", "row", "col"))
    item = F.concat(F.lit("  "), place, F.lit(" "), "rule", F.lit(" "), "message")
    return _file_page(found, "ruff", "%d issue(s) in %d file(s):", item, R.PER_FILE_CAP)


def ruff_text(captures: DataFrame) -> DataFrame:
    is_json = F.col("raw").rlike(r"^\s*\[")
    from_json = diag.json_diagnostics(captures.where(is_json).withColumn("line_no", F.lit(0).cast("bigint")))
    from_text = diag.diagnostics(explode_lines(captures.where(~is_json))).withColumn("pos", F.lit(0).cast("bigint"))
    text = page_text(ruff_page(from_json.unionByName(from_text)))
    return with_default(captures, text, F.lit("ruff ok"))


def lint_page(found: DataFrame) -> DataFrame:
    """Both counts head the page: errors alone would hide listed warnings."""
    rows = diag.diag_by_rule(found)
    whole, first = Window.partitionBy("capture_id"), F.col("rank") == 1

    def total(level: str | None) -> Column:
        hit = first if level is None else first & (F.col("severity") == level)
        return F.sum(F.when(hit, F.lit(1) if level is None else F.col("total")).otherwise(0)).over(whole)

    key = F.when(F.col("rule") == "lint", "lint").otherwise(F.concat_ws(" ", "severity", "rule"))
    order = F.struct("first_line_no", "severity", "rule")
    rows = rows.withColumns({"e": total("error"), "w": total("warning"), "rules": total(None),
                             "lead": F.min(order).over(whole)})
    at, tie = F.col("first_line_no"), F.pmod(F.xxhash64("severity", "rule"), F.lit(1 << 40))
    return emit(
        rows, (first & (F.col("lead") == order), _n("%d error(s), %d warning(s) across %d rule(s):", "e", "w", "rules"), -1),
        (first, F.concat(F.lit("  "), key, F.format_string(" (%d):", "n_distinct")), at, tie, 0),
        (None, F.concat(F.lit("    "), "message"), at, tie, F.col("rank")),
        (first & (F.col("n_distinct") > R.PER_RULE_CAP),
         F.format_string("    ... +%d more", F.col("n_distinct") - R.PER_RULE_CAP), at, tie, LAST))


def lint_text(captures: DataFrame) -> DataFrame:
    text = page_text(lint_page(diag.diagnostics(explode_lines(captures))))
    low = F.lower("raw")
    default = F.when(low.contains("problem") | low.contains("error"), generic_text(F.col("raw"))).otherwise("lint ok")
    return with_default(captures, text, default)


def golangci_text(captures: DataFrame) -> DataFrame:
    """JSON reports by linter; plain text falls back to the build summary."""
    from capsift.operators.compact import build

    issues = F.from_json(F.when(F.col("raw").rlike(r"^\s*\{"), F.col("raw")), R.GOLANGCI_SCHEMA)["Issues"]
    reports = captures.where(issues.isNotNull())
    rows = diag.diag_by_linter(diag.json_diagnostics(reports.withColumn("line_no", F.lit(0).cast("bigint"))))
    whole, first = Window.partitionBy("capture_id"), F.col("rank") == 1
    rows = rows.withColumns({"all": F.sum(F.when(first, F.col("total")).otherwise(0)).over(whole),
                             "linters": F.sum(F.when(first, 1).otherwise(0)).over(whole)})
    at, total = F.col("first_pos"), F.col("total")
    text = page_text(emit(
        rows, (first & (at == 0), _n("%d issue(s) across %d linter(s):", "all", "linters"), -1),
        (first, _n("%s (%d):", "linter", "total"), at, 0), (None, _n("  %s: %s", "place", "message"), at, F.col("rank")),
        (first & (total > R.PER_LINTER_CAP), F.format_string("  ... +%d more", total - R.PER_LINTER_CAP), at, LAST)))
    done = with_default(reports, text, F.lit("golangci-lint ok"))
    plain = captures.where(issues.isNull()).withColumn("filtered", build(F.col("raw"), F.col("command")))
    return done.unionByName(plain.select(*done.columns))


# --- test runners ------------------------------------------------------------------------------


def runner_page(lines: DataFrame, fmt: str, chunk: int | None = CHUNK) -> DataFrame:
    """Passed total, or failures under their count."""
    failed = F.col("failed") + F.col("failed_packages") if fmt == "go" else F.col("failed")
    counts = testruns.test_outcomes(lines, (fmt,)).withColumn("bad", failed)
    if fmt == "pytest":  # the lines that open or close a block or can be a failure
        lines = lines.where(F.col("line").rlike("|".join((R.PYTEST_BLOCK_OPEN, R.PYTEST_BLOCK_CLOSE, "^FAILED ", R.PYTEST_ASSERT))))
    failures = testruns.test_failures(lines, (fmt,), chunk=chunk).select("capture_id", "rank", "line")
    # Counts give one row per capture, failures at most twenty.
    rows = counts.join(failures, "capture_id", "left")
    first, bad = F.coalesce("rank", F.lit(1)) == 1, F.col("bad") > 0
    head = (F.format_string("FAILED: %d tests", F.when(F.col("failed") > 0, F.col("failed")).otherwise(F.col("bad")))
            if fmt == "go" else F.format_string("FAILED: %d/%d tests", "failed", "total"))
    # cargo and pytest need a summary line before they can say "passed".
    says_passed = ~bad & (F.col("total") > 0) if fmt in ("cargo", "pytest") else ~bad
    return emit(
        rows, (first & bad, head, 0), (first & says_passed, F.format_string("PASSED: %d tests", "passed"), 0),
        (bad & F.col("rank").isNotNull(), F.col("line"), 1, F.col("rank")))


def runner_text(fmt: str):
    """Text of one test runner."""
    def text(captures: DataFrame) -> DataFrame:
        from capsift.operators.compact import build

        found = page_text(runner_page(explode_lines(captures), fmt, chunk=None))
        if fmt == "vitest":
            none = F.col("raw").rlike("(?i)No test files found|no tests found")
            rest = with_default(captures.where(~none), found, generic_text(F.col("raw")))
            empty = captures.where(none).withColumn("filtered", F.lit("no test files found"))
            return rest.unionByName(empty.select(*rest.columns))
        if fmt == "cargo":  # no test summary: build or clippy output
            ran = F.col("raw").rlike(R.CARGO_SUMMARY)
            # Doc tests often run none; a summary without a count is still a pass.
            done = with_default(captures.where(ran), found, F.lit("PASSED: 0 tests"))
            built = captures.where(~ran).withColumn("filtered", build(F.col("raw"), F.col("command")))
            return done.unionByName(built.select(*done.columns))
        return with_default(captures, found, generic_text(F.col("raw")))
    return text
