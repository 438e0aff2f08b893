"""Readers of captures that are too large for one cell: texts as pages out of line tables.

FIXED VALUES: the phrases of the texts, as in ``compact``.

The counterpart of ``compact`` and ``cells`` where no task may hold a whole text.  A reader
here gives the text that the reader of the same name gives for a cell; :class:`Paged` says
for which captures it does, by what one combining pass finds in their lines.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from capsift import rules as R
from capsift.functions.text import contains_any, not_blank, number_in, trim_ws
from capsift.operators import builds, compact, cut, diagnostics as diag, gitops, noise, render
from capsift.operators.lines import chunk_of, filled
from capsift.operators.render import LAST, emit


def _any(test: Callable[[Column], Column]) -> Callable[[], Column]:
    """Whether a line of the capture passes ``test``, as an aggregate."""
    return lambda: F.coalesce(F.max(test(F.col("line"))), F.lit(False))


def _none_of(test: Callable[[Column], Column]) -> Callable[[], Column]:
    return lambda: ~_any(test)()


def _both(*parts: Callable[[], Column]) -> Callable[[], Column]:
    def of() -> Column:
        out = F.lit(True)
        for part in parts:
            out = out & part()
        return out
    return of


@dataclass(frozen=True)
class Paged:
    """``page`` gives the page's lines from lines and command.

    A capture for which the aggregate ``takes`` over its lines doesn't hold is left to the cell.  ``heading``
    is a first line, from the command, ``n_filled`` (lines that are not blank) and ``n_items``, the aggregate ``items``.
    ``empty`` is the text without a page.  With ``trimmed`` white space at the text's end goes.
    """

    page: Callable[[DataFrame, Column], DataFrame]
    takes: Callable[[], Column] = lambda: F.lit(True)
    items: Callable[[], Column] | None = None
    heading: Callable[[Column], Column] | None = None
    empty: str = ""
    trimmed: bool = False


# --- version control ------------------------------------------------------------------------


def _status_parts(line: Column) -> tuple[Column, Column]:
    entry = line.rlike(R.STATUS_LINE) & ~line.startswith("##")
    x, y, pair = F.substring(line, 1, 1), F.substring(line, 2, 1), F.substring(line, 1, 2)
    return entry, (pair == "??") | x.isin(*"MADRC") | y.isin(*"MD") | pair.isin(*R.STATUS_CONFLICTS)


def status_page(lines: DataFrame, command: Column) -> DataFrame:
    line, rank, total = F.col("line"), F.col("rank"), F.col("total")
    branches = emit(lines.where(line.startswith("##")), (
        None, F.concat(F.lit("* "), trim_ws(F.substring(line, F.lit(4), F.length(line)))), 0, F.col("line_no")))
    found = gitops.status_summary(lines).where(F.col("section") != "branch")
    parts = []
    for at, (name, fmt) in enumerate((("staged", "+ Staged: %d files"), ("modified", "~ Modified: %d files"), ("untracked", "? Untracked: %d files")), 1):
        mine, cap = F.col("section") == name, R.STATUS_CAPS[name]
        parts += [(mine & (rank == 1), F.format_string(fmt, total), at, 0), (mine, F.concat(F.lit("   "), "file"), at, rank),
                  (mine & (rank == 1) & (total > cap), F.format_string("   ... +%d more", total - cap), at, LAST)]
    conflicts = ((F.col("section") == "conflict") & (rank == 1), F.format_string("conflicts: %d files", total), 4)
    return branches.unionByName(emit(found, *parts, conflicts))


def _hex_first(line: Column) -> Column:
    return (line >= "0") & (line < "g")  # a commit begins with 0-9 or a-f


def _commit_starts(line: Column) -> Column:
    return _hex_first(line) & (line.rlike(R.LOG_COMMIT) | line.rlike(R.LOG_ONELINE))


def history_page(lines: DataFrame, command: Column) -> DataFrame:
    """Of a history only the lines that begin a commit, or can be its subject, are shuffled."""
    line = F.col("line")
    commits = gitops.commit_log_verbose(lines.where(_commit_starts(line) | (line.startswith("    ") & not_blank(line))))
    return emit(commits, (None, F.col("commit"), 0, F.col("line_no")))


def diff_page(lines: DataFrame, command: Column) -> DataFrame:
    """The page of the lines up to the end of the chunk in which the first file begins that no page shows.

    Each ``diff --git`` line is a row of the page, so what lies behind as many of them as are shown, and one
    more, is beyond the page: neither its rows nor the counts of its files.  A file on the page ends before.
    """
    heads = lines.where(F.col("line").startswith("diff --git")).groupBy("capture_id", chunk_of().alias("_chunk")).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("capture_id").orderBy("_chunk"))
    ends = heads.withColumn("upto", upto).where(F.col("upto") > R.DIFF_CAP).groupBy("capture_id").agg(F.min("_chunk").alias("_end"))
    # A row per large capture at most.
    near = lines.join(F.broadcast(ends), "capture_id", "left").where(F.col("_end").isNull() | (chunk_of() <= F.col("_end"))).drop("_end")
    # Dealt out here, so that the steps of the page share what one scan found.
    return render.diff_page(near.repartition("capture_id", chunk_of()), plain=False)


# --- search results, listings, tables, environment ----------------------------------------------


def grep_page(lines: DataFrame, command: Column) -> DataFrame:
    return render.grep_page(lines.withColumn("pattern", F.regexp_extract(F.lower(command), R.SEARCH_PATTERN, 1)))


def _rows_page(row: Callable[[Column], Column], header: bool) -> Callable[[DataFrame, Column], DataFrame]:
    """One compact line per row; ``header`` leaves out the first line that is not blank."""
    def page(lines: DataFrame, command: Column) -> DataFrame:
        rows = filled(lines)
        if header:
            first = rows.groupBy("capture_id").agg(F.min("line_no").alias("_first"))  # a row per large capture
            rows = rows.join(F.broadcast(first), "capture_id").where(F.col("line_no") > F.col("_first"))
        return emit(rows, (None, row(F.col("line")), 0, F.col("line_no")))
    return page


def env_page(lines: DataFrame, command: Column) -> DataFrame:
    return emit(noise.mask_env(lines), (None, F.col("line"), 0, F.col("line_no")))


# --- builds, packages, logs, any text ------------------------------------------------------------


def build_page(lines: DataFrame, command: Column) -> DataFrame:
    rank, total, section = F.col("rank"), F.col("total"), F.col("section")
    at = F.when(section == "error", 1).otherwise(2)
    heading = F.when(section == "error", F.format_string("%d error(s):", total)).otherwise(F.format_string("%d warning(s):", total))
    return emit(builds.build_issues(lines), (rank == 1, heading, at, 0), (None, F.col("line"), at, rank))


def npm_page(lines: DataFrame, command: Column) -> DataFrame:
    rows = noise.drop_npm_noise(lines).where(F.col("section").isin("error", "summary"))
    return emit(rows, (None, F.col("line"), 0, F.col("rank")))


def _is_npm_hit(line: Column) -> Column:
    line = trim_ws(line)
    noisy = (line.rlike(R.NPM_NOISE) & ~line.rlike("(?i)error")) | line.rlike(R.NPM_SPINNER)
    return (line.rlike(R.NPM_SUMMARY) | line.rlike(R.NPM_ERROR)) & ~noisy


def pip_page(lines: DataFrame, command: Column) -> DataFrame:
    rank, total, long = F.col("rank"), F.col("total"), (F.col("section") == "head") & (F.col("rank") == 1)
    return emit(noise.drop_pip_noise(lines), (long, F.format_string("%d packages", total), 0), (None, F.col("line"), 1, rank),
                (long, F.format_string("... +%d more", total - R.PIP_CAP), 2))


def generic_page(lines: DataFrame, command: Column) -> DataFrame:
    rank, section = F.col("rank"), F.col("section")
    at = F.when(section == "tail", 2).otherwise(0)
    note = F.format_string("\n... (%d lines omitted) ...\n", F.col("total") - (R.GENERIC_HEAD + R.GENERIC_TAIL))
    return emit(cut.generic_lines(lines), (None, F.col("line"), at, rank), ((section == "head") & (rank == 1), note, 1))


def _tests(fmt: str) -> Callable[[DataFrame, Column], DataFrame]:
    return lambda lines, command: render.runner_page(lines, fmt)


def _of_tools(page: Callable[[DataFrame], DataFrame], *tools: str) -> Callable[[DataFrame, Column], DataFrame]:
    return lambda lines, command: page(diag.diagnostics(lines, tools))


def _pytest_counts() -> Column:
    """Tests that the last summary counts."""
    line = F.col("line")
    ruled = line.contains(R.PYTEST_RULE)
    p, f = (F.when(ruled & line.contains(word), number_in(line, pattern)) for word, pattern in (("passed", R.PASSED), ("failed", R.FAILED)))
    summary = p.isNotNull() | f.isNotNull()
    zero = F.lit(0).cast("bigint")
    return F.coalesce(F.max_by(F.coalesce(p, zero) + F.coalesce(f, zero), F.when(summary, F.col("line_no"))), zero) > 0


def _opens_json() -> Column:
    """Whether the first character that is no white space is a bracket."""
    line = F.col("line")
    first = F.min_by(F.substring(trim_ws(line), 1, 1), F.when(not_blank(line), F.col("line_no")))
    return F.coalesce(first == "[", F.lit(False))


def _unmarked(line: Column) -> Column:
    return ~line.contains("\x01")  # the mark of ``text.groups``, which takes no line that holds it


def _is_task(line: Column) -> Column:
    return line.rlike("^[A-Za-z0-9_]") & line.contains(" - ")


#: Reader -> its pages.  Captures of other readers stay in cells, whatever their size.
PAGED: dict[str, Paged] = {
    "git-status": Paged(status_page, _any(lambda s: _status_parts(s)[0] & _status_parts(s)[1])),
    "git-log": Paged(history_page, _both(_any(_commit_starts), _none_of(lambda s: s.contains(R.LOG_BLOCK_END)))),
    "git-diff": Paged(diff_page),
    "grep": Paged(grep_page, _any(lambda s: s.contains(":")), trimmed=True),
    "find": Paged(lambda lines, command: render.find_page(filled(lines)),
                  heading=lambda command: F.format_string("%d files found", "n_filled")),
    "ls": Paged(lambda lines, command: render.ls_page(lines), empty="(empty)"),
    "gradle-tasks": Paged(lambda lines, command: render.tasks_page(lines), _any(_is_task), lambda: F.count_if(_is_task(F.col("line"))),
                          lambda command: F.format_string("%d tasks available", "n_items")),
    "tsc": Paged(_of_tools(render.tsc_page, "tsc"), _any(lambda s: s.contains("): ") & s.rlike(R.TSC) & _unmarked(s))),
    "lint": Paged(_of_tools(render.lint_page, "eslint", "biome"), _any(lambda s: (
        (s.rlike(r"^\s+\d") & s.rlike(R.ESLINT)) | (s.contains("━") & s.rlike(R.BIOME))) & _unmarked(s))),
    "ruff": Paged(_of_tools(render.ruff_page, "ruff"), lambda: ~_opens_json(), empty="ruff ok"),
    "build": Paged(build_page, empty="build ok"),
    "cargo": Paged(_tests("cargo"), _any(lambda s: s.contains("test result:") & s.rlike(R.CARGO_SUMMARY)), empty="PASSED: 0 tests"),
    "pytest": Paged(_tests("pytest"), _pytest_counts),
    "go": Paged(_tests("go")),
    "vitest": Paged(_tests("vitest"), _none_of(lambda s: contains_any(F.lower(s), "no test files found", "no tests found"))),
    "npm": Paged(npm_page, _any(_is_npm_hit)),
    "pip": Paged(pip_page),
    "logs": Paged(lambda lines, command: render.log_page(lines), empty=render.QUIET_LOG),
    "docker": Paged(_rows_page(compact._container, True),
                    heading=lambda command: F.format_string("%d container(s)", F.col("n_filled") - 1)),
    "kubectl": Paged(_rows_page(compact._resource, True),
                     heading=lambda command: F.format_string("%d resource(s)", F.col("n_filled") - 1)),
    "gh": Paged(_rows_page(compact._item, False),
                heading=lambda command: F.format_string("%d item(s) [%s]:", "n_filled", compact._gh_listed(command))),
    "env": Paged(env_page, empty="(no matching vars)"),
    "generic": Paged(generic_page),
}


def paged_as(reader: Column, command: Column) -> Column:
    """The name under which :data:`PAGED` holds the pages of a command's reader; null where it has none."""
    logs = ((reader == "docker") & command.rlike(R.LOGS_OF % "docker")) | ((reader == "kubectl") & command.rlike(R.LOGS_OF % "kubectl"))
    images = (reader == "docker") & command.rlike(r"^\s*docker\s+images")
    return F.when(logs, "logs").when(~images & reader.isin(*PAGED), reader)
