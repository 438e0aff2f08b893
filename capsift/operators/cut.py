"""Head, tail, summary and de-duplicating cuts.

The ``*_text`` operators work on one ``raw`` cell with array functions: a
narrow transformation, no shuffle, whatever the number of captures.
:func:`generic_lines` gives the generic cut for a line table instead, where one
capture may be far larger than a cell.
"""

from __future__ import annotations

from collections.abc import Mapping
import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from capsift import rules as R
from capsift.functions.text import bigint, not_blank, token_estimate, trim_ws
from capsift.operators.lines import capped, most, sections_of, whole_groups


def _split(raw: Column) -> Column:
    return F.split(raw, "\n", -1)


def _join(*parts: Column) -> Column:
    return F.array_join(F.concat(*parts), "\n")


def _tail(lines: Column, k: int) -> Column:
    """Last ``k`` items, all of them when there are fewer."""
    return F.when(F.size(lines) <= k, lines).otherwise(F.slice(lines, -k, k))


def _note(fmt: str, n: Column) -> Column:
    return F.array(F.format_string(fmt, n))


def generic_text(raw: Column) -> Column:
    """Distinct non-blank lines, first 20 and last 10 when there are many."""
    unique = F.array_distinct(F.filter(_split(raw), not_blank))
    n = F.size(unique)
    cut = _join(F.slice(unique, 1, R.GENERIC_HEAD),
                _note("\n... (%d lines omitted) ...\n", n - (R.GENERIC_HEAD + R.GENERIC_TAIL)),
                _tail(unique, R.GENERIC_TAIL))
    short = F.size(_split(raw)) <= R.GENERIC_PASS
    return (F.when(short, trim_ws(raw))
            .when(n <= R.GENERIC_PASS, F.array_join(unique, "\n")).otherwise(cut))


def summary_text(raw: Column) -> Column:
    """First three and last three non-blank lines."""
    lines = F.filter(_split(raw), not_blank)
    n = F.size(lines)
    cut = _join(F.slice(lines, 1, R.SUMMARY_EDGE),
                _note("... (%d lines omitted) ...", n - 2 * R.SUMMARY_EDGE),
                _tail(lines, R.SUMMARY_EDGE))
    return F.when(n <= 2 * R.SUMMARY_EDGE, F.array_join(lines, "\n")).otherwise(cut)


def read_full_text(raw: Column, label: Column) -> Column:
    """The whole text up to 200 lines, else first 80 and last 40."""
    lines = _split(raw)
    n = F.size(lines)
    cut = _join(F.array(F.format_string("%s (%d lines):", label, n)),
                F.slice(lines, 1, R.READ_HEAD),
                _note("\n... (%d lines omitted) ...\n", n - (R.READ_HEAD + R.READ_TAIL)),
                _tail(lines, R.READ_TAIL))
    return F.when(n > R.READ_PASS, cut).otherwise(raw)


def read_head_text(raw: Column, k: int = R.HEAD_MODE_LINES) -> Column:
    lines = _split(raw)
    n = F.size(lines)
    head = F.array_join(F.slice(lines, 1, k), "\n")
    return F.when(n > k, F.concat(head, F.format_string("\n... (%d more lines)", n - k))).otherwise(head)


def head_text(raw: Column, k: int = R.SIMPLE_HEAD) -> Column:
    return F.array_join(F.slice(_split(trim_ws(raw)), 1, k), "\n")


def tail_text(raw: Column, k: int = R.INSTALL_TAIL) -> Column:
    return F.array_join(_tail(_split(trim_ws(raw)), k), "\n")


def _report(captures: DataFrame, text: Column) -> DataFrame:
    return captures.select(
        "capture_id", bigint(F.size(_split(F.col("raw")))).alias("n_lines"),
        text.alias("filtered"), token_estimate(F.col("raw")).alias("raw_tokens"),
    ).withColumn("filtered_tokens", token_estimate(F.col("filtered")))


def compress_generic(captures: DataFrame) -> DataFrame:
    return _report(captures, generic_text(F.col("raw")))


def summary_6(captures: DataFrame) -> DataFrame:
    return _report(captures, summary_text(F.col("raw")))


def read_full(captures: DataFrame, label: Column | None = None) -> DataFrame:
    label = F.col("capture_id").cast("string") if label is None else label
    return _report(captures, read_full_text(F.col("raw"), label))


def read_head(captures: DataFrame, k: int = R.HEAD_MODE_LINES) -> DataFrame:
    return _report(captures, read_head_text(F.col("raw"), k))


def head_n(captures: DataFrame, k: int = R.SIMPLE_HEAD) -> DataFrame:
    return _report(captures, head_text(F.col("raw"), k))


def tail_n(captures: DataFrame, k: int = R.INSTALL_TAIL) -> DataFrame:
    return _report(captures, tail_text(F.col("raw"), k))


def surveyed(lines: DataFrame, first: int, last: int, hit: Column | None = None, caps: Mapping[str, int | None] | None = None) -> DataFrame:
    """One combining pass: the capped hits of each capture, and the ends of its other distinct lines.

    ``hit`` names the section of a line that belongs to one (``caps`` by section); it
    stays a row of its own, trimmed; the section ``skip`` only marks the capture.  Other
    lines are ``text`` and counted once, blank lines are ``blank``.  ``n_lines`` counts all lines of the capture, ``lead`` is its
    least section of hits; both come from the rows that are left, which caps bound.
    """
    section = F.when(not_blank(F.col("line")), "text").otherwise("blank")
    section = section if hit is None else F.coalesce(hit, section)
    own = ~F.col("section").isin("text", "blank", "skip")
    rows = lines.select("capture_id", "line_no", section.alias("section"), "line")
    rows = rows.withColumn("line", F.when(F.col("section").isin("blank", "skip"), "").when(own, trim_ws(F.col("line")))
                           .otherwise(F.col("line")))
    counted = rows.groupBy("capture_id", "section", "line", F.when(own, F.col("line_no")).alias("_own")).agg(
        F.count(F.lit(1)).alias("n"), F.min("line_no").alias("line_no"))
    k = F.lit(first).cast("bigint")
    for name, cap in (caps or {}).items():
        k = F.when(F.col("section") == name, F.lit(most(cap)).cast("bigint")).otherwise(k)
    ends = capped(counted, ["capture_id", "section"], [F.col("line_no")], k,
                  {"n_rows": ("sum", F.col("n")), "n_distinct": ("sum", F.lit(1))}, last=last, place=["capture_id"])
    capture = Window.partitionBy("capture_id")
    return ends.withColumns({
        "n_lines": F.sum(F.when(F.col("rank") == 1, F.col("n_rows"))).over(capture),
        "lead": F.min(F.when(~F.col("section").isin("text", "blank"), F.col("section"))).over(capture)})


def generic_parts(whole: int, front: int | None, end: int | None, prefix: str = "") -> list[tuple]:
    """The sections of the generic cut among surveyed rows, for captures without hits."""
    n, rank, back = F.col("n_distinct"), F.col("rank"), F.col("from_end")
    text = (F.col("section") == "text") & (F.col("n_lines") > whole) & F.col("lead").isNull()
    head = F.when(n <= whole, prefix + "distinct").otherwise(prefix + "head")
    return [(text & ((n <= whole) | (rank <= most(front))), head, rank, n),
            (text & (n > whole) & (back <= most(end)), F.lit(prefix + "tail"), n - back + 1, n)]


def passed(lines: DataFrame, whole: int, skip: Column | None = None, section: str = "pass") -> DataFrame:
    """Captures of at most ``whole`` lines as they are."""
    return sections_of(whole_groups(lines, ["capture_id"], whole, skip),
                       (F.lit(True), F.lit(section), F.col("rank"), F.col("total")))


def generic_lines(lines: DataFrame, whole: int = R.GENERIC_PASS, front: int | None = R.GENERIC_HEAD, end: int | None = R.GENERIC_TAIL,
                  skip: Column | None = None, prefix: str = "") -> DataFrame:
    """The generic cut over a line table: ``section, rank, line, total``.

    Sections: ``pass`` (at most ``whole`` lines, kept as they are), ``distinct`` (at
    most ``whole`` distinct), else the ``front`` ``head`` and ``end`` ``tail`` of the distinct lines,
    ``None`` for all.  Captures with a line that is ``skip`` give nothing.  The lines are read
    twice, since a task can cut short captures without a shuffle, but distinct lines must meet.
    """
    hit = None if skip is None else F.when(skip, "skip")
    rows = surveyed(lines, max(whole, most(front)), most(end), hit, {"skip": 1})
    return passed(lines, whole, skip, prefix + "pass").unionByName(sections_of(rows, *generic_parts(whole, front, end, prefix)))


def signature_lines(lines: DataFrame, fallback: int | None = R.SIGNATURE_FALLBACK) -> DataFrame:
    """Declaration lines; captures without any give their first ``fallback`` lines, ``None`` for all.

    One pass: each line is a candidate of the fallback, declarations sort first among
    them, and where the first is a declaration the fallback isn't taken.
    """
    line = F.col("line")
    rows = lines.withColumn("_hit", line.rlike(R.SIGNATURES[0]) | line.rlike(R.SIGNATURES[1]))
    hit = F.coalesce("_hit", F.lit(False))
    rows = rows.select("capture_id", "line_no", F.inline(F.array_compact(F.array(
        F.when(hit, F.struct(F.lit("signature").alias("section"), F.col("line_no").alias("_own"), line.alias("line"), hit.alias("_hit"))),
        F.struct(F.lit("fallback").alias("section"), F.lit(None).cast("bigint").alias("_own"), F.when(~hit, line).alias("line"), hit.alias("_hit"))))))
    first = capped(rows, ["capture_id", "section", "_own"], [F.col("_hit").desc(), F.col("line_no")], most(fallback))
    declares = F.max("_hit").over(Window.partitionBy("capture_id", "section", "_own"))
    return (first.withColumn("_hit", declares).where((F.col("section") == "signature") | ~F.col("_hit"))
            .select("capture_id", "line_no", "line", "section"))


#: Anchors, groups with options or look-around, and possessive counts may fit a line but not the text around it.
_LINE_BOUND = re.compile(r"[\^$]|\(\?|\\[AzZG]|[*+?}]\+")


def search(captures: DataFrame, pattern: str) -> DataFrame:
    """Lines matching ``pattern``, each line on its own.

    Where a match in a line is also one in the whole text, texts without a hit are dropped unsplit.
    """
    hit = captures if _LINE_BOUND.search(pattern) else captures.where(F.col("raw").rlike(pattern))
    lines = hit.select("capture_id", F.posexplode(F.split("raw", "\n", -1)).alias("line_no", "line"))
    return lines.where(F.col("line").rlike(pattern)).withColumn("line_no", bigint("line_no"))
