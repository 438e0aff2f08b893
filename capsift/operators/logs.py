"""Log templates, totals and Android logcat summaries."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window, functions as F

from capsift import rules as R
from capsift.functions.text import bigint, contains_any, normalize_log_line, not_blank, trim_ws, truncate_line
from capsift.operators.lines import capped, capped_tally, classed, filled, most, with_caps, within_caps


def with_severity(lines: DataFrame, wanted: tuple[str, ...] = ("error", "warn", "info")) -> DataFrame:
    """Lines of the ``wanted`` severities, with ``severity``.

    The class is exploded out of an array instead of filtered on: a filter would
    be pushed below and lower-case every line a second time.
    """
    low = F.col("_low")
    severity = (F.when(contains_any(low, "error", "fatal", "panic"), "error")
                .when(low.contains("warn"), "warn").when(low.contains("info"), "info"))
    rows = lines.withColumn("_low", F.lower("line"))
    return rows.select(*lines.columns, F.explode(F.filter(
        F.array(severity), lambda s: s.isin(*wanted))).alias("severity"))


def template_counts(lines: DataFrame, info: bool = False) -> DataFrame:
    """Every error / warn template with its count and first raw line.

    ``info`` adds the info lines as one group with an empty template.
    """
    wanted = ("error", "warn", "info") if info else ("error", "warn")
    template = F.when(F.col("severity") == "info", "").otherwise(normalize_log_line(F.col("line")))
    return (with_severity(lines, wanted).withColumn("template", template)
            .groupBy("capture_id", "severity", "template")
            .agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("line_no"),
                 F.min_by("line", "line_no").alias("first_line")))


def log_templates(lines: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """Most frequent templates per capture and severity, earliest first on ties.

    A cap for ``info`` adds its line count as one row with an empty template.
    """
    caps = caps or R.LOG_TOP
    ranked = capped(template_counts(lines, "info" in caps), ["capture_id", "severity"],
                    [F.col("n").desc(), F.col("line_no"), F.col("template")], max(caps.values()),
                    {"total": ("sum", F.col("n")), "n_unique": ("sum", F.lit(1))},
                    split=F.pmod(F.xxhash64("template"), F.lit(64)))
    return within_caps(ranked, caps, "severity").select(
        "capture_id", "severity", "rank", "template", bigint("n").alias("n"),
        truncate_line(F.col("first_line"), R.EXEMPLAR_WIDTH).alias("exemplar"),
        bigint("line_no").alias("first_line_no"), bigint("total").alias("total"),
        bigint("n_unique").alias("n_unique"))


def log_totals(lines: DataFrame) -> DataFrame:
    """Per capture: totals and unique counts of errors and warnings, info count."""
    info = F.col("severity") == "info"
    grouped = (with_severity(lines)
               .withColumn("template", F.when(~info, normalize_log_line(F.col("line"))))
               .groupBy("capture_id", "severity", "template").agg(F.count(F.lit(1)).alias("n")))

    def of(severity: str, value):
        return bigint(F.sum(F.when(F.col("severity") == severity, value).otherwise(0)))

    one, n = F.lit(1), F.col("n")
    return grouped.groupBy("capture_id").agg(
        of("error", n).alias("errors"), of("error", one).alias("unique_errors"),
        of("warn", n).alias("warnings"), of("warn", one).alias("unique_warnings"),
        of("info", n).alias("infos"))


def log_sketches(lines: DataFrame, lg_k: int = 14) -> DataFrame:
    """Per UTC day and severity: lines, and a mergeable sketch of their distinct templates.

    ``lines`` carries ``ts``.  Sketches of days are stored once and united by
    :func:`log_totals_of`, whatever span is asked for, without reading lines again.  With
    ``lg_k = 14`` an estimate is within 2 percent of the exact number at 95 percent confidence.
    """
    info = F.col("severity") == "info"
    rows = with_severity(lines).withColumn("template", F.when(info, "").otherwise(normalize_log_line(F.col("line"))))
    return rows.groupBy(F.to_date("ts").alias("date"), "severity").agg(
        bigint(F.count(F.lit(1))).alias("n"), F.hll_sketch_agg("template", F.lit(lg_k)).alias("templates"))


def log_totals_of(sketches: DataFrame, *keys: str) -> DataFrame:
    """Lines and estimated distinct templates per severity (and ``keys``) from stored sketches."""
    return sketches.groupBy(*keys, "severity").agg(
        bigint(F.sum("n")).alias("n"), bigint(F.hll_sketch_estimate(F.hll_union_agg("templates"))).alias("n_unique"))


def logcat_summary(lines: DataFrame, caps: Mapping[str, int | None] | None = None, whole: int = R.LOGCAT_PASS,
                   recent: int = R.LOGCAT_RECENT) -> DataFrame:
    """Fatal, error and warning lines of a logcat, distinct and capped.

    A line is counted once per section.  Captures of at most ``whole`` lines pass
    whole, captures without any hit give their last ``recent`` lines.  ``caps`` replaces
    the default caps by section, ``None`` for all rows.
    """
    caps = with_caps(R.LOGCAT_CAPS, caps)
    raw, capture = F.col("line"), Window.partitionBy("capture_id")
    rows = lines.select("capture_id", "line_no", raw.alias("_raw"), trim_ws(raw).alias("line"))
    line, low = F.col("line"), F.lower("line")
    # Every test runs once per line; regexes only where their letters occur.
    tests = rows.select("*", (low.contains("fatal") | (low.contains("f/") & line.rlike(R.LOGCAT_FATAL))).alias("f"),
                        (low.contains("error") | (low.contains("e/") & line.rlike(R.LOGCAT_ERROR))).alias("e"),
                        (low.contains("warn") | (low.contains("w/") & line.rlike(R.LOGCAT_WARNING))).alias("w"),
                        (contains_any(low, "androidruntime", "anr in") | (
                            low.contains("process:") & line.rlike(R.LOGCAT_CRASH))).alias("c"))
    fatal, error = F.col("f") | F.col("c"), F.col("e") & ~F.col("f")
    warning = F.col("w") & ~F.col("e") & ~F.col("f")
    # The nameless section holds every line as the same empty text: it combines to the line count.
    hits = classed(tests, [F.lit(""), F.when(fatal, "fatal"), F.when(error, "error"), F.when(warning, "warning")]).select(
        "capture_id", "section", "line_no", F.when(F.col("section") == "", "").otherwise(line).alias("line"))
    listed = within_caps(capped_tally(hits, ["capture_id", "section"], most(*caps.values()), place=["capture_id"]), {**caps, "": 1})
    sized = listed.withColumn("n_lines", F.max(F.when(F.col("section") == "", F.col("total"))).over(capture))
    listed = sized.where((F.col("n_lines") > whole) & (F.col("section") != "")).select(
        "capture_id", "section", "rank", "line", bigint("total").alias("total"), bigint("n_distinct").alias("n_distinct"))
    # Whole short captures and newest lines: hits sort first among the newest, so the first one tells of any.
    hit, at = F.coalesce(fatal | error | warning, F.lit(False)), F.col("line_no")
    both = tests.select("capture_id", F.inline(F.array_compact(F.array(
        F.struct(F.lit("pass").alias("section"), F.col("_raw").alias("line"), at.alias("_at"), F.lit(False).alias("_hit")),
        F.when(not_blank(line), F.struct(F.lit("recent").alias("section"), line.alias("line"), (-at).alias("_at"), hit.alias("_hit")))))))
    first = capped(both, ["capture_id", "section"], [F.col("_hit").desc(), F.col("_at")], max(whole + 1, recent))
    passes = F.col("section") == "pass"
    known = first.withColumns({"total": F.count_if(passes).over(capture), "_hit": F.max("_hit").over(capture)})
    short = F.col("total") <= whole
    plain = known.where(F.when(passes, short).otherwise(~short & ~F.col("_hit") & (F.col("rank") <= recent)))
    total = bigint(F.when(passes, F.col("total")).otherwise(F.lit(recent)))
    return listed.unionByName(plain.select("capture_id", "section", "rank", "line", total.alias("total"), total.alias("n_distinct")))
