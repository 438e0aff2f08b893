"""Package-manager noise filters and hint stripping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from capsift import rules as R
from capsift.functions.text import bigint, not_blank, trim_ws
from capsift.operators.cut import generic_lines, generic_parts, passed, surveyed
from capsift.operators.lines import capped, capped_list, classed, filled, most, sections_of


def drop_noise_dirs(rows: DataFrame, *columns: str, show_all: bool = False) -> DataFrame:
    """Drops rows where a path column has a segment in the noise list."""
    if show_all:
        return rows
    noise = F.array(*[F.lit(name) for name in R.NOISE_DIRS])
    for column in columns or ("name",):
        rows = rows.where(~F.arrays_overlap(F.split(column, "/", -1), noise))
    return rows


def filter_status_hints(lines: DataFrame) -> DataFrame:
    """Verbose status without hints; stops after the "nothing to commit" line."""
    text = trim_ws(F.col("line"))
    stop = text.contains("nothing to commit") & text.contains("working tree clean")
    kept = filled(lines).where(~text.rlike(R.STATUS_HINT))
    # One number per capture that says so; the lines themselves are never sorted.
    stops = kept.where(stop).groupBy("capture_id").agg(F.min("line_no").alias("stop_at"))
    at, no = F.col("stop_at"), F.col("line_no")
    return (kept.join(stops, "capture_id", "left").where(at.isNull() | (no <= at))
            .select("capture_id", "line_no", F.when(no == at, text).otherwise(F.col("line")).alias("line")))


def _rows(df: DataFrame, section: str) -> DataFrame:
    return df.select("capture_id", F.lit(section).alias("section"), bigint("rank").alias("rank"),
                     "line", bigint("total").alias("total"))


def drop_npm_noise(lines: DataFrame, errors: int | None = R.NPM_ERROR_CAP, summaries: int | None = R.NPM_SUMMARY_CAP) -> DataFrame:
    """npm errors if any, else summary lines, else the generic cut; a cap of ``None`` keeps all."""
    line = trim_ws(F.col("line"))
    noise = (line.rlike(R.NPM_NOISE) & ~line.rlike("(?i)error")) | line.rlike(R.NPM_SPINNER)
    hit = F.when(~noise, F.when(line.rlike(R.NPM_ERROR), "error").when(line.rlike(R.NPM_SUMMARY), "summary"))
    caps = {"error": errors, "summary": summaries}
    whole, front, end = R.GENERIC_PASS, R.GENERIC_HEAD, R.GENERIC_TAIL
    rows = surveyed(lines, max(whole, front), end, hit, caps)
    rank, limit = F.col("rank"), F.when(F.col("section") == "error", F.lit(most(errors))).otherwise(F.lit(most(summaries)))
    leads = (F.col("section") == F.col("lead")) & (rank <= limit)
    listed = sections_of(rows, (leads, F.col("section"), rank, F.col("n_rows")), *generic_parts(whole, front, end, "generic_"))
    return listed.unionByName(passed(lines, whole, hit.isNotNull(), "generic_pass")).drop("line_no")


def drop_pnpm_noise(lines: DataFrame, whole: int = R.PNPM_PASS, dependencies: int | None = R.PNPM_CAP) -> DataFrame:
    """At most ``whole`` lines pass; more give a summary line and the first ``dependencies``, ``None`` for all.

    One combining pass counts, another takes the first lines, cut per task before the shuffle.
    """
    line, rank = F.col("line"), F.col("rank")
    kept = filled(lines).where(~trim_ws(line).rlike(R.PNPM_NOISE))
    is_dep, is_sum = line.rlike(R.PNPM_DEPENDENCY), line.rlike(R.PNPM_SUMMARY)
    stats = kept.groupBy(F.col("capture_id").alias("_id")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(is_dep).alias("total"),
        F.min_by("line", F.when(is_sum, F.col("line_no"))).alias("summary"))
    both = classed(kept, [F.lit("pass"), F.when(is_dep, "dependency")])
    first = capped(both, ["capture_id", "section"], [F.col("line_no")], most(whole, dependencies))
    known = first.join(stats, F.col("capture_id").eqNullSafe(F.col("_id")))
    long, passes = F.col("n") > whole, F.col("section") == "pass"
    summary = F.coalesce("summary", F.format_string("%d packages", "total"))

    def part(when: Column, section: str, text: Column, total: str) -> Column:
        return F.when(when, F.struct(F.lit(section).alias("section"), rank.alias("rank"), text.alias("line"), bigint(total).alias("total")))

    return known.select("capture_id", F.inline(F.array_compact(F.array(
        part(passes & ~long, "pass", line, "n"), part(passes & long & (rank == 1), "summary", summary, "total"),
        part(~passes & long & (rank <= most(dependencies)), "dependency", line, "total")))))


def drop_pip_noise(lines: DataFrame, whole: int = R.PIP_PASS, head: int | None = R.PIP_CAP) -> DataFrame:
    """At most ``whole`` lines pass; more give the first ``head`` (``None`` for all) and the total."""
    kept = filled(lines).where(~trim_ws(F.col("line")).rlike(R.PIP_NOISE))
    ranked = capped_list(kept, ["capture_id"], most(whole, head))
    long = F.col("total") > whole
    return (ranked.where(~long | (F.col("rank") <= most(head)))
            .select("capture_id", F.when(long, "head").otherwise("pass").alias("section"), bigint("rank").alias("rank"),
                    "line", bigint("total").alias("total")))


def drop_prisma_noise(lines: DataFrame) -> DataFrame:
    """Keyword lines without boxes and rules, else the generic cut."""
    line = trim_ws(F.col("line"))
    hit = not_blank(F.col("line")) & ~line.rlike(R.PRISMA_BOX) & ~line.rlike(R.PRISMA_RULE) & line.rlike(R.PRISMA_KEEP)
    listed = lines.where(hit).select("capture_id", F.lit("kept").alias("section"), bigint("line_no").alias("rank"),
                                     line.alias("line"), F.lit(None).cast("bigint").alias("total"))
    return listed.unionByName(generic_lines(lines, skip=hit, prefix="generic_").drop("line_no"))


def unformatted_files(lines: DataFrame, cap: int | None = R.PRETTIER_CAP) -> DataFrame:
    """Files a formatter check names: first 20 per capture and their number."""
    kept = filled(lines).where(~F.col("line").rlike(R.PRETTIER_BANNER))
    return _rows(capped_list(kept, ["capture_id"], most(cap)), "file")


def mask_value(name: Column, value: Column, line: Column) -> Column:
    """A ``NAME=value`` line with secrets masked and long values cut."""
    return (F.when(name.rlike(R.SECRET_NAME), F.concat(name, F.lit("=" + R.MASK)))
            .when(F.length(value) > R.ENV_WIDTH,
                  F.concat(name, F.lit("="), F.substring(value, 1, R.ENV_KEEP), F.lit("...")))
            .otherwise(line))


def mask_env(lines: DataFrame, contains: str | None = None) -> DataFrame:
    """Environment listing with secret values masked; narrow, no shuffle."""
    line = F.col("line")
    rows = lines.where(line.contains("="))
    if contains:
        rows = rows.where(F.lower(line).contains(contains.lower()))
    at = F.instr(line, "=")
    name = F.substring(line, F.lit(1), at - 1)
    value = F.substring(line, at + 1, F.length(line))
    return rows.select("capture_id", "line_no", mask_value(name, value, line).alias("line"),
                       name.rlike(R.SECRET_NAME).alias("masked"))


def mask_text(captures: DataFrame) -> DataFrame:
    """Inline ``name = value`` secrets masked anywhere in whole texts.

    One pass: values become a marker, the markers are counted and then spelled
    out.  A text that holds the marker itself is masked and counted directly.
    """
    raw, marker = F.col("raw"), "\x02"
    rows = captures.select("capture_id", "raw", raw.contains(marker).alias("_odd"),
                           F.regexp_replace(raw, R.INLINE_SECRET, "$1" + marker).alias("_marked"))
    marked, odd = F.col("_marked"), F.col("_odd")
    spelled = F.replace(marked, F.lit(marker), F.lit(R.MASK))
    count = F.length(marked) - F.length(F.replace(marked, F.lit(marker), F.lit("")))
    return rows.select(
        "capture_id",
        F.when(odd, F.regexp_replace(raw, R.INLINE_SECRET, "$1" + R.MASK)).otherwise(spelled).alias("masked"),
        bigint(F.when(odd, F.regexp_count(raw, F.lit(R.INLINE_SECRET))).otherwise(count)).alias("n_masked"))
