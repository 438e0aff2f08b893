"""Search results grouped by file and paths grouped by directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from capsift import rules as R
from capsift.functions.text import bigint, compact_path, snippet
from capsift.operators.lines import capped, most, whole_groups


def _with_file(lines: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Search results with their ``file`` and the place of the colon behind it."""
    line = F.col("line")
    drive = (F.substring(line, 2, 1) == ":") & line.rlike(R.GREP_DRIVE)  # the colon after a drive letter ends no file name
    at = F.when(drive, F.instr(line, ":") + F.locate(":", F.substring(line, 3, 1 << 30))
                ).otherwise(F.instr(line, ":"))
    at = F.when(drive & (F.locate(":", F.substring(line, 3, 1 << 30)) == 0), F.instr(line, ":")).otherwise(at)
    rows = lines.where(line.contains(":")).select("capture_id", "line_no", *keep, "line", at.alias("_at"))
    return rows.withColumn("file", F.substring(line, F.lit(1), F.col("_at") - 1))


def _with_content(rows: DataFrame) -> DataFrame:
    """``row`` and ``content`` in place of the line."""
    rest = F.substring(F.col("line"), F.col("_at") + 1, F.length("line"))
    rows = rows.withColumns({"_rest": rest, "_row": F.regexp_extract(rest, R.GREP_ROW, 1)})
    has_row = F.col("_row") != ""
    return rows.withColumns({
        "row": F.when(has_row, F.col("_row").cast("bigint")).otherwise(F.lit(0).cast("bigint")),
        "content": F.when(has_row, F.substring(F.col("_rest"), F.length("_row") + 2, F.length("_rest"))).otherwise(
            F.col("_rest"))}).drop("line", "_at", "_rest", "_row")


def parse_matches(lines: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``file, row, content`` out of ``file:row:content`` lines; narrow."""
    return _with_content(_with_file(lines, keep))


def matches_by_file(lines: DataFrame, pattern: str | None = None,
                    per_file: int = R.GREP_PER_FILE, overall: int = R.GREP_OVERALL) -> DataFrame:
    """First 5 matches per file, files in binary order, 50 rows per capture.

    Long lines are cut around ``pattern``, or around the line's own ``pattern``
    column where there is one.
    """
    keep = ("pattern",) if "pattern" in lines.columns else ()
    by_file = capped(_with_file(lines, keep), ["capture_id", "file"], [F.col("line_no")], per_file,
                     {"n_in_file": ("sum", F.lit(1))}, limit_first=True).withColumnRenamed("rank", "file_rank")
    first = F.col("file_rank") == 1
    listed = capped(by_file, ["capture_id"], [F.col("file"), F.col("file_rank")], overall,
                    {"n_files": ("sum", first.cast("int")),
                     "total": ("sum", F.when(first, F.col("n_in_file")).otherwise(0))},
                    split=F.pmod(F.xxhash64("file"), F.lit(64)))
    listed = _with_content(listed)  # only rows that are left are taken apart
    return listed.select("capture_id", "rank", "file", compact_path(F.col("file")).alias("file_display"),
                         "file_rank", "row", snippet(F.col("content"), F.col("pattern") if keep else pattern).alias("content"),
                         bigint("n_in_file").alias("n_in_file"), bigint("n_files").alias("n_files"),
                         bigint("total").alias("total"))


def split_path(lines: DataFrame, path: str = "line") -> DataFrame:
    """``dir`` and ``name`` of a path line; ``.`` when there is no directory."""
    p = F.col(path)
    folder = F.regexp_extract(p, r"^(.*)/[^/]*$", 1)
    return lines.where(F.length(F.btrim(p)) > 0).select(
        "capture_id", "line_no", F.when(folder == "", ".").otherwise(folder).alias("dir"),
        F.regexp_extract(p, r"([^/]*)$", 1).alias("name"))


def dir_groups(paths: DataFrame, whole: int | None = R.FIND_ALL, head: int | None = R.FIND_HEAD) -> DataFrame:
    """Per directory all names up to ``whole``, else the first ``head``; ``n`` counts all, ``None`` keeps all."""
    grouped = capped(paths, ["capture_id", "dir"], [F.col("line_no")], most(whole, head),
                     {"n": ("sum", F.lit(1)), "first_line_no": ("min", F.col("line_no"))})
    return grouped.where((F.col("n") <= most(whole)) | (F.col("rank") <= most(head)))


def paths_by_dir(paths: DataFrame, short: int = R.FIND_PASS, whole: int | None = R.FIND_ALL, head: int | None = R.FIND_HEAD) -> DataFrame:
    """Paths per directory: all up to ``whole``, else the first ``head``.

    Captures of at most ``short`` paths are marked ``short`` and list every path.
    """
    sizes = paths.groupBy("capture_id").agg(F.count(F.lit(1)).alias("total"))
    brief = (whole_groups(paths, ["capture_id"], short)
             .select("capture_id", F.lit("short").alias("section"), "dir", "rank", "name",
                     bigint("total").alias("n"), bigint("line_no").alias("first_line_no")))
    long = sizes.where(F.col("total") > short).select("capture_id")
    grouped = (dir_groups(paths, whole, head)
               .select("capture_id", F.lit("dir").alias("section"), "dir", "rank", "name",
                       bigint("n").alias("n"), bigint("first_line_no").alias("first_line_no"))
               .join(long, "capture_id", "left_semi"))
    return brief.unionByName(grouped)
