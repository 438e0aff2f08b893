"""Directory listings and task lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from capsift import rules as R
from capsift.functions.text import bigint, contains_any, groups, human_size, trim_ws
from capsift.operators.lines import CHUNK, capped, carry, filled


def listing_entries(lines: DataFrame, show_all: bool = False) -> DataFrame:
    """Entries of ``ls -la`` or Windows ``dir`` output; narrow, no shuffle."""
    line = F.col("line")
    rows = filled(lines).select("capture_id", "line_no", "line", F.when(
        line.rlike(R.LS_LINE), "ls").when(line.contains("<DIR>"), "dir").when(
        line.rlike(R.WINDOWS_LINE) & ~contains_any(line, "File(s)", "Dir(s)"), "file").alias("_kind"))
    kind = F.col("_kind")
    # One array of fields per line, whatever the format: name, size, is a directory.
    rows = rows.where(kind.isNotNull()).select(
        "capture_id", "line_no", kind, F.when(kind == "ls", F.split(line, r"\s+", -1)).when(
            kind == "dir", groups(line, r"^.*" + R.WINDOWS_DIR, 1)).otherwise(groups(line, R.WINDOWS_FILE_LINE, 2)).alias("_p"),
        line.startswith("d").alias("_d"))
    p = F.col("_p")
    name = F.when(kind == "ls", F.when(F.size(p) >= 9, F.array_join(F.slice(p, F.lit(9), F.greatest(F.size(p), F.lit(1))), " "))
                  ).when(kind == "dir", F.get(p, F.lit(1))).otherwise(F.get(p, F.lit(2)))
    size = F.when(kind == "ls", F.get(p, F.lit(4))).when(kind == "file", F.replace(F.get(p, F.lit(1)), F.lit(","), F.lit("")))
    rows = rows.select("capture_id", "line_no", F.struct(
        trim_ws(name).alias("name"), ((kind == "dir") | ((kind == "ls") & F.col("_d"))).alias("is_dir"),
        bigint(F.coalesce(size.try_cast("bigint"), F.lit(0))).alias("size")).alias("_e"))
    dropped = ("", ".", "..") + (() if show_all else R.NOISE_DIRS)
    rows = rows.select("capture_id", "line_no", F.inline(F.filter(
        F.array("_e"), lambda e: e["name"].isNotNull() & ~e["name"].isin(*dropped))))
    ext = F.regexp_extract(F.col("name"), r"(\.[^.]*)$", 1)
    return (rows.withColumn("ext", F.when(~F.col("is_dir"), F.when(ext == "", "no ext").otherwise(ext)))
            .withColumn("size_text", F.when(~F.col("is_dir"), human_size(F.col("size")))))


def listing_summary(entries: DataFrame, cap: int = R.EXT_CAP) -> DataFrame:
    """Most frequent extensions per capture, with file and directory totals."""
    groups = entries.groupBy("capture_id", "is_dir", "ext").agg(
        F.count(F.lit(1)).alias("n"), F.min("line_no").alias("line_no"), F.sum("size").alias("bytes"))
    is_dir, n = F.col("is_dir"), F.col("n")
    listed = capped(groups, ["capture_id"], [is_dir, n.desc(), F.col("line_no")], cap,
                    {"n_files": ("sum", F.when(~is_dir, n).otherwise(0)),
                     "n_dirs": ("sum", F.when(is_dir, n).otherwise(0)),
                     "n_ext": ("sum", F.when(~is_dir, 1).otherwise(0))},
                    split=F.pmod(F.xxhash64("ext"), F.lit(64)))
    return listed.where(~is_dir | (F.col("rank") == 1)).select(
        "capture_id", "rank", F.coalesce("ext", F.lit("(dirs)")).alias("ext"), bigint("n").alias("n"),
        bigint("bytes").alias("bytes"), bigint("n_files").alias("n_files"),
        bigint("n_dirs").alias("n_dirs"), bigint("n_ext").alias("n_ext"))


def tasks_by_group(lines: DataFrame, cap: int = R.TASK_CAP, chunk: int | None = CHUNK) -> DataFrame:
    """Build tasks under their group header, first eight per group."""
    line = F.col("line")
    header = line.endswith(" tasks") & ~line.startswith(" ")
    # Group names repeat across captures, so the header's text is the value carried.
    name = F.when(header, trim_ws(F.regexp_replace(line, r"^(.*?) tasks", "$1")))
    rows = carry(filled(lines), {"grp": name}, chunk)
    items = rows.where(line.rlike(r"^[A-Za-z0-9_]") & line.contains(" - ")).select(
        "capture_id", "line_no", F.coalesce("grp", F.lit("other")).alias("task_group"),
        trim_ws(line).alias("task"))
    listed = capped(items, ["capture_id", "task_group"], [F.col("line_no")], cap,
                    {"total": ("sum", F.lit(1)), "first_line_no": ("min", F.col("line_no"))})
    return listed.select("capture_id", "task_group", bigint("first_line_no").alias("first_line_no"),
                         "rank", "task", bigint("total").alias("total"))
