"""Where captures come from: tables, text files and file listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from capsift import rules as R
from capsift.functions.text import bigint
from capsift.sources.tree import tree

_CR = "\r"


def raw_of(stdout: Column, stderr: Column) -> Column:
    """Both streams as one text without carriage returns."""
    out = F.replace(F.coalesce(stdout, F.lit("")), F.lit(_CR), F.lit(""))
    err = F.replace(F.coalesce(stderr, F.lit("")), F.lit(_CR), F.lit(""))
    return F.when(err == "", out).otherwise(F.concat(out, F.lit("\n"), err))


def captures(df: DataFrame) -> DataFrame:
    """Replaces ``stdout`` and ``stderr`` by ``raw``; narrow, no shuffle."""
    return df.withColumn("raw", raw_of(F.col("stdout"), F.col("stderr"))).drop("stdout", "stderr")


def read_captures(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    """Captures from parquet, json, orc or csv files, or a table (``fmt="table"``)."""
    if fmt == "table":
        return captures(spark.table(path))
    reader = spark.read.format(fmt)
    return captures((reader.schema(schema) if schema else reader).load(path))


def text_captures(spark: SparkSession, path: str) -> DataFrame:
    """One capture per text file below ``path``, empty files too; the id is a hash of the path.

    Names that begin with ``.`` or ``_`` are left out, as Spark's readers do.
    """
    files = (spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
             .select(F.col("_metadata.file_path").alias("path"), F.col("value")))
    inside = F.substring(F.col("path"), F.length("root") + 1, F.length("path"))
    empty = (tree(spark, path).where(~F.col("is_dir") & (F.col("size") == 0) & ~inside.rlike("(^|/)[._]"))
             .select(F.col("uri").alias("path"), F.lit("").alias("value")))
    return files.unionByName(empty).select(F.xxhash64("path").alias("capture_id"), "path",
                                           F.replace("value", F.lit(_CR), F.lit("")).alias("raw"))


def listing(spark: SparkSession, path: str, show_all: bool = False, folders: bool = False) -> DataFrame:
    """``path, dir, name, ext, size, is_dir, modified`` of the files below ``path``, hidden and empty ones too.

    ``folders`` lists folders as well, with ``is_dir`` and no ``ext``.  Noise folders below the
    root (never the root itself) are not even opened.  No file content is read.
    """
    rows = tree(spark, path, () if show_all else R.NOISE_DIRS)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    ext = F.regexp_extract(name, r"(\.[^.]*)$", 1)
    return (rows if folders else rows.where(~F.col("is_dir"))).select(
        "path", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir"), name.alias("name"),
        F.when(~F.col("is_dir"), F.when(ext == "", "no ext").otherwise(ext)).alias("ext"), bigint("size").alias("size"),
        "is_dir", "modified")
