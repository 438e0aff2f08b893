"""What several operators share: tables, durable intermediates, Arrow text, sampling."""

from __future__ import annotations

from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capsift.session import durable_dir

#: Blocks of texts are worked on together up to this many bytes.
BLOCK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder for one call's intermediates, where every executor can read it."""
    return f"{durable_dir(spark)}/llm-{uuid4().hex}"


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """The rows, written once and read back: a lost executor repeats tasks, not jobs."""
    path = f"{folder}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared(spark: SparkSession, value: object) -> Broadcast:
    """Broadcasts a value of bounded size; ``received`` gives it back in a task."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(broadcast: Broadcast) -> object:
    return cloudpickle.loads(broadcast.value)


def crc_remainder(column: Column, modulus: int) -> Column:
    """crc32 of the value as text, modulo ``modulus``; null for null."""
    return F.crc32(column.cast("string").cast("binary")) % modulus


def ascii_lower(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_binary(column.type):
        column = column.cast(pa.large_string())
    column = column.cast(pa.large_binary())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def blocks(offsets: np.ndarray, rows: int, size: int = BLOCK_BYTES):
    """Row ranges of at most ``rows`` rows and about ``size`` bytes; a longer text stands alone."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + size, side="right")) - 1
        end = min(max(end, start + 1), start + rows, n)
        yield start, end
        start = end


def distinct_text_sample(df: DataFrame, by: str, cap: int) -> DataFrame:
    """About ``cap`` distinct texts per value of ``by``, chosen by the hash of the text.

    Adds ``text_key``.  Copies of a text share a key, so a caller that groups by it
    is not swayed by repeated rows; which texts are taken depends on the texts only.
    """
    keyed = df.withColumn("text_key", F.xxhash64("text"))
    sizes = keyed.groupBy(by).agg(F.approx_count_distinct("text_key", 0.02).alias("n_texts"))
    share = F.lit(float(cap)) / F.col("n_texts")
    draw = F.shiftrightunsigned(F.xxhash64("text_key", F.lit("sample")), 11).cast("double") / float(1 << 53)
    # one row per group that is learned, so the sizes go to the texts and no text is shuffled
    return keyed.join(F.broadcast(sizes), by).filter(draw < share).drop("n_texts")


def packed(df: DataFrame, **more: Column) -> DataFrame:
    """The row as one column ``doc``, so that no name of an operator clashes with it."""
    return df.select(F.struct("*").alias("doc"), *[value.alias(name) for name, value in more.items()])


def unpacked(df: DataFrame, columns: list[str], *added: str) -> DataFrame:
    """The columns of ``doc`` again, then ``added``, which win over columns of the same name."""
    kept = [F.col("doc")[c].alias(c) for c in columns if c not in added]
    return df.select(*kept, *added)
