"""Running a stream over files to completion and reading its result back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from capsift.session import durable_dir


def read_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A parquet file source; ``path`` is one file or a folder of them."""
    schema = spark.read.parquet(path).schema
    path = path.rstrip("/")
    # The source takes a single file only as a glob, so the last letter becomes one.
    path = f"{path[:-1]}[{path[-1]}]"
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def run_available(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Processes what is there now, writes parquet, returns it as a table.

    Complete-mode results replace the output of the batch before; append-mode
    results use the exactly-once file sink.  State, offsets and output live in
    ``folder``: a call that names the same folder again goes on where the last one
    ended.  Without one, each call starts anew in the shared folder.
    """
    base = folder or f"{durable_dir(spark)}/stream-{name}-{uuid.uuid4().hex[:12]}"
    out, state = f"{base}/out", f"{base}/state"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").start(out)
    else:
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
