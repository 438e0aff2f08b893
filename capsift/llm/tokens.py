"""Token counts as rollups that are kept up to date by signed deltas.

A change is an insert, a delete or a revised count of one document under one tokenizer
version.  It adds ``+1, +tokens``, ``-1, -tokens`` or ``0, new - old`` to the totals of
its source, language and version, so totals are sums of deltas and never recomputed.

A batch of changes is combined per group and written to a folder of its own name; the
marker that Spark writes last makes it count.  Committing a batch again does nothing, a
batch that died half way is written anew, and totals read marked folders only.  Batches are
compacted to a base that keeps their names, so totals don't read all batches for ever.

Counts: ``bpe`` versions load a vocabulary file of byte-pair ranks, whose path is a
parameter, on the driver and broadcast it (the file's size is checked).

Defined cases: null text has no tokens; null source or language is a group of its own;
an unknown operation or a null count is an error; groups whose documents and tokens
cancel out leave the totals; no change, no totals.
"""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capsift.llm.common import received, scratch, shared, stored, utf8

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MAX_VOCABULARY_BYTES = 64 << 20
KEYS = ["source", "lang", "tokenizer"]

# FIXED VALUE: how the public byte-level vocabulary splits text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def estimate(text: Column) -> Column:
    """Provisional count: four characters to a token."""
    return F.ceil(F.coalesce(F.char_length(text), F.lit(0)) / 4).cast("long")


def bpe_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, source, lang, text`` -> ``doc_id, source, lang, n_provisional, n_tokens``."""
    with open(vocabulary, "rb") as file:
        content = file.read(MAX_VOCABULARY_BYTES + 1)
    if len(content) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{vocabulary} is larger than {MAX_VOCABULARY_BYTES} bytes")
    sent = shared(docs.sparkSession, content)

    def count(batches):
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, received(sent).splitlines())}
        encoding = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            raw = memoryview(data)
            counts = [len(encoding.encode_ordinary(str(raw[a:b], "utf-8"))) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            kept = ["doc_id", "source", "lang", "n_provisional"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(counts, pa.int64())], [*kept, "n_tokens"])

    rows = docs.select("doc_id", "source", "lang", estimate(F.col("text")).alias("n_provisional"), "text")
    return rows.mapInArrow(count, "doc_id long, source string, lang string, n_provisional long, n_tokens long")


def deltas(changes: DataFrame) -> DataFrame:
    """``op, source, lang, tokenizer, n_old, n_new`` -> signed sums per group."""
    op, old, new = F.col("op"), F.col("n_old"), F.col("n_new")
    wrong = F.raise_error(F.concat(F.lit("no such change, or a count is missing: "), F.coalesce(op, F.lit("null"))))
    docs = F.when((op == "insert") & new.isNotNull(), 1).when((op == "delete") & old.isNotNull(), -1).when(
        (op == "revise") & old.isNotNull() & new.isNotNull(), 0).otherwise(wrong)
    tokens = F.when(op == "insert", new).when(op == "delete", -old).otherwise(new - old)
    return changes.groupBy(*KEYS).agg(F.sum(docs.cast("long")).alias("n_docs"), F.sum(tokens).alias("n_tokens"))


TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


class Rollup:
    """Totals under ``folder``, which every executor can reach; one writer at a time."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _whole(self, kind: str) -> list[str]:
        """Names of the folders of a kind that were written whole."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}-*/_SUCCESS")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path)
        return sorted(status.getPath().getParent().getName().removeprefix(f"{kind}-") for status in found or [])

    def _base(self) -> tuple[str | None, set[str]]:
        """The newest base and the batches that it holds; these are as many as commits, not as rows."""
        bases = self._whole("base")
        if not bases:
            return None, set()
        path = f"{self.folder}/base-{bases[-1]}"
        return path, {r["batch"] for r in self.spark.read.schema(f"{TOTALS}, batch string").parquet(path).filter("batch is not null").collect()}

    def batches(self) -> list[str]:
        """Committed batches, in a base or not."""
        return sorted(set(self._whole("batch")) | self._base()[1])

    def commit(self, batch: str, changes: DataFrame, verify: bool = False) -> bool:
        """Adds the changes, once; False if the batch was committed before.

        ``verify`` reads a batch that comes again and compares it with what was committed
        (unless a base holds it by now): other changes under the same name are an error.
        """
        if not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError("a batch is named with letters, digits, - and _")
        if batch in self.batches():
            if verify and batch in self._whole("batch"):
                before = self.spark.read.schema(TOTALS).parquet(f"{self.folder}/batch-{batch}")
                again = deltas(changes)
                if not before.exceptAll(again).unionAll(again.exceptAll(before)).isEmpty():
                    raise ValueError(f"batch {batch} was committed with other changes")
            return False
        deltas(changes).write.mode("overwrite").parquet(f"{self.folder}/batch-{batch}")
        return True

    def _rows(self) -> DataFrame:
        base, held = self._base()
        paths = [f"{self.folder}/batch-{batch}" for batch in self._whole("batch") if batch not in held]
        rows = self.spark.read.schema(TOTALS).parquet(*paths) if paths else self.spark.createDataFrame([], TOTALS)
        if base:
            rows = rows.unionByName(self.spark.read.schema(f"{TOTALS}, batch string").parquet(base).filter("batch is null").drop("batch"))
        return rows

    def compact(self) -> None:
        """Puts all batches into a new base, which also keeps their names, and then removes them.

        A base counts when it is written whole, and batches that it holds are read no more, so
        dying at any point changes no total.
        """
        names = self.batches()
        if not names:
            return
        bases = self._whole("base")
        number = int(bases[-1]) + 1 if bases else 1
        held = self.spark.createDataFrame([(name,) for name in names], "batch string").select(
            *[F.lit(None).cast(kind).alias(name) for name, kind in (c.split() for c in TOTALS.split(", "))], "batch")
        summed = self._summed().withColumn("batch", F.lit(None).cast("string"))
        summed.unionByName(held).write.mode("overwrite").parquet(f"{self.folder}/base-{number:09d}")
        for old in [f"batch-{name}" for name in self._whole("batch") if name in names] + [f"base-{name}" for name in bases]:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{old}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _summed(self) -> DataFrame:
        sums = self._rows().groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.filter("n_docs <> 0 or n_tokens <> 0")

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer, n_docs, n_tokens``."""
        return self._summed()


PROVISIONAL = "four_chars-1"


def recount(docs: DataFrame, tokenizer: str = "byte_bpe_50k-1", vocabulary: str = VOCABULARY) -> DataFrame:
    """Totals of a corpus that went through all kinds of change.

    It is loaded under the provisional version, moved (deleted there and inserted with the same
    counts under the tokenizer's version), compacted, and revised to the tokenizer's counts; the last
    batch is sent twice.  The provisional version cancels out.
    """
    folder = scratch(docs.sparkSession)
    rollup, counted = Rollup(docs.sparkSession, folder), stored(bpe_counts(docs, vocabulary), folder, "counts")

    def change(op: str, version: str, old: str | None, new: str | None) -> DataFrame:
        count = lambda name: (F.lit(None) if name is None else F.col(name)).cast("long")
        return counted.select(F.lit(op).alias("op"), "source", "lang", F.lit(version).alias("tokenizer"), count(old).alias("n_old"), count(new).alias("n_new"))

    rollup.commit("load", change("insert", PROVISIONAL, None, "n_provisional"))
    moved = change("delete", PROVISIONAL, "n_provisional", None).unionByName(change("insert", tokenizer, None, "n_provisional"))
    rollup.commit("move", moved)
    rollup.compact()
    revised = change("revise", tokenizer, "n_provisional", "n_tokens")
    rollup.commit("recount", revised)
    rollup.commit("recount", revised, verify=True)
    return rollup.totals()
