"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

A stage takes ``(spark, docs, sf_dir)`` and works on all rows that the one before it kept.
All but the last return the columns of the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capsift.llm import decontaminate, langid, mixing, repeats, simhash
from capsift.llm.common import packed, scratch, stored, table, unpacked

#: Bytes from which on a repeated passage goes: some 50 words of five bytes.  Near copies are
#: gone before, so that what repeats is shorter than the 400 bytes that ``op7`` reports on.
REPEAT_BYTES = 250


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; rejects texts without a letter, and texts that come near no language."""
    rows = langid.identify(packed(docs, doc_id=F.col("doc_id"), text=F.col("text"), lang=F.col("lang")).select("doc", "doc_id", "text", "lang"), near=True)
    kept = rows.filter((F.col("lang_pred") != langid.UNKNOWN) & F.col("near"))
    return unpacked(kept, docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest id, without any id the one with the smallest text hash.

    The choice is made on ids and text hashes, per group and not per id, as ids may be null or
    repeated; the documents are shuffled once, by both.
    """
    named = lambda doc_id: F.coalesce(doc_id.cast("string"), F.lit("none"))
    groups = simhash.near_duplicates(docs.select("doc_id", "text"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")).alias("first")
    firsts = groups.groupBy("root").agg(first).select(named(F.col("first.doc_id")).alias("id_key"), "first.text_key")
    rows = packed(docs, id_key=named(F.col("doc_id")), text_key=F.xxhash64("text"))
    return unpacked(rows.join(firsts, ["id_key", "text_key"]).dropDuplicates(["id_key", "text_key"]), docs.columns)


def drop_repeated_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of ``REPEAT_BYTES`` or more that repeat."""
    return repeats.drop_repeats(docs, REPEAT_BYTES)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item's window occurs."""
    return decontaminate.drop_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the words it takes of each."""
    return mixing.mix(docs).filter("taken > 0")


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", drop_repeated_text),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

ORACLE_SQL = None  # kernels, fingerprints and suffixes are beyond SQL; tests compare the first two stages with known rows


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), folder, name)
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
