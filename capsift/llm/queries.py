"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from capsift.llm import chat, decontaminate, langid, licenses, mixing, quality, ranked, repair, repeats, simhash, tokens, topk, toxicity
from capsift.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


@query("op1_language_id")
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(langid.learnable(docs))
    rows = docs.select("doc_id", langid.held_out(docs).alias("held_out"), "text")
    return langid.predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")


@query("op2_license_scan", licenses.ORACLE)
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op3_simhash_near_dedup")
def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents"))


@query("op4_chat_format", chat.ORACLE)
def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = chat.with_injected(table(spark, sf_dir, "conversations"))
    return chat.digests(chat.format_chats(chat.text_parts(conversations)))


@query("op5_mix_sources", mixing.ORACLE)
def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


@query("op6_decontaminate", decontaminate.ORACLE)
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_repeated_text")
def op7_repeated_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the contract's columns, what is left, and what shorter passages cover
    rows = repeats.report(table(spark, sf_dir, "documents"), passages=repeats.PASSAGE_LEN)
    n_kept = (F.col("n_bytes") - F.col("n_removed")).alias("n_kept")
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", n_kept, "n_repeated")


@query("op8_token_counts")
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.recount(table(spark, sf_dir, "documents"))


@query("op9_topk", topk.ORACLE)
def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantized(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.search(vectors.filter(F.col("vec_id") % 50 == 0), vectors)


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query("op11_ranked_search", ranked.ORACLE)
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_structure_repair", repair.ORACLE)
def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.report(repair.damage(table(spark, sf_dir, "conversations")))


@query("op13_quality")
def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
