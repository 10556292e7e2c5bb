"""The registered queries of this package, over the whole given tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolelens.llm import (
    bottomk, chat_format, decontaminate, divergence, fptree, language_id, license_scan, packing, periodic_runs, pii,
    simhash, toxicity, url_filter,
)
from rolelens.llm.text import table

def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """The installed vocabulary file of that name."""
    import public_tokenizers

    return public_tokenizers.path(name)


Query = Callable[[SparkSession, str], DataFrame]


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licenses(table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    control = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    messages = chat_format.thread_messages(conversations.unionByName(control))
    return chat_format.digests(chat_format.format_chats(chat_format.reply_paths(messages)))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.document_fingerprints(table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bottomk.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text")).drop("text_key")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return toxicity.toxicity(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.languages(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the quality label of the document with its number."""
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), (F.col("quality") == 1).alias("good"))
    return url_filter.judge(table(spark, sf_dir, "pages", "page_id", "url"), outcomes)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return packing.pieces(docs, tokenizer_path(), with_ids=False).drop("ids")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return decontaminate.contamination(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents", "doc_id", "text"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return fptree.ranking(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return periodic_runs.periodic_runs(docs, edit=True).drop("runs")


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.quality(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


QUERIES: dict[str, Query] = {
    "op1_license_scan": op1_license_scan,
    "op2_chat_format": op2_chat_format,
    "op3_simhash": op3_simhash,
    "op4_minhash": op4_minhash,
    "op5_toxicity": op5_toxicity,
    "op6_language_id": op6_language_id,
    "op7_url_filter": op7_url_filter,
    "op8_packing": op8_packing,
    "op9_decontaminate": op9_decontaminate,
    "op10_pii": op10_pii,
    "op11_ranked_search": op11_ranked_search,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_quality_rules": op13_quality_rules,
}
