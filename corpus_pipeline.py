"""The corpus pipeline: stages over the documents table, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rolelens.llm import bottomk, decontaminate, language_id, packing, pii
from rolelens.llm.queries import tokenizer_path
from rolelens.llm.text import table
from rolelens.session import work_path

#: SQL for run()'s rows: none, as language models, sketches and tokenizers have no SQL form.
ORACLE_SQL = None

#: Near-duplicates share five-word shingles to at least this many hundredths.
SIMILARITY = 80


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be determined (no letter, no text, hardly any known n-gram) go."""
    model = language_id.learned(docs)
    return language_id.keep_identified(docs, model, language_id.score_floor(docs, model))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id."""
    return bottomk.keep_one(docs, SIMILARITY)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def privacy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind; n_chars keeps the length of the original text."""
    return pii.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences with their token ids."""
    return packing.pieces(docs, tokenizer_path())


STAGES = [
    ("language", language_stage),
    ("near_dedup", dedup_stage),
    ("decontamination", decontaminate_stage),
    ("privacy", privacy_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; the last stage's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        path = work_path(spark, f"{number}-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
