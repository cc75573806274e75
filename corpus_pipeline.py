"""The corpus pipeline: language ID, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame; it is written as
Parquet and read again as the next stage's ``docs``. All stages but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from regulonspark.llm import language_id, line_dedup, mixing, near_copies, packing
from regulonspark.llm.work import bounded_batches, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; models are fitted on a bounded sample of ``docs``."""
    bounded_batches(spark)
    who = language_id.train(docs.where(language_id.doc_residue() != 2))
    return language_id.keep_accepted(docs, who)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that match earlier ones."""
    return line_dedup.dedup_lines(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (Jaccard 0.8 on five-word shingles): that with the smallest id."""
    bounded_batches(spark)
    return near_copies.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix takes them, one row per copy."""
    return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    bounded_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash", dedup_documents),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Language models, shingle sets and tokenization are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
