"""A training corpus from documents: five stages, each over all rows that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lineleaf.llm import bpe, mixing, ngram_join, pii, quality

#: A document is taken once at most, so that what the join has made single stays single.
MIXTURE = mixing.Mixture(weights={("d0",): 0.8}, epochs=1, seed=7)
TOKENS_SHARE = 0.95
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lines that very many documents of a host hold are taken out of the rest."""
    return quality.clean_documents(docs)


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity of 0.8 or more."""
    return ngram_join.one_of_each(docs, n=5, percent=80)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind."""
    return pii.redact_documents(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are drawn to their weights within the budget."""
    return mixing.of_documents(docs, MIXTURE, TOKENS_SHARE).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and digests of them and of the decoded text."""
    return bpe.encode_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_join", ngram_join_stage),
    ("pii", private_data),
    ("mixing", source_mixing),
    ("bpe", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another on the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs


#: Boosted trees and byte-pair encoding aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None
