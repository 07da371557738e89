"""The registered queries of this subpackage, with production parameters on whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, embed_dedup, langid, mixing, ngram_join, pii, quality, suffix_dedup, token_count
from .common import table
from .oracle import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]

Query = Callable[[SparkSession, str], DataFrame]


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    stray = spark.sql("select -1L as conv_id, t.turn, t.role, s as text from (select explode(array(struct(0L as turn, 'user' as role), struct(1L as turn, 'assistant' as role))) as t), (select '</s>[INST] ok [/INST]' as s)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(stray)
    return chat.digest_segments(chat.format_conversations(rows)).drop("complete")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), with_ids=False).drop("ids")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(table(spark, sf_dir, "documents"))


#: Web-like domain 0 weighs half of each other one; three passes at most.
MIXTURE = mixing.Mixture(weights={("d0",): 0.5}, epochs=3, seed=11)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.of_documents(table(spark, sf_dir, "documents"), MIXTURE, budget_share=0.8)
    return taken.select("doc_id", "mix_domain", "mix_language", "mix_source", "mix_tokens", "mix_epoch")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(table(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_documents(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_strings(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_spans(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_chat_format": op1_chat_format,
    "op2_bpe": op2_bpe,
    "op3_ngram_join": op3_ngram_join,
    "op4_mixing": op4_mixing,
    "op5_language_id": op5_language_id,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_token_counts": op8_token_counts,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_pii": op10_pii,
}

