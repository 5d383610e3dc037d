"""The registered queries: each applies one operator, with its production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivane.llm import bitsliced, bpe, chat, html_extract, packing, quality, simhash, substring, token_cache, url_filter
from scrivane.llm.common import table
from scrivane.llm.sql import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]

Query = Callable[[SparkSession, str], DataFrame]


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitsliced.top_k(table(spark, sf_dir, "embeddings"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash.hex64("fp").alias("fingerprint"), F.col("component").alias("component_id"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.repeated_passages(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "kind", "para", "start", "length", "words", F.col("keeper").alias("keeper_doc_id"), "keeper_para", "removed")


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).drop("score")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache is a new one each time: every distinct text is encoded, stored and joined."""
    return token_cache.count_tokens(table(spark, sf_dir, "documents"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    linked = chat.link_calls(*chat.turns_as_calls(turns)).unionByName(chat.messages(turns))
    return linked.withColumn("faults", F.array_join("faults", "; "))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality(table(spark, sf_dir, "documents"))
    return judged.withColumns({c: F.round(c, 6) for c in ("class_distance", "common_distance")})


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (op1_exact_top_k, op2_byte_bpe, op3_html_extraction, op4_best_fit_packing, op5_simhash_near_dedup, op6_substring_dedup, op7_url_filters, op8_token_counts, op9_chat_formatting, op10_quality_rules)
}
