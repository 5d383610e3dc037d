"""The corpus pipeline: quality rules, SimHash near-dedup, substring dedup, best-fit packing.

Each stage gets all that its predecessor kept, as a reread table; all but the last return the columns of documents, other
columns too. Very long texts are read whole, and an empty table goes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scrivane.llm import packing, quality, simhash, substring
from scrivane.llm.common import clean, materialise, scratch, table, tidy


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, null and empty texts among them; repeated rows are judged each."""
    return quality.keep_good(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, equal rows being copies: the one of the smallest id, nulls last. Texts without words are one group."""
    return simhash.drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go from all documents but the first, and documents with nothing left; n_chars follows the text. Null and empty texts stay."""
    return substring.drop_repeated_passages(docs, chars="n_chars")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences; repeated rows are packed each, null texts as empty ones."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", simhash_near_dedup),
    ("substring dedup", substring_dedup),
    ("best-fit packing", best_fit_packing),
]

#: SimHash components and best-fit packing can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents; each stage's tables go when the next one has been written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        path = scratch(spark, f"stage{k}")
        with tidy(spark):
            docs = materialise(stage(spark, docs, sf_dir), f"stage{k}", path, lasting=True)
        if last:
            clean(spark, last)
        last = path
    return docs
