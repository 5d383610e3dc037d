"""Connected components by alternating large and small stars, on DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivane.llm.common import clean, materialise, scratch, tidy


def _large(edges: DataFrame) -> DataFrame:
    """Each node hangs its larger neighbours onto its smallest neighbour (or itself)."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(materialise(least, "least"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """Each node hangs its smaller neighbours and itself onto the smallest of them."""
    least = materialise(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node that has an edge; label is the smallest node it can reach.

    edges: two columns of one orderable type; direction, loops, repeats and nulls don't matter. Rounds grow with the
    logarithm of the components' size; each is written to the shared folder, and only its count and checksum reach
    the driver. Minima are aggregated before the shuffle and written, so that the joins on hot nodes are ones that Spark can split.
    """
    a, b = edges.columns
    now = edges.where(f"`{a}` <> `{b}`").select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    spark, path, before = edges.sparkSession, scratch(edges.sparkSession, "edges"), None
    now = materialise(now, "edges", path)
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == before:
            break
        before, old, path = mark, path, scratch(spark, "edges")
        with tidy(spark):
            larger = materialise(_large(now).distinct(), "larger")
            now = materialise(_small(larger).distinct(), "edges", path, lasting=True)
        clean(spark, old)  # a round has been written whole; nothing reads the one before it
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select(F.col("b"), F.col("b")).distinct())
