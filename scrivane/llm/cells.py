"""Candidate buckets, cut into cells of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivane.llm.common import materialise, small


def bucket_cells(members: DataFrame, key: str, member: str, limit: int) -> DataFrame:
    """(key, lo, hi, side, member): every two members of a bucket meet in exactly one cell. key and member are longs.

    A bucket of n members is dealt into s = ceil(n / limit) shards. Cell (i, i) holds shard i; cell (i, j) holds shard
    i as side 0 and shard j as side 1, to be compared across only. So no task sees more than two shards at once,
    whatever the bucket's size, and no pair is emitted. Buckets of one member are dropped; of buckets that hold the same
    members (told by their number and 96 bits of hashes) one is kept, as near copies share most of their keys. Counts
    and hashes are aggregated before they are shuffled. members has no repeats within a bucket.
    """
    sizes = materialise(members.groupBy(key).agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    shared = materialise(members.join(small(sizes), key).select(key, member, "n"), "shared")
    marks = [F.bit_xor(F.xxhash64(member)).alias("x"), F.sum(F.xxhash64(member, F.lit(1)).bitwiseAND(F.lit(2**32 - 1))).alias("y")]
    kept = materialise(shared.groupBy(key, "n").agg(*marks).groupBy("n", "x", "y").agg(F.min(key).alias(key)).select(key), "buckets")
    shards = F.ceil(F.col("n") / limit).cast("int")
    dealt = shared.join(small(kept), key).select(key, member, shards.alias("s"), F.pmod(F.xxhash64(member), shards).cast("int").alias("i"))
    each = dealt.select(key, member, "i", F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("j"))
    lo, hi = F.least("i", "j").cast("long"), F.greatest("i", "j").cast("long")
    return each.select(key, lo.alias("lo"), hi.alias("hi"), (F.col("i") > F.col("j")).cast("int").alias("side"), member)


def dealt_cells(cells: DataFrame, key: str, *order: str) -> DataFrame:
    """Each cell whole and sorted in one task."""
    return cells.repartition(key, "lo", "hi").sortWithinPartitions(key, "lo", "hi", *order)
