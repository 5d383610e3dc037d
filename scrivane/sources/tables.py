"""Parquet tables whose rows are to be encoded one by one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Smaller tables aren't worth a shuffle.
LEAST_BYTES = 1 << 20


def read_table(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """A table, dealt out by keys if its files yield fewer partitions than there are cores (a file of one row group is one task).

    Large tables have partitions enough and stay where they are; columns and filters are still pushed into the scan.
    """
    df = spark.read.parquet(path)
    run = df._jdf.queryExecution()
    cores = spark.sparkContext.defaultParallelism
    if int(str(run.optimizedPlan().stats().sizeInBytes())) < LEAST_BYTES or run.toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)
