"""Parquet tables by folder and name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Tables below this size often are one row group, which a single task reads.
SMALL = 20 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder; the rows of a small one of few files are dealt over all cores.

    Larger tables have row groups enough and are never shuffled here.
    """
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if (1 << 20) < size < SMALL and len(df.inputFiles()) < cores else df
