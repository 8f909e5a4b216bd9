"""Reading text tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for a heavy map over a small input.

    A table of many files arrives in many partitions and stays as it is; only an input that would
    leave cores idle is dealt out anew.  ``df`` must be a plain scan, so that asking it for its
    partitions starts no job.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def read_texts(spark: SparkSession, folder: str, name: str, id_col: str, text_col: str) -> DataFrame:
    """``(id, text)`` of a table; the other columns are not read."""
    return spread(read_table(spark, folder, name).selectExpr(f"{id_col} AS id", f"{text_col} AS text"))
