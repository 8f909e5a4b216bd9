"""Equal texts share one scan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def text_hash(column: str = "text") -> Column:
    """Key of equal texts; a missing text has one as well."""
    return F.coalesce(F.sha2(F.col(column), 256), F.lit(""))


def distinct_texts(texts: DataFrame, text: str = "text") -> DataFrame:
    """One row per text: hash, the text, number of copies.

    The aggregate combines on the map side, so a text with very many copies travels once per task.
    """
    return texts.groupBy(text_hash(text).alias("hash")).agg(F.first(text).alias(text), F.count("*").alias("copies"))


def scan_distinct(
    texts: DataFrame,
    job: Callable[[DataFrame], DataFrame],
    id_col: str = "id",
    text: str = "text",
) -> DataFrame:
    """Run the job once per distinct text and join its result back to every row.

    The rows that come back carry ids and hashes only. A text with very many copies makes one large
    partition of them, against one row of results: adaptive execution splits it.
    """
    done = job(distinct_texts(texts, text).select("hash", text)).select("hash", "redacted_text", "findings", "applied", "layers")
    return texts.select(id_col, text_hash(text).alias("hash")).join(done, "hash").drop("hash")


def cache_stats(texts: DataFrame, text: str = "text") -> DataFrame:
    """What an unbounded result cache would have seen: hits, misses, size, hit rate in percent."""
    copies = texts.groupBy(text_hash(text).alias("hash")).agg(F.count("*").alias("n"))
    totals = copies.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("misses")
    )
    return totals.select(
        (F.col("total") - F.col("misses")).alias("hits"),
        "misses",
        F.col("misses").alias("size"),
        F.when(F.col("total") > 0, F.floor(100 * (F.col("total") - F.col("misses")) / F.col("total") + 0.5))
        .otherwise(0)
        .cast("bigint")
        .alias("hit_rate"),
    )


def hot_texts(texts: DataFrame, seen: str, n: int, text: str = "text") -> DataFrame:
    """The n texts used last."""
    return (
        texts.groupBy(text_hash(text).alias("hash"))
        .agg(F.max(seen).alias("last_seen"), F.count("*").alias("uses"))
        .orderBy(F.desc("last_seen"), "hash")
        .limit(n)
    )
