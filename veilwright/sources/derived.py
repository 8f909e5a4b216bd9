"""Relations the test tables do not hold, derived from them by plain projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwright.sources.planted import planted_texts
from veilwright.sources.tables import read_table, read_texts, spread


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Documents, and one planted text per customer."""
    texts = planted_texts()
    listed = F.array(*[F.lit(t) for t in texts])
    planted = spread(read_table(spark, sf, "customer").select("c_custkey", "c_mktsegment")).select(
        (F.lit(10000000) + F.col("c_custkey")).alias("id"),
        F.concat(
            F.replace(F.element_at(listed, (F.col("c_custkey") % len(texts) + 1).cast("int")), F.lit("¶"), F.lit("\n")),
            F.lit(" ("),
            F.col("c_mktsegment"),
            F.lit(")"),
        ).alias("text"),
    )
    return read_texts(spark, sf, "documents", "doc_id", "text").unionByName(planted)
