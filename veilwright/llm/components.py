"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwright.sources.scratch import written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours on the least of them: the greater ones (large) or the lesser ones and the node itself."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    hung = both.join(least, "u")
    if large:
        out = hung.where("v > u").select("m", "v")
    else:
        out = hung.select("m", "v").unionByName(least.select("m", F.col("u").alias("v")))
    return out.where("m <> v").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` of every node that has a link; the root is the least node of its component.

    ``links`` has columns ``a`` and ``b``. Each round is written to the shared folder, so a lost
    executor costs one round at most. No group is gathered: both stars are minima and joins.
    """

    def digest(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = links.where("a <> b")
    before = None
    while True:
        now = written(_star(_star(now, True), False), "components")
        after = digest(now)
        if after == before:
            break
        before = after
    nodes = now.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return nodes.unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct()
