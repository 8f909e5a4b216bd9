"""Contiguous shards of nearly equal bytes, from global prefix sums.

Rows are put in the order of the id by a range exchange, and only their keys and sizes travel. Bytes
are summed for each part of that exchange; a running sum over those few totals gives each part its
first byte, and a running sum inside the part gives each row its own. A row belongs to the shard in
whose equal share of all bytes its middle lies.

A third of the rows may share one id: the range is over the id, then a checksum of the text, then the
row's place in the input, so such a group is cut like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilwright.llm.common import column, fresh, kept_columns, kept_names
from veilwright.sources.scratch import written

#: Bytes a row takes besides its text.
ROW_BYTES = 8
RESULTS = ("size", "text_crc32", "shard", "slot")


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")


def crc_of(text: Column) -> Column:
    """Unsigned CRC-32 of the text's UTF-8; of no bytes for a null text."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def shard(docs: DataFrame, shards: int, keep: list[str], order: str = "doc_id", text: str = "text") -> DataFrame:
    """``keep`` columns with ``size, text_crc32, shard, slot``; ``slot`` counts from 0 in each shard.

    Null texts have the size of an empty one. Null ids come first. Rows with the same id are in the order
    of their checksums; rows that are alike in both may stand either way round. An empty table gives no
    rows. A kept column with the name of a result gets ``_`` at its end.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    own = kept_names(keep, list(RESULTS))
    names = {n: fresh(docs.select(*kept_columns(keep, list(RESULTS))), n) for n in ("order_key", "tie", "part", "first_byte", "first_row", "all_bytes", "row_at", "shard_row")}
    key, tie, part = (column(names[n]) for n in ("order_key", "tie", "part"))
    keyed = docs.select(
        *kept_columns(keep, list(RESULTS)), column(order).alias(names["order_key"]), F.monotonically_increasing_id().alias(names["tie"]),
        size_of(column(text)).alias("size"), crc_of(column(text)).alias("text_crc32"),
    )
    ranged = keyed.repartitionByRange(key, F.col("text_crc32"), tie).withColumn(names["part"], F.spark_partition_id())
    ranged = written(ranged, "sharding-ranges")  # the parts stay what they are from here on

    totals = ranged.groupBy(part).agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    bases = totals.select(
        part, F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias(names["first_byte"]), F.coalesce(F.sum("n").over(before), F.lit(0)).alias(names["first_row"]),
        F.sum("bytes").over(Window.partitionBy()).alias(names["all_bytes"]),
    )
    inside = Window.partitionBy(part).orderBy(key, "text_crc32", tie).rowsBetween(Window.unboundedPreceding, -1)
    based = ranged.join(F.broadcast(bases), names["part"])  # bounded by the number of parts
    begin = column(names["first_byte"]) + F.coalesce(F.sum("size").over(inside), F.lit(0))
    row = column(names["first_row"]) + F.count("*").over(inside)
    placed = based.withColumns({names["first_byte"]: begin, names["row_at"]: row})
    at = F.expr(f"(2 * `{names['first_byte']}` + size) * {int(shards)}L div (2 * `{names['all_bytes']}`)")  # whole numbers: nothing is rounded
    placed = placed.withColumn("shard", F.least(F.lit(shards - 1), at.cast("int")))
    firsts = placed.groupBy("shard").agg(F.min(names["row_at"]).alias(names["shard_row"]))  # one row for each shard
    out = placed.join(F.broadcast(firsts), "shard")
    return out.select(*[column(own[c]) for c in keep], "size", "text_crc32", "shard", (column(names["row_at"]) - column(names["shard_row"])).alias("slot"))


def write_shards(docs: DataFrame, shards: int, folder: str, order: str = "doc_id", text: str = "text") -> None:
    """The documents as Parquet, one folder ``shard=N`` for each shard."""
    shard(docs, shards, docs.columns, order, text).write.partitionBy("shard").parquet(folder)
