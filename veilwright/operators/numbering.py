"""Row numbers within groups of any size.

A group may hold a third of all rows, and all of them may have one time, so no group and no stretch of
time is ranked in one task. Rows are put in order by a range exchange over the group and the order, which
cuts a large group like any other run of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilwright.sources.scratch import written


def _own(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def numbered(df: DataFrame, group: str, order: list[str | Column], name: str) -> DataFrame:
    """``df`` with ``name`` (long): the row's place in its group, from 0, in ``order`` (names ascending, nulls first).

    Rows alike in ``order`` stand either way round. Null is a group of its own. Inside a part of the
    exchange a window counts; only the first group of a part can have begun in parts before, so what is
    broadcast to start the counts is one row for each part at most.
    """
    taken = {c.lower() for c in df.columns}

    def fresh(own: str) -> str:
        while own.lower() in taken:
            own += "_"
        return own

    part, tie, size, first = (fresh(n) for n in ("part", "tie", "n_in_part", "first_row"))
    keys = [c if isinstance(c, Column) else _own(c) for c in order] + [_own(tie)]
    ranged = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(_own(group), *keys).withColumn(part, F.spark_partition_id())
    ranged = written(ranged, "numbered")  # the parts stay what they are from here on
    counts = ranged.groupBy(part, group).agg(F.count("*").alias(size))
    # Both ends of a part, so that a group over many parts is there with each of its counts.
    key = F.struct(_own(group))
    ends = counts.groupBy(part).agg(F.min_by(F.struct(group, size), key).alias("low"), F.max_by(F.struct(group, size), key).alias("high"))
    edges = ends.select(part, F.explode(F.array_distinct(F.array("low", "high"))).alias("edge")).select(part, f"edge.{group}", f"edge.{size}")
    before = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    bases = edges.withColumn(first, F.sum(size).over(before)).where(_own(first) > 0).select(_own(part).alias(part + "_"), _own(group).alias(group + "_"), first)
    inside = Window.partitionBy(part, group).orderBy(*keys)
    at_part = (_own(part) == _own(part + "_")) & _own(group).eqNullSafe(_own(group + "_"))
    placed = ranged.join(F.broadcast(bases), at_part, "left")  # one row for each part at most
    row = F.row_number().over(inside) - 1 + F.coalesce(_own(first), F.lit(0))
    return placed.select(*map(_own, df.columns), row.cast("long").alias(name))
