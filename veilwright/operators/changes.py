"""Entities as the fold of a log of changes, now or at any time before.

A change names an entity and sets some of its fields; what it does not set is null in its row. The state
of an entity has, field by field, what was written last. A change counts from the moment the entity was
made: one to an entity that is not there does nothing, and of two rows that make the same entity the
first one does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwright.operators.numbering import numbered

#: The kind of change that makes an entity.
CREATE = "create"


def change(rows: DataFrame, kind: str, key: str, at: Column, fields: dict[str, Column]) -> DataFrame:
    """Changes of one kind: ``(id, change, at, fields)``."""
    return rows.select(F.col(key).alias("id"), F.lit(kind).alias("change"), at.alias("at"), *[c.alias(n) for n, c in fields.items()])


def log(*parts: DataFrame) -> DataFrame:
    """Several kinds of changes as one log; a field that a kind does not have is null in its rows."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def fold(changes: DataFrame, fields: list[str], as_of: Column | None = None, counts: dict[str, str] | None = None, tie: str = "change") -> DataFrame:
    """``(id, created_at, fields)`` of every entity that has been made, as of a time (included).

    ``changes`` has ``id, change, at`` and the fields; of changes at one time the greater ``tie`` is the
    later one. ``counts`` names columns that count the changes of a kind. Changes without a time, and
    those of null ids, are left out. Both steps combine on the map side, so an entity with a third of
    all changes is no burden.
    """
    seen = changes.where("id IS NOT NULL AND at IS NOT NULL")
    seen = seen.where(F.col("at") <= as_of) if as_of is not None else seen
    made = seen.where(F.col("change") == CREATE).groupBy("id").agg(F.min("at").alias("created_at"))
    live = seen.join(made, "id").where(F.col("at") >= F.col("created_at"))
    # A second row that makes the entity is none of its changes.
    live = live.where((F.col("change") != CREATE) | (F.col("at") == F.col("created_at")))
    rank = F.struct(F.col("change") != CREATE, "at", tie)
    last = [F.max_by(f, F.when(F.col(f).isNotNull(), rank)).alias(f) for f in fields]
    counted = [F.count_if(F.col("change") == kind).alias(name) for name, kind in (counts or {}).items()]
    return live.groupBy("id").agg(F.first("created_at").alias("created_at"), *last, *counted)


def listed(entities: DataFrame, group: str, order: list[str | Column], name: str = "place") -> DataFrame:
    """``entities`` with their place (from 1) in the list of their group."""
    return numbered(entities, group, order, name).withColumn(name, F.col(name) + 1)
