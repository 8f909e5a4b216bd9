"""Joined digests of groups of any size; row numbers within them are in ``operators.numbering``.

A group may hold a third of all rows, so none is gathered. Rows are put in order by a range exchange
over the group and the order, which cuts a large group like any other run of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from veilwright.llm.common import column
from veilwright.operators.numbering import numbered
from veilwright.sources.scratch import written

__all__ = ["joined_digests", "numbered"]

#: Bytes of the pieces in which a group that is cut by the exchange travels to its digest.
CHUNK_BYTES = 16 << 10
#: Bytes of a group that a task holds back until it knows whether the group ends there.
HELD_BYTES = 1 << 20


def joined_digests(df: DataFrame, group: str, order: list[str], piece: str, separator: str, name: str = "sha256") -> DataFrame:
    """``(group, name)``: lower-case SHA-256 of the group's pieces (strings, null: empty), in ``order``, joined by ``separator``.

    A group that lies within one part of the range exchange is hashed there. Of one that is cut, short
    chunks of joined pieces go to one task, which hashes them as they stream by: SHA-256 has no other
    way, but neither that task nor any other holds the group.
    """
    rows = df.select(column(group).alias("key"), *[column(c).alias(f"order_{i}") for i, c in enumerate(order)], F.coalesce(column(piece), F.lit("")).alias("piece"), F.monotonically_increasing_id().alias("tie"))
    keys = ["key", *[f"order_{i}" for i in range(len(order))], "tie"]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("key", "piece")
    between = separator.encode()
    schema = T.StructType([T.StructField("key", ranged.schema["key"].dataType), *T.StructType.fromDDL("part int, at long, chunk binary, ends boolean, sha string").fields])
    fields = to_arrow_schema(schema)

    def batch_of(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
        columns = [pa.array([r[i] for r in rows], fields.field(n).type) for i, n in enumerate(names)]
        rows.clear()
        return pa.RecordBatch.from_arrays(columns, names=names)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        out: list[tuple] = []
        held, at = bytearray(), 0  # of the group at hand

        def chunks(key, everything: bool) -> None:
            nonlocal at
            while len(held) > CHUNK_BYTES or everything and held:
                out.append((key, part, at, bytes(held[:CHUNK_BYTES]), False, None))
                del held[:CHUNK_BYTES]
                at += 1

        def close(key, cut: bool) -> None:
            nonlocal at
            if cut:
                chunks(key, True)
                out.append((key, part, at, b"", True, None))
            else:
                out.append((key, part, 0, None, True, hashlib.sha256(held).hexdigest()))
            held.clear()
            at = 0

        now, cut, begun = None, True, False
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if begun and key == now:
                    held.extend(between)
                else:
                    if begun:
                        close(now, cut)
                    now, cut, begun = key, not begun, True  # the first group may have begun in the part before
                held.extend(text)
                if len(held) > HELD_BYTES:
                    cut = True
                    chunks(now, False)
                if len(out) >= 1000:
                    yield batch_of(out, fields.names)
        if begun:
            close(now, True)  # and the last one may go on in the next
        yield batch_of(out, fields.names)

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        now, begun, state, owed = None, False, hashlib.sha256(), b""
        for batch in batches:
            for key, chunk, ends in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                if not begun or key != now:
                    if begun:
                        done.append((now, state.hexdigest()))
                    now, begun, state, owed = key, True, hashlib.sha256(), b""
                state.update(owed + chunk)
                owed = between if ends else b""  # stands before the run of the next part, if there is one
                if len(done) >= 1000:
                    yield batch_of(done, ["key", "sha"])
        if begun:
            done.append((now, state.hexdigest()))
        yield batch_of(done, ["key", "sha"])

    runs = written(ranged.mapInArrow(join, schema), "digests")
    cut = runs.where("sha IS NULL").repartition("key").sortWithinPartitions("key", "part", "at").select("key", "chunk", "ends")
    late = cut.mapInArrow(chain, T.StructType([schema["key"], schema["sha"]]))
    return runs.where("sha IS NOT NULL").select("key", "sha").unionByName(late).toDF(group, name)
