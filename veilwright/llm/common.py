"""What the corpus operators share: Arrow maps over whole texts, words, and a table's own row order."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of text that one call of a map function gets at most, one text aside.
PIECE_BYTES = 4 << 20

#: Lower-cases A-Z, keeps 0-9, a-z and every byte of non-ASCII letters, and blanks the rest.
WORD_BYTES = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def word_list(text: bytes | None) -> list[bytes]:
    """Lower-case runs of ASCII letters, digits and non-ASCII characters; none of a null text."""
    return text.translate(WORD_BYTES).split() if text else []


def fresh(df: DataFrame, name: str) -> str:
    """``name``, made longer until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def kept_names(keep: list[str], results: list[str]) -> dict[str, str]:
    """What each kept column is called beside ``results``: its own name, or, where a result has that, with ``_`` at the end."""
    names: dict[str, str] = {}
    taken = {r.lower() for r in results} | {k.lower() for k in keep}
    for k in keep:
        name = k
        if k.lower() in {r.lower() for r in results}:
            while name.lower() in taken:
                name += "_"
            taken.add(name.lower())
        names[k] = name
    return names


def kept_columns(keep: list[str], results: list[str]) -> list[Column]:
    return [column(k).alias(name) for k, name in kept_names(keep, results).items()]


def column(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def pieces(batch: pa.RecordBatch, at: int, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts (column ``at``) add up to ``limit`` bytes at most, or hold one text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()
    begin = total = 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > limit:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += size
    if len(sizes) > begin:
        yield batch.slice(begin)


def map_texts(df: DataFrame, text: str, keep: list[str], fields: str, setup: Callable[[], Callable[..., Any]], extra: tuple[str, ...] = (), limit: int = PIECE_BYTES) -> DataFrame:
    """``keep`` columns of each row, and new ``fields`` (DDL) computed from its text.

    A kept column with the name of a field gets ``_`` at the end of its own.

    ``setup()`` runs once in a task and gives a function from a list of texts (bytes, null as None),
    and lists of the ``extra`` columns, to ``(mask, columns)``: the rows to keep (None: all) and one
    list or array per field.
    """
    names = [fresh(df, n) for n in (*(f"arg_{i}" for i in range(len(extra))), "text_of_map")]
    added = T.StructType.fromDDL(fields) if fields else T.StructType()
    kept = kept_columns(keep, [f.name for f in added])
    source = df.select(*kept, *[column(c).alias(n) for c, n in zip((*extra, text), names, strict=True)])
    schema = T.StructType([source.schema[i] for i in range(len(keep))] + added.fields)
    types = to_arrow_schema(added)
    first, last = len(keep), len(keep) + len(extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = setup()
        for batch in batches:
            for part in pieces(batch, last, limit):
                texts = part.column(last).cast(pa.binary()).to_pylist()
                mask, columns = scan(texts, *[part.column(i).to_pylist() for i in range(first, last)])
                made = [pa.array(c, type=f.type) for c, f in zip(columns, types, strict=True)]
                own = [part.column(i) for i in range(first)]
                out = pa.RecordBatch.from_arrays([*own, *made], names=[f.name for f in schema])
                yield out if mask is None else out.filter(pa.array(mask, type=pa.bool_()))

    return source.mapInArrow(run, schema)
