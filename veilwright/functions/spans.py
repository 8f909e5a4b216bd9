"""Array expressions over spans: offsets of matches, overlap, masking, offset maps.

A span is ``[start, end)`` in characters.  All of it happens inside one row, so no job that masks a
text needs a shuffle.  Folds run over blocks of spans: appending to one growing array would copy it
once per span, which a text with very many hits would feel.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

FINDING = (
    "struct<start:int,neg_len:int,layer_ord:int,ord:int,end:int,rule_id:string,label:string,"
    "value:string,confidence:double,layer:string>"
)
APPLIED = "struct<gap:int,start:int,end:int,label:string,value:string,mstart:int,mend:int,shift:int>"

BLOCK = 256
LONG_TEXT = 20_000


def built_once(build: Callable) -> Callable:
    """Keep the expressions a function builds.

    An expression names its columns and belongs to no table, so the same one serves every plan; the
    large ones take thousands of calls into the JVM to put together.
    """
    kept: dict = {}

    @wraps(build)
    def get(*args):
        key = (id(SparkContext._gateway), *args)
        if key not in kept:
            kept[key] = build(*args)
        return kept[key]

    return get


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Name a value inside an expression, so that it is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def settled(value: Column) -> Column:
    """The value, in a form the optimizer does not copy.

    A filter on an array column is pushed below the projection that computes it, with the expression
    written out in its place.  Here columns build on columns, so each step down would double the plan.
    An expression that depends on the partition stays where it is.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def empty(element: str) -> Column:
    return F.array().cast(f"array<{element}>")


def blocks(values: Column, size: int = BLOCK) -> Column:
    """The array cut into consecutive arrays of at most ``size`` elements (no array when empty)."""
    count = F.ceil(F.size(values) / F.lit(size)).cast("int")
    return F.when(F.size(values) <= size, F.array(values)).otherwise(
        F.transform(F.sequence(F.lit(0), count - 1), lambda b: F.slice(values, b * size + 1, F.lit(size)))
    )


def running_total(values: Column) -> Column:
    """Inclusive prefix sums of an int array."""

    def in_block(block: Column, first: Column) -> Column:
        return F.aggregate(
            block,
            F.struct(first.alias("t"), empty("int").alias("out")),
            lambda a, x: F.struct((a.t + x).alias("t"), F.concat(a.out, F.array(a.t + x)).alias("out")),
            lambda a: a.out,
        )

    def over(parts: Column) -> Column:
        heads = F.aggregate(
            parts,
            F.struct(F.lit(0).alias("t"), empty("int").alias("out")),
            lambda a, p: F.struct(
                (a.t + F.aggregate(p, F.lit(0), lambda s, x: s + x)).alias("t"),
                F.concat(a.out, F.array(a.t)).alias("out"),
            ),
            lambda a: a.out,
        )
        return F.flatten(F.zip_with(parts, heads, in_block))

    return let(values, lambda v: let(blocks(v), over))


def match_starts(text: Column, regex: Column, matches: Column) -> Column:
    """Start of each match, from the pieces between the matches.

    Piece k and match k - 1 lie before match k; one more entry than matches, the last is the length.
    """
    gaps = F.transform(F.split(text, regex, -1), lambda g: F.length(g))
    before = F.concat(F.array(F.lit(0)), F.transform(matches, lambda m: F.length(m)))
    return running_total(F.zip_with(gaps, before, lambda g, m: g + m))


def wide_form(text: Column) -> Column:
    """Fixed-width copy of a long text, so that cutting a piece does not walk the text from its start."""
    return F.when(F.length(text) > LONG_TEXT, F.encode(text, "UTF-32"))


def piece(text: Column, wide: Column, start: Column, length: Column) -> Column:
    """``length`` characters of the text from position ``start``."""
    direct = F.substring(text, start + 1, length)
    space = F.lit(b"\x00\x00\x00\x20")
    cut = F.concat(space, F.substring(wide, start * 4 + 1, length * 4))
    return F.when(wide.isNull(), direct).otherwise(F.substring(F.decode(cut, "UTF-32"), F.lit(2), length))


def in_order(spans: Column) -> Column:
    """Start, longest first, layer, pattern: the natural order of the fields of a finding."""
    return F.sort_array(spans)


def _fold(spans: Column, state: Column, element: str, step: Callable[[Column, Column], Column]) -> Column:
    """Blockwise fold.  ``step(state, span)`` gives ``struct(state, kept array)``."""

    def block_fold(acc: Column, block: Column) -> Column:
        done = F.aggregate(
            block,
            F.struct(acc.state.alias("state"), empty(element).alias("out")),
            lambda a, x: let(
                step(a.state, x),
                lambda r: F.struct(r.state.alias("state"), F.concat(a.out, r.kept).alias("out")),
            ),
        )
        return let(
            done,
            lambda d: F.struct(d.state.alias("state"), F.concat(acc.out, F.array(d.out)).alias("out")),
        )

    whole = F.aggregate(
        blocks(spans),
        F.struct(state.alias("state"), empty(f"array<{element}>").alias("out")),
        block_fold,
        lambda a: F.flatten(a.out),
    )
    return F.when(F.size(spans) > 0, whole).otherwise(empty(element))


def maximal(spans: Column) -> Column:
    """Ordered spans without those that lie inside an earlier one."""

    def step(reach: Column, x: Column) -> Column:
        keep = x.end > reach
        return F.struct(
            F.when(keep, x.end).otherwise(reach).alias("state"),
            F.when(keep, F.array(x)).otherwise(empty(FINDING)).alias("kept"),
        )

    return _fold(spans, F.lit(-1), FINDING, step)


def applied(spans: Column, drop_contained: bool = True) -> Column:
    """Ordered spans that a mask replaces: each starts at or after the end of the last accepted one.

    With ``drop_contained`` a span inside an earlier one is no candidate even when that earlier one
    was itself refused.  Each result knows where the clear text before it begins (``gap``) and where
    its placeholder stands in the masked text.
    """

    def step(s: Column, x: Column) -> Column:
        candidate = (x.end > s.reach) if drop_contained else F.lit(True)
        accept = candidate & (x.start >= s.last)
        growth = F.length(x.label) + 11 - (x.end - x.start)
        entry = F.struct(
            s.last.alias("gap"),
            x.start.alias("start"),
            x.end.alias("end"),
            x.label.alias("label"),
            x.value.alias("value"),
            (x.start + s.shift).alias("mstart"),
            (x.start + s.shift + F.length(x.label) + 11).alias("mend"),
            (s.shift + growth).alias("shift"),
        )
        return F.struct(
            F.struct(
                F.greatest(s.reach, x.end).alias("reach"),
                F.when(accept, x.end).otherwise(s.last).alias("last"),
                F.when(accept, s.shift + growth).otherwise(s.shift).alias("shift"),
            ).alias("state"),
            F.when(accept, F.array(entry)).otherwise(empty(APPLIED)).alias("kept"),
        )

    start = F.struct(F.lit(-1).alias("reach"), F.lit(0).alias("last"), F.lit(0).alias("shift"))
    return _fold(spans, start, APPLIED, step)


def rewrite(
    text: Column,
    wide: Column,
    marks: Column,
    replace: Callable[[Column], Column],
    clear: Callable[[Column], Column] = lambda c: c,
) -> Column:
    """The text with each applied span replaced; ``clear`` treats the stretches between them."""
    parts = F.transform(
        marks, lambda m: F.concat(clear(piece(text, wide, m.gap, m.start - m.gap)), replace(m))
    )
    tail = F.element_at(marks, -1).end
    return F.when(
        F.size(marks) > 0,
        F.concat(F.array_join(parts, ""), clear(piece(text, wide, tail, F.length(text) - tail))),
    ).otherwise(clear(text))


def placeholder(label: Column) -> Column:
    return F.concat(F.lit("[REDACTED-"), label, F.lit("]"))


def mask(text: Column, wide: Column, marks: Column) -> Column:
    return rewrite(text, wide, marks, lambda m: placeholder(m.label))


def original_position(position: Column, marks: Column) -> Column:
    """Position in the original text of a position in the masked text.

    A position inside a placeholder belongs to the start of what it replaced.
    """
    inside = F.get(F.filter(marks, lambda m: (m.mstart < position) & (position < m.mend)), F.lit(0))
    shift = F.aggregate(
        marks, F.lit(0), lambda s, m: F.when(m.mend <= position, m.shift).otherwise(s)
    )
    return F.coalesce(inside.start, position - shift)
