"""Conversation repair: the cheapest edits that give ``(s?(ua)+)?``, by weighted parsing over spans.

The grammar is in Chomsky normal form. Its nonterminals ``p>q`` are the pairs of states of the automaton
of the wanted role sequence, and its rules are ``p>q -> p>r r>q``; a row alone derives ``p>p`` when it is
deleted and ``p>q`` when it is kept or given another role; insertions close every cell, as they derive
``p>q`` from no row. A cell has for each nonterminal the least ``(cost, audit)``. Cells are combined
bottom-up by span length: rows, then spans of 2, 4, 8.. rows within a block, then runs of blocks.

With such nonterminals every split of a span gives the same cell, so one split is enough, and the work
grows with the rows and not with their cube: among audits of one cost for one span none is the beginning
of another (they have as many insertions and one letter for each row), so the least of a whole is made
of the least of its halves. ``tests/llm/brute.py`` has the chart over all spans and all splits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from veilwright.llm.common import column
from veilwright.llm.ordering import numbered
from veilwright.sources.scratch import written

#: Rows of a block, and blocks or runs that are combined at once.
BLOCK = 256
FAN = 32

KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 1, 2, 5, 5

#: State by state, the role initial that leads on: 0 start, 1 after s, 2 after u, 3 after a (the end, as 0 is).
STEPS = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
ENDS = (0, 3)
ROLES = {"u": "user", "a": "assistant"}

Cell = dict[tuple[int, int], tuple[int, str]]

#: The cell of no row: insertions alone. No loop of them is ever cheapest.
NOTHING: Cell = {(p, p): (0, "") for p in STEPS} | {(0, 2): (INSERT, "I"), (1, 2): (INSERT, "I"), (3, 2): (INSERT, "I"), (2, 3): (INSERT, "I"), (0, 3): (2 * INSERT, "II"), (1, 3): (2 * INSERT, "II")}


def combine(left: Cell, right: Cell) -> Cell:
    """The cell of two spans that stand side by side."""
    out: Cell = {}
    for (p, r), (cost, audit) in left.items():
        for q in STEPS:
            if (r, q) in right:
                more, rest = right[r, q]
                found = (cost + more, audit + rest)
                if (p, q) not in out or found < out[p, q]:
                    out[p, q] = found
    return out


def row_cell(code: str) -> Cell:
    """A row after its insertions. ``d`` can only be deleted; others are the role's initial (``o``: any other), large if unfinished."""
    cell: Cell = {(p, p): (DELETE, "D") for p in STEPS}
    if code != "d":
        extra = UNFINISHED * code.isupper()
        for p, steps in STEPS.items():
            for initial, q in steps.items():
                if initial == code.lower():
                    cell[p, q] = (KEEP + extra, "K")
                elif initial in ROLES:
                    cell[p, q] = (REROLE + extra, "R")
    return combine(NOTHING, cell)


@lru_cache(maxsize=1 << 14)
def span_cell(codes: str) -> Cell:
    """The cell of a run of rows of one block."""
    if len(codes) == 1:
        return row_cell(codes)
    half = 1 << ((len(codes) - 1).bit_length() - 1)
    return combine(span_cell(codes[:half]), span_cell(codes[half:]))


def cheapest(cell: Cell) -> tuple[int, str]:
    whole = combine(cell, NOTHING)
    return min(whole[0, q] for q in ENDS if (0, q) in whole)


def applied(audit: str, codes: str, state: int) -> list[tuple[int, str, str | None, list[str]]]:
    """``(row, edit, role, roles inserted before it)`` for each row of a block; insertions at the end have the row after the last.

    ``edit`` and ``role`` are null for those at the end; ``role`` is null for a row that keeps its own or goes.
    """
    out: list[tuple[int, str | None, str | None, list[str]]] = []
    row, inserted = 0, []
    for edit in audit:
        if edit == "D":
            out.append((row, edit, None, inserted))
        else:
            kept = codes[row].lower() if edit == "K" else None
            initial = kept if kept in STEPS[state] else next(i for i in STEPS[state] if i in ROLES)
            state = STEPS[state][initial]
            if edit == "I":
                inserted = [*inserted, ROLES[initial]]
                continue
            out.append((row, edit, ROLES[initial] if edit == "R" else None, inserted))
        row, inserted = row + 1, []
    if inserted:
        out.append((row, None, None, inserted))
    return out


def spaced(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(" "))


def marked(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """``(conv_id, turn, role, text, row, fault, code)``: every row with its place and its first fault.

    Rows are in the order of turns, nulls first, then roles, then checksums of texts. A null role or text
    is one space. ``fault`` is ``blank``, ``duplicate`` (role and text stood before), ``truncated`` or null.
    """
    plain = rows.select(column(conv).alias("conv_id"), column(turn).alias("turn"), spaced(column(role)).alias("role"), spaced(column(text)).alias("text"))
    plain = plain.withColumn("sum", F.md5("text"))
    placed = written(numbered(plain, "conv_id", ["turn", "role", "sum"], "row"), "repair-rows")
    same = placed.groupBy("conv_id", "role", "sum").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    same = written(same.toDF("conv_", "role_", "sum_", "first"), "repair-repeats")  # a table by itself: a hot key can be split
    alike = F.col("conv_id").eqNullSafe(F.col("conv_")) & (F.col("role") == F.col("role_")) & (F.col("sum") == F.col("sum_"))
    seen = placed.join(same, alike, "left").drop("conv_", "role_", "sum_")
    inked = F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", " " * 5))
    fault = F.when(F.length(inked) == 0, "blank").when(F.col("row") > F.col("first"), "duplicate").when(~F.substring(inked, -1, 1).isin(".", "!", "?"), "truncated")
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    code = F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault") == "truncated", F.upper(known)).otherwise(known)
    return seen.withColumn("fault", fault).withColumn("code", code).drop("first", "sum")


CELL = "array<struct<p:int, q:int, cost:long, audit:string>>"


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A cell for each block of codes."""
    kind = pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
    for batch in batches:
        cells = [[(p, q, *best) for (p, q), best in span_cell(codes).items()] for codes in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(cells, kind)], names=["conv_id", "block", "cell"])


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One cell of a run of neighbouring cells; a run alone stays as it is."""
    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1)
            runs = row.column(2).to_pylist()[0]
            whole: Cell | None = None
            for run in runs:
                cell = {(c["p"], c["q"]): (c["cost"], c["audit"]) for c in run["cell"]}
                whole = cell if whole is None else combine(whole, cell)
            kind = row.column(2).type.value_type.field("cell").type
            yield pa.RecordBatch.from_arrays([*row.columns[:2], pa.array([[(p, q, *best) for (p, q), best in whole.items()]], kind)], names=["conv_id", "block", "cell"])


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            best = [cheapest({(c["p"], c["q"]): (c["cost"], c["audit"]) for c in cell}) for cell in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([b[0] for b in best], pa.int64()), pa.array([b[1] for b in best], pa.string())], names=["conv_id", "cost", "audit"])


def parse(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(conv_id, cost, audit)`` of each conversation of marked rows, and ``(conv_id, block, codes)`` of its blocks."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    codes = rows.groupBy("conv_id", F.expr(f"row div {BLOCK}").alias("block")).agg(F.array_sort(F.collect_list(F.struct("row", "code"))).alias("items"))
    codes = written(codes.select("conv_id", "block", F.array_join("items.code", "").alias("codes")), "repair-codes")
    cells = codes.mapInArrow(_cells, f"conv_id {kind}, block long, cell {CELL}")
    while True:
        cells = written(cells, "repair-cells")
        if not (cells.agg(F.max("block")).first()[0] or 0):
            break
        runs = cells.groupBy("conv_id", F.expr(f"block div {FAN}").alias("run")).agg(F.array_sort(F.collect_list(F.struct("block", "cell"))).alias("runs"))
        cells = runs.mapInArrow(_combined, f"conv_id {kind}, block long, cell {CELL}")
    return written(cells.select("conv_id", "cell").mapInArrow(_ended, f"conv_id {kind}, cost long, audit string"), "repair-audits"), codes


def edits_of(audits: DataFrame, codes: DataFrame) -> DataFrame:
    """``(conv_id, row, edit, new_role, inserted)`` for each row, by the audit of its conversation."""
    kind = codes.schema["conv_id"].dataType.simpleString()
    # The row that may be a leading s: first to be kept, nothing inserted before it.
    lead = F.length(F.regexp_extract("audit", "^(D*)K", 1))
    parts = audits.select("conv_id", F.when(F.col("audit").rlike("^D*K"), lead).alias("lead"), F.posexplode(F.regexp_extract_all("audit", F.lit(f"((?:I*[DKR]){{1,{BLOCK}}}(?:I+$)?)"), 1)).alias("block", "part"))
    b = codes.select(F.col("conv_id").alias("conv_"), F.col("block").alias("block_"), "codes")
    both = parts.join(b, F.col("conv_id").eqNullSafe(F.col("conv_")) & (F.col("block") == F.col("block_")))
    is_s = F.when(F.expr(f"lead div {BLOCK}") == F.col("block"), F.lower(F.substr("codes", (F.col("lead") % BLOCK + 1).cast("int"), F.lit(1))) == "s").otherwise(False)
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    outs = F.coalesce(F.sum(F.length(F.translate("part", "D", ""))).over(before), F.lit(0))
    led = F.coalesce(F.max(is_s.cast("int")).over(before), F.lit(0))
    both = both.withColumns({"outs": outs, "led": led})
    state = F.when(F.col("outs") == 0, 0).when(F.col("outs") == F.col("led"), 1).when((F.col("outs") - F.col("led")) % 2 == 1, 2).otherwise(3)
    schema = T.StructType([codes.schema["conv_id"], *T.StructType.fromDDL("row long, edit string, new_role string, inserted array<string>").fields])

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lru_cache(maxsize=1 << 12)(applied)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                lists = [made(*x) for x in zip(*[part.column(i).to_pylist() for i in (2, 3, 4)], strict=True)]
                index = pa.array([i for i, rows in enumerate(lists) for _ in rows], pa.int64())
                flat = [(block * BLOCK + r[0], *r[1:]) for block, rows in zip(part.column(1).to_pylist(), lists, strict=True) for r in rows]
                columns = [pa.array([f[i] for f in flat], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.list_(pa.string())))]
                yield pa.RecordBatch.from_arrays([part.column(0).take(index), *columns], names=schema.names)

    return both.select("conv_id", F.col("block").cast("long"), "part", "codes", state.alias("state")).mapInArrow(expand, schema)


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Audits, edits and repaired rows of all conversations.

    * ``(conv_id, cost, audit)``: the cheapest edits, K(eep), R(erole), D(elete) and I(nsert), in order;
      among those of one cost the least in ASCII;
    * ``(conv_id, turn, role, text, row, fault, code, edit, new_role)``: what becomes of each row;
    * ``(conv_id, row, step, role, text)``: the rows of the repaired conversation in order of (row, step),
      inserted ones with an empty text.

    Blank and repeated rows (same role and text before) must go; a truncated row that stays costs 5 more.
    Null ids are one conversation; a null role or text is one space; rows that are alike but for their id
    stand side by side, and all but one of them go as repeated. An empty table gives three empty tables;
    extra columns are not read. No conversation is held by a task: rows are numbered by ranges, parsed in
    blocks, and take their edits from the part of the audit that belongs to their block.
    """
    known = written(marked(rows, conv, turn, role, text), "repair-marked")
    audits, codes = parse(known)
    edits = edits_of(audits, codes).toDF("conv_", "row_", "edit", "new_role", "inserted")
    edited = written(edits.join(known, F.col("conv_").eqNullSafe(F.col("conv_id")) & (F.col("row_") == F.col("row")), "left"), "repair-edits")
    empty = F.lit("")
    own = F.when(F.col("edit").isin("K", "R"), F.array(F.struct(F.coalesce("new_role", "role").alias("role"), F.col("text").alias("text")))).otherwise(F.array().cast("array<struct<role:string,text:string>>"))
    added = F.transform("inserted", lambda r: F.struct(r.alias("role"), empty.alias("text")))
    lines = edited.select(F.col("conv_").alias("conv_id"), F.col("row_").alias("row"), F.posexplode(F.concat(added, own)).alias("step", "line"))
    return audits, edited.where("edit IS NOT NULL").select(*known.columns, "edit", "new_role"), lines.select("conv_id", "row", "step", "line.role", "line.text")
