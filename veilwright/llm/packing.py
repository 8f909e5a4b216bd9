"""Best-two-fit packing of token sequences.

Only lengths decide how documents fit together, and a length is at most the size of a sequence. So the
job counts the pieces of each length (4096 counts at most, whatever the corpus), packs the counts, and
deals the pieces of each length to the places that the plan has for that length. A bin is filled
greedily: the longest piece left, then the longest that fits, and so on. Then its smallest piece is
replaced by the two unpacked pieces that fit the gap, widened by it, most tightly, if they fill more
of it. A bin's pattern is used again as long as the counts allow, which is what packing bin by bin
would do; that keeps the plan to some thousands of lines.

Tokenizing and dealing are maps. Pieces of a length are numbered by counts for each (part, length), so
a length that a third of the pieces share is not gathered anywhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from veilwright.llm.common import column, fresh, kept_columns, kept_names, pieces
from veilwright.llm.tokens import END, chunks_of, crc, tokenizer_text, vocabulary_path
from veilwright.sources.scratch import written

SIZE = 4096


def _fill(lengths: np.ndarray, counts: np.ndarray, gap: int, taken: dict[int, int]) -> int:
    """Add the longest pieces that fit, until none does; the gap that is left."""
    while gap:
        i = int(np.searchsorted(lengths, gap, "right")) - 1
        while i >= 0 and counts[i] - taken.get(i, 0) <= 0:
            i -= 1
        if i < 0:
            break
        n = min(int(counts[i]) - taken.get(i, 0), gap // int(lengths[i]))
        taken[i] = taken.get(i, 0) + n
        gap -= n * int(lengths[i])
    return gap


def _two(lengths: np.ndarray, free: np.ndarray, room: int) -> tuple[int, int] | None:
    """Two free pieces with the greatest sum that fits the room; the more even two of several."""
    have = np.flatnonzero(free > 0)
    if not len(have):
        return None
    own = lengths[have]
    partner = np.searchsorted(own, room - own, "right") - 1
    at = np.arange(len(have))
    partner = np.minimum(partner, at)
    single = (partner == at) & (free[have] < 2)
    partner = np.where(single, partner - 1, partner)
    ok = partner >= 0
    if not ok.any():
        return None
    total = np.where(ok, own + own[np.maximum(partner, 0)], -1)
    best = int(np.argmax(total))
    return int(have[best]), int(have[partner[best]])


def plan(counts_of: dict[int, int], size: int = SIZE) -> list[tuple[int, list[tuple[int, int]]]]:
    """``(times, [(length, pieces), ...])``: patterns of bins and how often each is used."""
    lengths = np.array(sorted(k for k, n in counts_of.items() if n), np.int64)
    counts = np.array([counts_of[int(k)] for k in lengths], np.int64)
    out = []
    while len(lengths):
        top = len(lengths) - 1
        taken = {top: 1}
        gap = _fill(lengths, counts, size - int(lengths[top]), taken)
        if gap and len(taken) > 1 or gap and counts[top] > 1:
            small = min(taken)
            room = gap + int(lengths[small])
            free = counts.copy()
            for i, n in taken.items():
                free[i] -= n
            two = _two(lengths, free, room)
            if two and int(lengths[two[0]] + lengths[two[1]]) > int(lengths[small]) and sum(taken.values()) > 1:
                taken[small] -= 1
                for i in two:
                    taken[i] = taken.get(i, 0) + 1
                left = room - int(lengths[two[0]] + lengths[two[1]])
                taken = {i: n for i, n in taken.items() if n}
                _fill(lengths, counts, left, taken)
        times = min(int(counts[i]) // n for i, n in taken.items())
        out.append((times, [(int(lengths[i]), n) for i, n in sorted(taken.items(), reverse=True)]))
        for i, n in taken.items():
            counts[i] -= times * n
        if (counts == 0).any():
            lengths, counts = lengths[counts > 0], counts[counts > 0]
    return out


def places(patterns: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """For each length the places of its pieces, as rows ``(first rank, first bin, pieces in a bin, offset)``."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    first_bin = 0
    for times, pattern in patterns:
        offset = 0
        for length, n in pattern:
            rows.setdefault(length, []).append((used.get(length, 0), first_bin, n, offset))
            used[length] = used.get(length, 0) + times * n
            offset += n * length
        first_bin += times
    return {length: np.array(r, np.int64) for length, r in rows.items()}


#: Names of the results, and of what is added on the way to them.
RESULTS = ("piece", "start", "length", "ids_crc32", "ids", "part", "rank_in_part", "sequence_id", "offset", "rank", "base", "n")


def cut(docs: DataFrame, keep: list[str], text: str, size: int, tokenizer_path: str | None, with_ids: bool) -> DataFrame:
    """Pieces of every document: ``keep``, piece, start, length, ids_crc32 (and ids), and their number in this part."""
    kept = kept_columns(keep, list(RESULTS))
    source = docs.select(*kept, column(text).alias(fresh(docs.select(*kept), "text_of_map")))
    fields = "piece int, start long, length long, ids_crc32 long, part int, rank_in_part long" + (", ids binary" if with_ids else "")
    added = T.StructType.fromDDL(fields)
    schema = T.StructType([source.schema[i] for i in range(len(keep))] + added.fields)
    types = to_arrow_schema(added)
    vocabulary = docs.sparkSession.sparkContext.broadcast(tokenizer_text(tokenizer_path or vocabulary_path()))
    end = np.array([END], "<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        chunks = chunks_of(vocabulary.value)
        seen = np.zeros(size + 1, np.int64)
        for batch in batches:
            for slice_ in pieces(batch, len(keep)):
                rows: list[tuple] = []
                of = []
                for i, ids in enumerate(chunks.encode_all(slice_.column(len(keep)).cast(pa.binary()).to_pylist())):
                    ids += end
                    for k, begin in enumerate(range(0, len(ids), 4 * size)):
                        own = ids[begin : begin + 4 * size]
                        n = len(own) // 4
                        rows.append((k, begin // 4, n, crc(own), part, int(seen[n])) + ((own,) if with_ids else ()))
                        seen[n] += 1
                        of.append(i)
                held = slice_.select(range(len(keep))).take(pa.array(of, pa.int64()))
                made = [pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), types, strict=True)]
                if rows:
                    yield pa.RecordBatch.from_arrays([*held.columns, *made], names=[f.name for f in schema])

    return source.mapInArrow(run, schema)


def pack(docs: DataFrame, keep: list[str], text: str = "text", size: int = SIZE, tokenizer_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """``keep`` columns and ``piece, start, length, ids_crc32, sequence_id, offset`` for each piece of each document.

    ``with_ids`` adds the ids of the piece (little-endian unsigned 32-bit). A document's ids end with id
    1; null and empty texts are that id alone. Only a document longer than ``size`` is cut, and only its
    last piece may be shorter. Repeated rows are packed as often as they come. An empty table gives no
    rows. A kept column with the name of a result gets ``_`` at its end.
    """
    # The pieces are written once: which place a piece gets depends on its number within its part.
    cuts = written(cut(docs, keep, text, size, tokenizer_path, with_ids), "packing-pieces")
    counted = cuts.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counted.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    totals = {r.length: r.n for r in cuts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # one row for each length
    table = docs.sparkSession.sparkContext.broadcast(places(plan(totals, size)))

    ranked = cuts.join(bases, ["part", "length"]).withColumn("rank", F.col("base") + F.col("rank_in_part"))
    result = [*kept_names(keep, list(RESULTS)).values(), "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    ranked = ranked.select(*[column(c) for c in result], "rank")
    schema = T.StructType([*ranked.schema.fields[:-1], *T.StructType.fromDDL("sequence_id long, offset long").fields])

    def deal(batches):
        own = table.value
        for batch in batches:
            length = batch.column(len(keep) + 2).to_numpy()
            rank = batch.column(batch.num_columns - 1).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length).tolist():
                at = np.flatnonzero(length == n)
                rows = own[n]
                row = rows[np.searchsorted(rows[:, 0], rank[at], "right") - 1]
                step = rank[at] - row[:, 0]
                sequence[at] = row[:, 1] + step // row[:, 2]
                offset[at] = row[:, 3] + step % row[:, 2] * n
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=[f.name for f in schema])

    return ranked.mapInArrow(deal, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """The ids of each sequence, from pieces packed ``with_ids``; a sequence holds ``size`` ids at most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.expr("aggregate(parts, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"))
