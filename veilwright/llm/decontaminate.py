"""Benchmark decontamination as a prefix-filtered set join.

A *window* is 13 consecutive words of a benchmark item, or the whole of a shorter item. Windows are
sets of word shingles; as a window counts only when all of it occurs, one shingle is a sufficient
prefix, and the rarest one is the best. The job counts in how many documents each benchmark shingle
occurs, takes the rarest shingle of each window as its prefix, joins document positions to windows on
it, applies the length and position bounds, and compares the words of what is left.

Documents are never shuffled: both passes are maps, and only counts of benchmark shingles are grouped.
The benchmark is taken in blocks of at most ``block_bytes``, so what is broadcast has a fixed bound; long
items are cut into stretches that overlap, copies count once, and a larger benchmark makes more passes.
"""

from __future__ import annotations

import hashlib
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwright.llm.common import column, fresh, map_texts, word_list
from veilwright.sources.scratch import written

WINDOW = 13
SHINGLE = 3
#: Text of one block; its windows take some hundred times that on the driver while they are built.
BLOCK_BYTES = 2 << 20
#: Candidates compared at once.
CHECKED = 1 << 16

RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def codes(ids: np.ndarray, size: int) -> np.ndarray:
    """One number for each ``size`` consecutive word ids; 0 where a word is unknown."""
    if len(ids) < size:
        return np.zeros(0, np.uint64)
    n = len(ids) - size + 1
    code, known = np.full(n, size, np.uint64), np.ones(n, bool)
    for k in range(size):
        part = ids[k : k + n]
        code = code * np.uint64(0x9E3779B97F4A7C15) + part
        known &= part != 0
    code ^= code >> np.uint64(29)
    return np.where(known, code | np.uint64(1), np.uint64(0))


class Block:
    """Windows of some benchmark items, as arrays."""

    def __init__(self, items: list[tuple[str, bytes]], window: int) -> None:
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[int]] = {}
        self.names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        for name, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in word_list(text)]
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1 if ids else 0):
                found.setdefault(tuple(ids[i : i + size]), set()).add(number[name])
        windows = sorted(found)
        self.lengths = np.array([len(w) for w in windows], np.int64)
        self.words = np.zeros((len(windows), window), np.uint64)
        for row, w in zip(self.words, windows, strict=True):
            row[: len(w)] = w
        owners = [sorted(found[w]) for w in windows]
        self.owner_at = np.cumsum([0, *map(len, owners)])
        self.owners = np.array([i for o in owners for i in o], np.int64)
        self.shingles = np.unique(np.concatenate([np.zeros(0, np.uint64), *(self.of(w) for w in range(len(windows)))]))

    def of(self, w: int) -> np.ndarray:
        """Shingles of window ``w``, by position."""
        size = int(self.lengths[w])
        return codes(self.words[w, :size], min(SHINGLE, size))

    def sizes(self) -> list[int]:
        return sorted({min(SHINGLE, int(n)) for n in self.lengths})

    def choose(self, documents_with: dict[int, int]) -> None:
        """Take the rarest shingle of each window as its prefix; a window with one that never occurs is out."""
        frequency = np.array([documents_with.get(i, 0) for i in range(len(self.shingles))], np.int64)
        chosen = []
        for w in range(len(self.lengths)):
            seen = frequency[np.searchsorted(self.shingles, own := self.of(w))]
            if seen.min() > 0:
                at = min(range(len(own)), key=lambda i: (seen[i], own[i]))
                chosen.append((int(own[at]), w, at))
        chosen.sort()
        self.prefix, self.first = np.unique(np.array([c for c, _, _ in chosen], np.uint64), return_index=True)
        self.first = np.append(self.first, len(chosen))
        self.window_of = np.array([w for _, w, _ in chosen], np.int64)
        self.offset_of = np.array([i for _, _, i in chosen], np.int64)

    def number(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Word ids of all texts, a 0 after each, and where each begins."""
        words, begins = [], [0]
        for text in texts:
            words += word_list(text)
            words.append(b"")
            begins.append(len(words))
        return np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.uint64, len(words)), np.array(begins)

    def occurrences(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of windows: start and window."""
        starts, windows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for size in self.sizes():
            if not len(self.prefix):
                break
            code = codes(ids, size)
            at = np.flatnonzero(code)
            slot = np.minimum(np.searchsorted(self.prefix, code[at]), len(self.prefix) - 1)
            equal = self.prefix[slot] == code[at]
            at, slot = at[equal], slot[equal]
            often = self.first[slot + 1] - self.first[slot]
            ends = np.cumsum(often)
            low = 0
            while low < len(at):  # a bounded number of candidates at a time
                high = max(low + 1, int(np.searchsorted(ends, ends[low] - often[low] + CHECKED, "right")))
                n = often[low:high]
                row = np.repeat(self.first[slot[low:high]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                window = self.window_of[row]
                start = np.repeat(at[low:high], n) - self.offset_of[row]
                fits = (start >= 0) & (start + self.lengths[window] <= len(ids))
                start, window = start[fits], window[fits]
                for k in range(self.words.shape[1]):
                    in_window = k < self.lengths[window]
                    same = ~in_window | (ids[np.minimum(start + k, len(ids) - 1)] == self.words[window, k])
                    start, window = start[same], window[same]
                starts.append(start)
                windows.append(window)
                low = high
        return np.concatenate(starts), np.concatenate(windows)


def _rarity(docs: DataFrame, text: str, block: Block) -> dict[int, int]:
    """Documents that hold each shingle of the block; at most one row per shingle comes back."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def count(batches):
        import pyarrow as pa

        from veilwright.llm.common import pieces

        own = shared.value
        total = np.zeros(len(own.shingles), np.int64)
        for batch in batches:
            for part in pieces(batch, 0):
                ids, begins = own.number(part.column(0).cast(pa.binary()).to_pylist())
                for size in own.sizes():
                    code = codes(ids, size)
                    at = np.flatnonzero(code)
                    slot = np.minimum(np.searchsorted(own.shingles, code[at]), len(own.shingles) - 1)
                    equal = own.shingles[slot] == code[at]
                    document = np.searchsorted(begins, at[equal], "right")
                    once = np.unique(document * len(own.shingles) + slot[equal])
                    total += np.bincount(once % len(own.shingles), minlength=len(own.shingles))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["shingle", "n"])

    counts = docs.select(column(text).alias("text")).mapInArrow(count, "shingle long, n long")
    return {r.shingle: r.n for r in counts.groupBy("shingle").agg(F.sum("n").alias("n")).collect()}


def stretches(benchmark: DataFrame, item: str, text: str, window: int, most: int) -> DataFrame:
    """``(item, text, bytes)``: the words of each item, a long one in stretches of about ``most`` bytes.

    Neighbouring stretches share ``window`` - 1 words, so each window lies whole in one at least. Equal
    stretches of an item are one row, so copies of an item cost nothing.
    """
    items = benchmark.select(F.coalesce(column(item).cast("string"), F.lit("")).alias("item"), column(text).alias("text")).where("text IS NOT NULL")

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            for name, whole in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                words = word_list(whole)
                out, begin = [], 0
                while begin == 0 and words or begin + window <= len(words):
                    end, size = begin, 0
                    while end < len(words) and size < most:
                        size += len(words[end]) + 1
                        end += 1
                    out.append(b" ".join(words[begin : end + window - 1]))
                    begin = end
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(out), pa.string()), pa.array(out, pa.binary()), pa.array([len(x) for x in out], pa.int64())], names=["item", "text", "bytes"])

    return items.mapInArrow(cut, "item string, text binary, bytes long").distinct()


def _blocks(benchmark: DataFrame, item: str, text: str, limit: int, window: int):
    """Blocks of the benchmark of ``limit`` bytes at most; one is on the driver at a time.

    Stretches are a 64th of a block, and blocks are half full on average, so that none grows beyond the limit.
    """
    parts = written(stretches(benchmark, item, text, window, max(1, limit // 64)), "decontaminate-benchmark")
    total = parts.agg(F.sum("bytes")).first()[0] or 0
    n = 1 if total <= limit else -(-2 * total // limit)
    for b in range(n):
        own = parts if n == 1 else parts.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b)
        yield Block([(r.item, bytes(r.text)) for r in own.select("item", "text").toLocalIterator()], window), b == n - 1


def annotate(docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, drop: bool = False) -> DataFrame:
    """``keep`` columns of the documents with ``n_words, n_hit, n_items, items_sha256, contaminated``.

    With ``drop`` only documents that are not contaminated, without the new columns.

    Null and empty texts have no words and are not contaminated; null items and items without words
    hit nothing; an item whose id is null has the id ''. Repeated documents are judged alike, row by
    row; repeated item ids count once. Extra columns of any name are left as they are.
    """
    carried: tuple[str, ...] = ()
    for block, last in _blocks(benchmark, item, item_text, block_bytes, window):
        block.choose(_rarity(docs, text, block) if len(block.shingles) else {})
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def setup(shared=shared, last=last):
            own: Block = shared.value

            def scan(texts, hits=None, items=None):
                ids, begins = own.number(texts)
                start, found = own.occurrences(ids)
                edge = np.zeros(len(ids) + 1, np.int64)
                np.add.at(edge, start, 1)
                np.subtract.at(edge, start + own.lengths[found], 1)
                hit = np.cumsum(edge[:-1]) > 0
                often = own.owner_at[found + 1] - own.owner_at[found]
                owner = own.owners[np.repeat(own.owner_at[found], often) + np.arange(often.sum()) - np.repeat(np.cumsum(often) - often, often)]
                pairs = np.unique(np.repeat(np.searchsorted(begins, start, "right") - 1, often) * max(1, len(own.names)) + owner)
                named: list[set[str]] = [set(x or ()) for x in items] if items else [set() for _ in texts]
                for p in pairs.tolist():
                    named[p // len(own.names)].add(own.names[p % len(own.names)])
                covered = [hit[a : b - 1] for a, b in zip(begins[:-1], begins[1:], strict=True)]
                if hits:
                    covered = [c | np.unpackbits(np.frombuffer(h, np.uint8), count=len(c)).astype(bool) for c, h in zip(covered, hits, strict=True)]
                if not last:
                    return None, ([np.packbits(c).tobytes() for c in covered], [sorted(x) for x in named])
                n, h = [len(c) for c in covered], [int(c.sum()) for c in covered]
                bad = [b > 0 and 20 * b >= a for a, b in zip(n, h, strict=True)]
                if drop:
                    return [not x for x in bad], ()
                return None, (n, h, [len(x) for x in named], [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in named], bad)

            return scan

        if last:
            return map_texts(docs, text, keep, "" if drop else RESULT, setup, carried)
        names = carried or (fresh(docs, "hit_bits"), fresh(docs, "hit_items"))
        docs = written(map_texts(docs, text, [c for c in docs.columns if c not in carried], f"`{names[0]}` binary, `{names[1]}` array<string>", setup, carried), "decontaminate")
        carried = names
    raise AssertionError("a benchmark has one block at least")
