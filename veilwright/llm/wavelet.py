"""Token ids as one wavelet matrix per shard.

A shard holds the ids of consecutive documents as bit-planes, highest bit first; after each plane the
ids are parted, zeros before ones, in their order. With a directory of counted ones per block, a plane
answers rank and select, and the matrix answers: the id at a place, how often an id occurs before a
place, and where its k-th occurrence is. The directory is part of the file, and planes are compressed in
blocks that are found by it, so a lookup unpacks one block of each plane, two where its ends part.

Documents are dealt out by ranges of their ids, and each task encodes its documents in order and closes
a shard whenever it is full. A shard is one Parquet file of one row, written by Spark, so it can lie in
any store; its counts are columns beside it.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilwright.llm.common import column, pieces
from veilwright.llm.sharding import crc_of
from veilwright.llm.tokens import END, chunks_of, crc, tokenizer_text, vocabulary_path

MAGIC = b"WVM3"
#: Magic, documents, ids, planes, bits of a block.
HEAD = "<4sIQII"
#: Ids in a shard, the last document aside.
SHARD_TOKENS = 1 << 21
#: Bits of a block: what is packed by itself, and what two entries of the directory lie apart.
BLOCK = 1 << 16
#: Ids that are parted, or put back, at a time.
STRETCH = 1 << 16
#: Unpacked blocks that a matrix remembers.
REMEMBERED = 64


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def stretches(bit: np.ndarray):
    """``(stretch, places of its zeros, places of its ones)``, places from its beginning.

    Ids are copied by places, not by a mask: of mixed bits each one decides a branch there. A stretch
    keeps the places few.
    """
    for begin in range(0, len(bit), STRETCH):
        own = bit[begin : begin + STRETCH]
        yield slice(begin, begin + len(own)), np.flatnonzero(~own), np.flatnonzero(own)


class Plane:
    """A bit-plane in packed blocks: ``ones[b]`` counts the ones before block b, ``ends`` says where the packed blocks end."""

    def __init__(self, n: int, size: int, ones: np.ndarray, ends: np.ndarray, data) -> None:
        self.n, self.size, self.ones, self.ends, self.data = n, size, ones, ends, data
        #: Blocks unpacked so far, whatever is still remembered.
        self.opened = 0
        self.kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @classmethod
    def build(cls, bit: np.ndarray) -> Plane:
        packed = np.packbits(bit, bitorder="little")
        starts = np.arange(0, len(packed), BLOCK // 8)
        counts = np.add.reduceat(np.bitwise_count(packed), starts, dtype=np.int64) if len(packed) else np.zeros(0, np.int64)
        press = zstandard.ZstdCompressor(level=1)
        blocks = [press.compress(packed[a : a + BLOCK // 8].tobytes()) for a in starts.tolist()]
        return cls(len(bit), BLOCK, np.concatenate([[0], np.cumsum(counts)]), np.cumsum([0, *map(len, blocks)]), b"".join(blocks))

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of a block, and the ones before each of them; only this block is unpacked."""
        if b not in self.kept:
            if len(self.kept) >= REMEMBERED:
                self.kept.clear()
            bits = np.frombuffer(unsqueeze(self.data[int(self.ends[b]) : int(self.ends[b + 1])]), np.uint8)
            self.kept[b] = bits, np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])
            self.opened += 1
        return self.kept[b]

    def _by_block(self, blocks: np.ndarray):
        """``(block, which of the places lie in it)``."""
        order = np.argsort(blocks, kind="stable")
        found, first = np.unique(blocks[order], return_index=True)
        if len(blocks):
            yield from zip(found.tolist(), np.split(order, first[1:]), strict=True)

    def rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ones before each place, and the bit there (0 behind the end)."""
        ones, bit = np.empty(len(at), np.int64), np.zeros(len(at), np.int64)
        for b, own in self._by_block(at // self.size):
            if b >= len(self.ends) - 1:
                ones[own] = self.ones[-1]
                continue
            bits, before = self.block(b)
            inside = at[own] - b * self.size
            byte, rest = inside >> 3, (inside & 7).astype(np.uint8)
            here = np.append(bits, np.uint8(0))[byte]
            ones[own] = self.ones[b] + before[byte] + np.bitwise_count(here & ((np.uint8(1) << rest) - np.uint8(1)))
            bit[own] = (here >> rest) & 1
        return ones, bit

    def select(self, bit: int, nth: np.ndarray) -> np.ndarray:
        """Places of the ``nth`` (from 0) bits of this value; the directory says in which block each lies."""
        counts = self.ones if bit else np.minimum(np.arange(len(self.ones)) * self.size, self.n) - self.ones
        out = np.empty(len(nth), np.int64)
        for b, own in self._by_block(np.searchsorted(counts, nth, "right") - 1):
            places = np.flatnonzero(np.unpackbits(self.block(b)[0], count=min(self.size, self.n - b * self.size), bitorder="little") == bit)
            out[own] = b * self.size + places[nth[own] - counts[b]]
        return out

    def bits(self) -> np.ndarray:
        """The whole plane."""
        blocks = [unsqueeze(self.data[int(a) : int(b)]) for a, b in zip(self.ends[:-1], self.ends[1:], strict=True)]
        return np.unpackbits(np.frombuffer(b"".join(blocks), np.uint8), count=self.n, bitorder="little").astype(bool)


class WaveletMatrix:
    """Ids with access, counting and occurrence lookup; ``zeros[k]`` counts the zeros of plane k."""

    def __init__(self, n: int, zeros: list[int], planes: list[Plane]) -> None:
        self.n, self.zeros, self.planes = n, zeros, planes

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        top = int(ids.max()) if len(ids) else 0
        now = ids.astype(np.uint16 if top < 1 << 16 else np.uint32)
        zeros, planes = [], []
        for shift in range(max(1, top.bit_length()) - 1, -1, -1):
            bit = (now & now.dtype.type(1 << shift)) != 0
            planes.append(Plane.build(bit))
            zeros.append(len(bit) - int(np.count_nonzero(bit)))
            parted = np.empty_like(now)
            low, high = 0, zeros[-1]
            for stretch, zero, one in stretches(bit):
                own = now[stretch]
                parted[low : low + len(zero)] = own.take(zero)
                parted[high : high + len(one)] = own.take(one)
                low, high = low + len(zero), high + len(one)
            now = parted
        return cls(len(ids), zeros, planes)

    def access(self, places) -> np.ndarray:
        """The ids at these places."""
        at = np.asarray(places, np.int64).copy()
        out = np.zeros(len(at), np.int64)
        for plane, zeros in zip(self.planes, self.zeros, strict=True):
            ones, bit = plane.rank(at)
            out = out << 1 | bit
            at = np.where(bit == 1, zeros + ones, at - ones)
        return out

    def rank(self, token: int, place: int | None = None) -> int:
        """Occurrences of an id before a place; everywhere, if none is given."""
        low, high = self._range(token, self.n if place is None else place)
        return high - low

    def _range(self, token: int, place: int) -> tuple[int, int]:
        if token < 0 or token >> len(self.zeros):
            return 0, 0
        low, high = 0, place
        for k, (plane, zeros) in enumerate(zip(self.planes, self.zeros, strict=True)):
            a, b = plane.rank(np.array([low, high]))[0].tolist()
            one = token >> (len(self.zeros) - 1 - k) & 1
            low, high = (zeros + a, zeros + b) if one else (low - a, high - b)
        return low, high

    def select(self, token: int, nth: int) -> int:
        """Place of the ``nth`` occurrence (from 0) of an id; -1 if there are fewer."""
        low, high = self._range(token, self.n)
        return int(self._climb(token, np.array([low + nth]))[0]) if 0 <= nth < high - low else -1

    def _climb(self, token: int, at: np.ndarray) -> np.ndarray:
        """Places in the shard of places below the last plane."""
        for k in range(len(self.zeros) - 1, -1, -1):
            one = token >> (len(self.zeros) - 1 - k) & 1
            at = self.planes[k].select(one, at - self.zeros[k] if one else at)
        return at

    def occurrences(self, token: int) -> list[int]:
        """All places of an id, climbed together."""
        low, high = self._range(token, self.n)
        return sorted(self._climb(token, np.arange(low, high)).tolist())

    def decode(self) -> np.ndarray:
        """All ids in their order: the parting of each plane undone, lowest plane first."""
        kind = np.uint16 if len(self.zeros) <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for k in range(len(self.zeros) - 1, -1, -1):
            bit = self.planes[k].bits()
            now[self.zeros[k] :] |= kind(1 << (len(self.zeros) - 1 - k))
            above = np.empty(self.n, kind)
            low, high = 0, self.zeros[k]
            for stretch, zero, one in stretches(bit):
                own = above[stretch]
                own[zero] = now[low : low + len(zero)]
                own[one] = now[high : high + len(one)]
                low, high = low + len(zero), high + len(one)
            now = above
        return now.astype("<u4")


def dump(doc_ids: list[int | None], lengths: list[int], matrix: WaveletMatrix) -> bytes:
    """A shard's file: counts, the documents, the directory of each plane, and the packed blocks of all planes."""
    ids = np.array([0 if d is None else d for d in doc_ids], "<i8")
    documents = [squeeze(np.diff(ids, prepend=np.int64(0)).tobytes()), squeeze(np.packbits([d is None for d in doc_ids]).tobytes()), squeeze(np.array(lengths, "<u4").tobytes())]
    directories = [squeeze(np.concatenate([p.ones, p.ends]).astype("<u8").tobytes()) for p in matrix.planes]
    parts = [*documents, *directories, *[p.data for p in matrix.planes]]
    head = struct.pack(HEAD, MAGIC, len(doc_ids), matrix.n, len(matrix.zeros), matrix.planes[0].size)
    return b"".join([head, np.array(matrix.zeros, "<u8").tobytes(), np.array([len(p) for p in parts], "<u8").tobytes(), *parts])


class Shard:
    """A shard's file, of which only the counts are read at once; documents and planes are read when they are asked for."""

    def __init__(self, file: bytes) -> None:
        magic, self.n_docs, self.n, levels, size = struct.unpack_from(HEAD, file)
        if magic != MAGIC:
            raise ValueError("not a wavelet shard")
        at = struct.calcsize(HEAD)
        zeros = np.frombuffer(file, "<u8", levels, at).tolist()
        sizes = np.frombuffer(file, "<u8", 2 * levels + 3, at + 8 * levels)
        ends = at + 8 * (3 * levels + 3) + np.cumsum(sizes).astype(np.int64)
        view = memoryview(file)
        self.parts = [view[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
        planes = []
        for k in range(levels):
            directory = np.frombuffer(unsqueeze(self.parts[3 + k]), "<u8").astype(np.int64)
            planes.append(Plane(self.n, size, directory[: len(directory) // 2], directory[len(directory) // 2 :], self.parts[3 + levels + k]))
        self.matrix = WaveletMatrix(self.n, zeros, planes)

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """Ids of the documents, and how many token ids each has."""
        ids = np.cumsum(np.frombuffer(unsqueeze(self.parts[0]), "<i8")).tolist()
        missing = np.unpackbits(np.frombuffer(unsqueeze(self.parts[1]), np.uint8), count=self.n_docs)
        lengths = np.frombuffer(unsqueeze(self.parts[2]), "<u4").astype(np.int64)
        return [None if m else d for d, m in zip(ids, missing.tolist(), strict=True)], lengths


def load(file: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """Document ids, their lengths, and the matrix of a shard's file."""
    shard = Shard(file)
    return *shard.documents(), shard.matrix


FILE = "part int, shard int, n_docs long, n_tokens long, first_doc long, last_doc long, file binary"


def write(docs: DataFrame, folder: str, id_col: str = "doc_id", text: str = "text", tokenizer_path: str | None = None, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode every whole text, with id 1 after it, and write the shards in ascending order of (integer) ids.

    Null and empty texts are that id alone. Null ids come first; rows with the same id are in the order
    of their texts' checksums. An empty table writes no shard. Other columns are not read.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(tokenizer_text(tokenizer_path or vocabulary_path()))
    end = np.array([END], "<u4").tobytes()
    keyed = docs.select(column(id_col).cast("long").alias("id"), crc_of(column(text)).alias("checksum"), F.monotonically_increasing_id().alias("tie"), column(text).alias("text"))
    dealt = keyed.repartitionByRange("id", "checksum", "tie").sortWithinPartitions("id", "checksum", "tie").select("id", "text")

    def build(batches):
        from pyspark import TaskContext

        part, shard = TaskContext.get().partitionId(), 0
        chunks = chunks_of(vocabulary.value)
        doc_ids: list[int | None] = []
        encoded: list[bytes] = []
        total = 0

        def close():
            matrix = WaveletMatrix.build(np.frombuffer(b"".join(encoded), "<u4"))
            row = (part, shard, len(doc_ids), total, doc_ids[0], doc_ids[-1], dump(doc_ids, [len(e) // 4 for e in encoded], matrix))
            return pa.RecordBatch.from_pylist([dict(zip(("part", "shard", "n_docs", "n_tokens", "first_doc", "last_doc", "file"), row, strict=True))], schema=pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("file", pa.binary())]))

        for batch in batches:
            for slice_ in pieces(batch, 1):
                for doc, ids in zip(slice_.column(0).to_pylist(), chunks.encode_all(slice_.column(1).cast(pa.binary()).to_pylist()), strict=True):
                    doc_ids.append(doc)
                    encoded.append(ids + end)
                    total += len(encoded[-1]) // 4
                    if total >= shard_tokens:
                        yield close()
                        doc_ids, encoded, total, shard = [], [], 0, shard + 1
        if doc_ids:
            yield close()

    dealt.mapInArrow(build, FILE).write.option("maxRecordsPerFile", 1).option("compression", "none").parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, decoded from the files of the shards."""
    shards = spark.read.schema(FILE).parquet(folder)

    def decode(batches):
        for batch in batches:
            for part, shard, file in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                doc_ids, lengths, matrix = load(file)
                ids = matrix.decode()
                ends = np.cumsum(lengths)
                sums = [crc(ids[a:b].tobytes()) for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
                n = len(doc_ids)
                yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([shard] * n, pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(ends - lengths), pa.array(lengths), pa.array(sums, pa.int64())], names=["part", "shard", "doc_id", "at", "n_tokens", "ids_crc32"])

    documents = shards.select("part", "shard", "file").mapInArrow(decode, "part int, shard int, doc_id long, at long, n_tokens long, ids_crc32 long")
    counts = shards.select("part", "shard", "n_tokens")  # the files themselves are not read for this
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    parts = counts.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("of_part"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.join(parts, "part").select("part", "shard", (F.col("of_part") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("base"))
    return documents.join(bases, ["part", "shard"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def lookup(spark: SparkSession, folder: str, tokens: list[int]) -> DataFrame:
    """``(part, shard, token, n, first)``: how often each token occurs in each shard, and where first (-1: nowhere)."""
    shards = spark.read.schema(FILE).parquet(folder).select("part", "shard", "file")

    def find(batches):
        for batch in batches:
            for part, shard, file in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                matrix = Shard(file).matrix
                rows = [(part, shard, t, matrix.rank(t), matrix.select(t, 0)) for t in tokens]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i < 2 else pa.int64()) for i, c in enumerate(zip(*rows, strict=True))], names=["part", "shard", "token", "n", "first"])

    return shards.mapInArrow(find, "part int, shard int, token long, n long, first long")


def occurrences(spark: SparkSession, folder: str, tokens: list[int]) -> DataFrame:
    """``(part, shard, token, place)`` of every occurrence of some tokens."""
    shards = spark.read.schema(FILE).parquet(folder).select("part", "shard", "file")

    def find(batches):
        for batch in batches:
            for part, shard, file in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                matrix = Shard(file).matrix
                for t in tokens:
                    places = matrix.occurrences(t)
                    columns = [pa.array([part] * len(places), pa.int32()), pa.array([shard] * len(places), pa.int32()), pa.array([t] * len(places), pa.int64()), pa.array(places, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["part", "shard", "token", "place"])

    return shards.mapInArrow(find, "part int, shard int, token long, place long")
