"""Prefix trie of turn sequences: union-find over the common prefixes of sorted neighbours.

Each turn has a fingerprint of 128 bits of its place and content, so equal prefixes are equal runs of
fingerprints, and the exclusive or of a prefix's fingerprints names its node. Sequences are cut into
blocks of ``BLOCK`` turns, each with the name of what precedes it; blocks with the same name before them
hang from one node, so no row ever holds a whole long sequence.

Blocks are sorted by (name before, fingerprints) in a range exchange. Every Arrow batch of a part is made
into a forest: edges between neighbours, each as deep as their common prefix, are taken from the deepest
up, and a merge of two components creates (or widens) the branching node at that depth; the single
chains between such nodes are laid out while a component is raised. A node that holds neither the first
nor the last row of its batch, and no sequence that goes on in another block, is finished there. The
others, the open ones, are two spines of a batch: contracted to counts, they are merged by name across
batches and parts, and what lies below them is summed up along their ancestors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from veilwright.sources.scratch import written

#: Turns of a block, so fingerprints of a row.
BLOCK = 64
WIDTH = 16

NODES = (
    "node binary, parent binary, above array<binary>, done boolean, top boolean, depth long, conv_id long, parent_conv_id long, "
    "n_convs long, n_children long, n_leaves long, saved long, weight long"
)


def names_of(start: bytes, key: bytes) -> bytes:
    """Names of the nodes along a block: the one it starts from, then one for each fingerprint."""
    return start + (np.bitwise_xor.accumulate(np.frombuffer(key, np.uint64).reshape(-1, 2), axis=0) ^ np.frombuffer(start, np.uint64)).tobytes() if key else start


def common(a: bytes, b: bytes) -> int:
    """Fingerprints that both begin with."""
    most = min(len(a), len(b)) // WIDTH
    if a[: most * WIDTH] == b[: most * WIDTH]:
        return most
    return next(k for k in range(most) if a[k * WIDTH : (k + 1) * WIDTH] != b[k * WIDTH : (k + 1) * WIDTH])


class Forest:
    """Nodes of the sorted blocks ``(start, depth, conv_id, key, weights, goes_on)`` of one batch.

    ``rows`` has a tuple as ``NODES`` for each node. A component is an interval of blocks with a top node
    that is not yet laid out: ``kids``, ``leaves`` and ``saved`` count finished subtrees below it.
    """

    def __init__(self, blocks: list[tuple]):
        self.blocks, self.last = blocks, len(blocks) - 1
        self.names = [names_of(b[0], b[3]) for b in blocks]
        self.going = np.concatenate([[0], np.cumsum([b[5] for b in blocks])]).tolist()
        self.rows: list[list] = []
        self.owner = list(range(len(blocks)))
        # first and last block, depth of the top within the block, least id, kids, leaves, saved, rows of the top's children
        self.parts = [[i, i, len(b[3]) // WIDTH, b[2], 0, 0, 0, []] for i, b in enumerate(blocks)]
        edges = []
        for i in range(1, len(blocks)):
            if blocks[i][0] == blocks[i - 1][0]:
                depth = common(blocks[i - 1][3], blocks[i][3])
                if depth >= self.floor(i):
                    edges.append((-depth, i))
        for depth, i in sorted(edges):
            self.merge(self.find(i - 1), self.find(i), -depth)
        for i in range(len(blocks)):
            if self.find(i) == i:
                self.lift(self.parts[i], self.floor(i) - 1)

    def floor(self, i: int) -> int:
        """Least depth laid out here: a later block starts from a node of the block before it."""
        return 1 if self.blocks[i][1] else 0

    def find(self, i: int) -> int:
        while self.owner[i] != i:
            self.owner[i] = i = self.owner[self.owner[i]]
        return i

    def merge(self, a: int, b: int, depth: int) -> None:
        left, right = self.parts[a], self.parts[b]
        self.lift(left, depth)
        self.lift(right, depth)
        if len(left[7]) < len(right[7]):
            left[7], right[7] = right[7], left[7]
        left[7] += right[7]
        self.owner[b] = a
        self.parts[a] = [left[0], right[1], depth, min(left[3], right[3]), left[4] + right[4], left[5] + right[5], left[6] + right[6], left[7]]

    def lift(self, part: list, depth: int) -> None:
        """Lay out the top and the chain above it, so that a node at ``depth`` is the top."""
        first, last, top, least, kids, leaves, saved, below = part
        if top <= depth:
            return
        n, base, weights, names = last - first + 1, self.blocks[first][1], self.blocks[first][4], self.names[first]
        done = first > 0 and last < self.last and self.going[first] == self.going[last + 1]
        floor = self.floor(first)
        for at in range(top, depth, -1):
            weight = weights[at - 1] if at else 0
            parent = names[(at - 1) * WIDTH : at * WIDTH] if at else None
            above = [] if done else [names[k * WIDTH : (k + 1) * WIDTH] for k in range(floor, at)]
            if done:
                saved += (n - 1) * weight
                leaves = leaves if kids else 1
                for row in below:
                    self.rows[row][7] = least
            self.rows.append([names[at * WIDTH : (at + 1) * WIDTH], parent, above, done, at == 1 and base > 0, base + at, least, None, n, kids, leaves, saved, weight])
            below = [len(self.rows) - 1]
            kids, leaves, saved = (1, leaves, saved) if done else (0, 0, 0)
        part[2:] = [depth, least, kids, leaves, saved, below]


def _forests(types: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = Forest(list(zip(*[c.to_pylist() for c in batch.columns], strict=True))).rows
            for at in range(0, len(rows), 20_000):
                part = rows[at : at + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], f.type) for i, f in enumerate(types)], schema=types)

    return lay


def _binary(a, b):
    """Two long columns as 16 bytes."""
    return F.unhex(F.concat(*[F.lpad(F.hex(c), 16, "0") for c in (a, b)]))


def blocks_of(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """``(start, depth, conv_id, key, weights, goes_on, node)`` for each block; ``node`` is where it ends."""
    hashed = turns.withColumns({"a": F.xxhash64("pos", "token"), "b": F.xxhash64(F.lit(1), "pos", "token"), "depth": F.col("pos") - F.col("pos") % BLOCK})
    items = F.array_sort(F.collect_list(F.struct("pos", "a", "b", "weight")))  # BLOCK of them at most
    joined = F.array_join(F.transform("items", lambda x: F.concat(F.lpad(F.hex(x["a"]), 16, "0"), F.lpad(F.hex(x["b"]), 16, "0"))), "")
    cut = hashed.groupBy("conv_id", "depth").agg(items.alias("items"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    cut = written(cut.select("conv_id", "depth", F.unhex(joined).alias("key"), F.col("items.weight").alias("weights"), "a", "b"), "trie-blocks")
    alone = (F.col("depth") == 0) & (F.size("weights") < BLOCK)
    order = Window.partitionBy("conv_id").orderBy("depth")  # a row for each BLOCK turns
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    long = cut.where(~alone).withColumns({"sa": F.coalesce(F.bit_xor("a").over(before), zero), "sb": F.coalesce(F.bit_xor("b").over(before), zero), "goes_on": F.lead("depth").over(order).isNotNull()})
    none = ids.select("conv_id").distinct().join(cut.select("conv_id"), "conv_id", "left_anti").select(
        "conv_id", zero.alias("depth"), F.lit(b"").alias("key"), F.array().cast("array<long>").alias("weights"), zero.alias("a"), zero.alias("b")
    )
    short = cut.where(alone).unionByName(none).withColumns({"sa": zero, "sb": zero, "goes_on": F.lit(False)})
    rows = short.unionByName(long)
    ends = _binary(F.col("sa").bitwiseXOR(F.col("a")), F.col("sb").bitwiseXOR(F.col("b")))
    return rows.select(_binary(F.col("sa"), F.col("sb")).alias("start"), "depth", "conv_id", "key", "weights", "goes_on", ends.alias("node"))


def _deeper(blocks: DataFrame, tops: DataFrame) -> DataFrame:
    """``(node, n_leaves, saved)``: what lies in later blocks below each node.

    ``tops`` has the sums of the nodes right below a block's start. They are given to the least sequence
    that has them, summed along its blocks from the last one, and added to every node on its way.
    """
    per_start = tops.groupBy(F.col("parent").alias("start")).agg(F.min("conv_id").alias("conv_id"), F.sum("n_leaves").alias("leaves"), F.sum("saved").alias("kept"))
    long = blocks.where((F.col("depth") > 0) | F.col("goes_on")).join(per_start, ["start", "conv_id"], "left")
    after = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, -1)
    below = long.withColumns({"leaves": F.sum("leaves").over(after), "kept": F.sum("kept").over(after)}).where("leaves IS NOT NULL")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, depth, key, leaves, kept in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                names = names_of(start, key)
                nodes = [names[i : i + WIDTH] for i in range(WIDTH if depth else 0, len(names), WIDTH)]
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array([leaves] * len(nodes), pa.int64()), pa.array([kept] * len(nodes), pa.int64())], names=["node", "n_leaves", "saved"])

    return below.select("start", "depth", "key", "leaves", "kept").mapInArrow(spread, "node binary, n_leaves long, saved long")


def prefix_trie(turns: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of the trie of all sequences, and ``(node, conv_id)`` of where each sequence ends.

    ``turns`` has ``conv_id`` (long), ``pos`` (from 0, without gaps), ``token`` (what is compared) and
    ``weight`` (long, of sharing that turn); ``ids`` has every ``conv_id``, also those without turns.
    A node has ``node, parent`` (names of 16 bytes), ``depth, conv_id`` (least member), ``parent_conv_id,
    n_convs, n_children, n_leaves`` and ``saved``: over its subtree, members but one times weight.

    Null tokens are equal to each other and to no other; null weights count 0. No ids: no nodes. Sequences may repeat,
    be prefixes of each other, and be of any length. Extra columns are not read.
    """
    turns = turns.select("conv_id", "pos", "token", F.coalesce("weight", F.lit(0)).cast("long").alias("weight"))
    blocks = written(blocks_of(turns, ids), "trie-starts")
    keys = ["start", "key", "conv_id"]
    ranged = blocks.select("start", "depth", "conv_id", "key", "weights", "goes_on").repartitionByRange(*keys).sortWithinPartitions(*keys)
    schema = T.StructType.fromDDL(NODES)
    laid = written(ranged.mapInArrow(_forests(to_arrow_schema(schema)), schema), "trie-forests")
    done = laid.where("done").drop("above", "done", "weight")

    merged = laid.where("NOT done").groupBy("node").agg(
        *[F.any_value(c).alias(c) for c in ("parent", "above", "top", "depth", "weight")], F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")],
    )
    merged = written(merged, "trie-open")
    # Open children are counted once merged; so are finished ones in another block than their parent.
    children = merged.select("parent").unionByName(done.where("top").select("parent")).groupBy("parent").agg(F.count("*").alias("more"))
    counted = merged.join(children.withColumnRenamed("parent", "node"), "node", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    own = counted.withColumns({"n_leaves": F.col("n_leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0), "saved": F.col("saved") + (F.col("n_convs") - 1) * F.col("weight")})
    own = written(own.drop("more", "weight"), "trie-counted")
    along = own.select(F.explode(F.concat(F.array("node"), "above")).alias("node"), "n_leaves", "saved")
    sums = written(along.groupBy("node").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved")), "trie-sums")
    held = own.drop("n_leaves", "saved", "above").join(sums, "node")
    later = _deeper(blocks, held.where("top").select("parent", "conv_id", "n_leaves", "saved").unionByName(done.where("top").select("parent", "conv_id", "n_leaves", "saved")))
    later = later.groupBy("node").agg(F.sum("n_leaves").alias("later_leaves"), F.sum("saved").alias("later_saved"))
    held = held.join(later, "node", "left").withColumns({"n_leaves": F.col("n_leaves") + F.coalesce("later_leaves", F.lit(0)), "saved": F.col("saved") + F.coalesce("later_saved", F.lit(0))})

    columns = ["node", "parent", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved"]
    held = written(held.select(*columns), "trie-held")
    parents = held.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    asking = held.unionByName(done.where("parent_conv_id IS NULL").select(*columns)).join(parents, "parent", "left")
    nodes = done.where("parent_conv_id IS NOT NULL").select(*columns, "parent_conv_id").unionByName(asking.select(*columns, "parent_conv_id"))
    return nodes, blocks.where("NOT goes_on").select("node", "conv_id")
