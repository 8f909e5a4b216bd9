"""Near duplicates by ProbMinHash, banding and exact verification.

Every text is a weighted set: its five-word shingles with their counts. ProbMinHash lets the elements
of that set arrive in a Poisson process of rate ``weight``; each arrival falls into one of ``m`` slots,
a slot keeps its first arrival, and an element stops as soon as its next arrival is later than every
slot's first. Two texts agree in a slot with the probability Jaccard similarity of their sets. A text
that repeats a shingle also has the keys of the same process with all weights 1, so that sets which
agree meet whatever their counts.

Texts with the same words form one class first, by a grouped minimum. Classes that agree in a band of
slots are candidates. Small buckets give all their pairs; in a large one every member is compared with
a few pivots first. Where that leaves a bucket in several components, each member outside the largest
is compared with all members of the others, block by block. So links within a bucket decide the
components exactly, while a bucket of near copies makes rows in proportion to its size. A link is an exact Jaccard similarity of at least 0.8
between the shingle sets. Texts are read by the first map, and again only for candidates.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwright.llm.common import column, fresh, map_texts, word_list
from veilwright.llm.components import components
from veilwright.sources.scratch import written

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
#: Buckets up to this size give all pairs; larger ones are compared with pivots.
SMALL_BUCKET = 12
PIVOTS = 3
#: Outsiders and members that meet in one block of an open bucket.
OUTSIDERS, MEMBERS = 256, 1024
#: Word hashes that a task remembers.
REMEMBERED = 400_000

_STEP, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, computed once while remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingles(texts_words: list[list[bytes]], hashes: WordHashes, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text, shingle, weight)`` of all texts, in order of both; a text of fewer words is one shingle."""
    counts = np.array([len(w) for w in texts_words], np.int64)
    ids = np.fromiter((h for words in texts_words for h in map(hashes.__getitem__, words)), np.uint64, int(counts.sum()))
    text_of = np.repeat(np.arange(len(counts)), counts)
    ends = np.cumsum(counts)
    place = np.arange(len(ids))
    value = np.full(len(ids), size, np.uint64)
    for k in range(size):
        inside = place + k < ends[text_of]
        value = np.where(inside, value * _STEP + ids[np.minimum(place + k, max(0, len(ids) - 1))], value + np.uint64(k))
    starts = (place + size <= ends[text_of]) | (place == (ends - counts)[text_of])
    text_of, value = text_of[starts], mixed(value[starts])
    order = np.lexsort((value, text_of))
    text_of, value = text_of[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = (text_of[1:] != text_of[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return text_of[at], value[at], np.diff(np.append(at, len(value)))


def signatures(n: int, text_of: np.ndarray, element: np.ndarray, weight: np.ndarray, m: int) -> np.ndarray:
    """The element that arrives first in each of ``m`` slots, for ``n`` texts."""
    first = np.full(n * m, np.inf)
    winner = np.zeros(n * m, np.uint64)
    time = np.zeros(len(element))
    arrival = 0
    while len(element):
        arrival += 1
        draw = mixed(element + np.uint64(arrival * int(_STEP) % 2**64))
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight
        slot = text_of * m + ((mixed(draw ^ _MIX2) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(first, slot, time)
        won = first[slot] == time
        winner[slot[won]] = element[won]
        late = first.reshape(n, m).max(axis=1)
        alive = time < late[text_of]
        text_of, element, weight, time = text_of[alive], element[alive], weight[alive], time[alive]
    return winner.reshape(n, m)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key for each band of each text."""
    key = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(signature), 1))
    parts = signature[:, : bands * rows].reshape(len(signature), bands, rows)
    for k in range(rows):
        key = mixed(key * _STEP + parts[:, :, k])
    return key.view(np.int64)


def _class_key(text: bytes, words: list[bytes]) -> tuple[int, int]:
    """128 bits that equal texts share: of the words, or of the text itself where it has none."""
    digest = hashlib.blake2b(b" ".join(words) if words else text, digest_size=16, person=b"words" if words else b"text").digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _features(bands: int, rows: int):
    def setup():
        hashes = WordHashes()

        def scan(texts):
            words = [word_list(t) for t in texts]
            text_of, element, weight = shingles(words, hashes)
            has = np.unique(text_of)
            keys = band_keys(signatures(len(has), np.searchsorted(has, text_of), element, weight.astype(np.float64), bands * rows), bands, rows)
            row = dict(zip(has.tolist(), keys, strict=True))
            # Where no shingle repeats, these would be the same keys.
            repeats = np.unique(text_of[weight > 1])
            at = np.isin(text_of, repeats)
            keys = band_keys(signatures(len(repeats), np.searchsorted(repeats, text_of[at]), element[at], np.ones(at.sum()), bands * rows), bands, rows)
            row |= {i: np.concatenate([row[i], k]) for i, k in zip(repeats.tolist(), keys, strict=True)}
            size = np.bincount(text_of, minlength=len(texts))
            key = [(None, None) if t is None else _class_key(t, w) for t, w in zip(texts, words, strict=True)]
            return None, ([k[0] for k in key], [k[1] for k in key], size, [row.get(i, ()) for i in range(len(texts))])

        return scan

    return setup


def _sets():
    hashes = WordHashes()

    def scan(texts):
        words = [word_list(t) for t in texts]
        text_of, element, _ = shingles(words, hashes)
        edges = np.searchsorted(text_of, np.arange(len(texts) + 1))
        key = [(None, None) if t is None else _class_key(t, w) for t, w in zip(texts, words, strict=True)]
        return None, ([k[0] for k in key], [k[1] for k in key], [element[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)])

    return scan


def _similar(similarity: float):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _links(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``(a, b)`` whose shingle sets are similar enough."""
    with_b = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b")), "b")
    with_both = with_b.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a")), "a")
    return with_both.select("a", "b", "of_a", "of_b").mapInArrow(_similar(similarity), "a long, b long")


def _ordered(pairs: DataFrame, similarity: float) -> DataFrame:
    """Distinct pairs, the hub first, whose sizes allow the similarity."""
    fit = F.least("n", "n2") >= F.lit(similarity) * F.greatest("n", "n2") - 1e-9
    return pairs.where(fit & (F.col("node") != F.col("node2"))).select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct()


def _open_links(large: DataFrame, roots: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links that still join components of one bucket, all of them tried.

    In a bucket of several components, every member outside the largest one is compared with every
    member of another component. Members come together in blocks, some of the outsiders and some of
    all, and leave as links, one for each outsider and component: no pair is a row.
    """
    placed = large.select("key", "node").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    sizes = placed.groupBy("key", "root").agg(F.count("*").alias("many"))
    main = sizes.groupBy("key").agg(F.max(F.struct("many", "root")).alias("top"), F.sum("many").alias("total"), F.count("*").alias("parts")).where("parts > 1")
    main = main.select(
        "key", F.col("top.root").alias("main"),
        F.ceil((F.col("total") - F.col("top.many")) / OUTSIDERS).cast("int").alias("outside"), F.ceil(F.col("total") / MEMBERS).cast("int").alias("blocks"),
    )
    main = written(main, "neardup-open")
    here = placed.join(main, "key")
    number = F.xxhash64("node")
    outsiders = here.where("root <> main").select("key", "node", "root", F.lit(True).alias("outsider"), F.pmod(number, F.col("outside")).cast("int").alias("o"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("m"))
    members = here.select("key", "node", "root", F.lit(False).alias("outsider"), F.explode(F.sequence(F.lit(0), F.col("outside") - 1)).alias("o"), F.pmod(number, F.col("blocks")).cast("int").alias("m"))
    dealt = outsiders.unionByName(members).join(sets, "node").select("key", "o", "m", "outsider", "node", "root", "shingles")

    def compare(table: pa.Table) -> pa.Table:
        outsider = table.column("outsider").to_numpy()
        node, root = table.column("node").to_numpy(), table.column("root").to_numpy()
        own = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        inside = np.flatnonzero(~outsider)
        sizes = np.array([len(own[i]) for i in inside], np.int64)
        elements = np.concatenate([np.zeros(0, np.uint64), *(own[i] for i in inside)])
        holder = np.repeat(np.arange(len(inside)), sizes)
        order = np.argsort(elements, kind="stable")
        elements, holder = elements[order], holder[order]
        found: list[tuple[int, int]] = []
        for i in np.flatnonzero(outsider):
            low, high = np.searchsorted(elements, own[i], "left"), np.searchsorted(elements, own[i], "right")
            n = high - low
            at = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            both = np.bincount(holder[at], minlength=len(inside))
            near = (both >= similarity * (len(own[i]) + sizes - both) - 1e-9) & (root[inside] != root[i])
            which = inside[near]
            if len(which):
                _, first = np.unique(root[which], return_index=True)
                found += [(int(node[i]), int(x)) for x in node[which[first]]]
        return pa.table({"a": pa.array([min(x) for x in found], pa.int64()), "b": pa.array([max(x) for x in found], pa.int64())})

    return dealt.groupBy("key", "o", "m").applyInArrow(compare, "a long, b long").distinct()


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """``(members, features)``: ``members`` has a row for each document, ``(id, k1, k2, class_id, root)``.

    ``class_id`` is the least id of the group, and ``root`` tells groups apart even where ids repeat. Texts with the same words (letters and digits, case of
    A-Z aside) are one class; a text of one to four words has one shingle; a text without words is
    near nothing but its equals; a null text is a group of its own under its own id. Repeated rows
    are members of the same class. Ids may be null; the least id ignores them. An empty table gives no
    rows. Other columns are not read.
    """
    ids = docs.select(column(id_col).alias("id"), column(text).alias("text"))
    features = written(map_texts(ids, "text", ["id"], "k1 long, k2 long, n int, bands array<long>", _features(bands, rows)), "neardup-features")
    keys = ["k1", "k2"]
    classes = features.where("k1 IS NOT NULL").groupBy(*keys).agg(F.min("id").alias("rep"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "neardup-classes")

    own = features.join(classes, [features.k1 == classes.k1, features.k2 == classes.k2, features.id.eqNullSafe(classes.rep)])
    # Both sides of the join below are read from tables, so that a key with very many members can be split.
    slots = written(own.select("node", "n", F.explode("bands").alias("key")).distinct(), "neardup-slots")
    shared = written(slots.groupBy("key").agg(F.count("*").alias("many")).where("many > 1"), "neardup-keys")
    members = written(slots.join(shared, "key"), "neardup-buckets")

    small = members.where(F.col("many") <= SMALL_BUCKET).select("key", "node", "n")
    other = small.select("key", F.col("node").alias("node2"), F.col("n").alias("n2"))
    large = members.where(F.col("many") > SMALL_BUCKET).select("key", "node", "n")
    pairs = small.join(other, "key").where("node < node2")
    slot = F.pmod(F.xxhash64("node"), F.lit(PIVOTS))
    pivots = large.groupBy("key", slot.alias("slot")).agg(F.min_by(F.struct("node", "n"), F.xxhash64("node")).alias("p")).select("key", F.col("p.node").alias("node2"), F.col("p.n").alias("n2"))
    pivots = written(pivots, "neardup-pivots")
    tested = written(_ordered(pairs.unionByName(large.join(pivots, "key").select(*pairs.columns)), similarity), "neardup-pairs")

    wanted = members.select("node").distinct().join(classes, "node")
    reps = wanted.select("rep").distinct()
    texts = ids.join(reps, ids.id.eqNullSafe(reps.rep), "left_semi")
    sets = map_texts(texts, "text", ["id"], "k1 long, k2 long, shingles binary", _sets)
    sets = sets.join(wanted, [sets.k1 == wanted.k1, sets.k2 == wanted.k2, sets.id.eqNullSafe(wanted.rep)]).select("node", "shingles")
    sets = written(sets, "neardup-sets")

    links = written(_links(tested, sets, similarity), "neardup-links")
    roots = components(links)
    rest = written(_open_links(large, roots, sets, similarity), "neardup-links")
    if not rest.isEmpty():
        roots = components(links.unionByName(rest))

    grouped = classes.join(roots, "node", "left").select(*keys, "rep", F.coalesce("root", "node").alias("root"))
    least = grouped.groupBy("root").agg(F.min("rep").alias("class_id"))
    named = written(grouped.join(least, "root").select(*keys, "class_id", "root"), "neardup-named")
    known = features.where("k1 IS NOT NULL").select("id", *keys).join(named, keys)
    unknown = features.where("k1 IS NULL").select("id", *keys, F.col("id").alias("class_id"), F.lit(None).cast("long").alias("root"))
    return known.select("id", *keys, "class_id", "root").unionByName(unknown), features


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each group, that with the least id; documents without a text all stay.

    Where ids repeat, one row of the least id stays, told apart by its text.
    """
    members, features = near_duplicate_classes(docs, id_col, text, **options)
    members = written(members, "neardup-members")
    count = features.agg(F.count("*").alias("n"), F.count("id").alias("ids"), F.countDistinct("id").alias("different")).first()
    leaders = members.where(F.col("id") == F.col("class_id"))
    if count.n == count.different:
        chosen = leaders.select(F.col("id").alias(id_col))
        return docs.join(chosen, docs[f"`{id_col}`"] == chosen[f"`{id_col}`"], "left_semi")
    names = [fresh(docs, "k1"), fresh(docs, "k2")]
    keyed = map_texts(docs, text, docs.columns, f"`{names[0]}` long, `{names[1]}` long", _keys)
    leaders = members.where("k1 IS NOT NULL").groupBy("root").agg(F.min(F.struct(F.when(F.col("id").isNotNull(), 0).otherwise(1).alias("last"), "id", "k1", "k2")).alias("x")).select("x.*")
    same = [keyed[f"`{id_col}`"].eqNullSafe(leaders.id), keyed[names[0]] == leaders.k1, keyed[names[1]] == leaders.k2]
    one = keyed.join(leaders, same, "left_semi").dropDuplicates([id_col, *names])
    return one.unionByName(keyed.where(column(names[0]).isNull())).drop(*names)


def _keys():
    def scan(texts):
        key = [(None, None) if t is None else _class_key(t, word_list(t)) for t in texts]
        return None, ([k[0] for k in key], [k[1] for k in key])

    return scan
