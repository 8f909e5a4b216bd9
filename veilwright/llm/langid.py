"""Language identification with segmentation-marginalised unigrams.

The vocabulary is a public byte-pair vocabulary, fixed beforehand; its files are not changed. Each
language has a probability for every piece. The probability of a word is the sum over all ways to cut
it into pieces, which a forward pass adds up; a text's is the product over its words. Pieces do not
cross words, so that equals a forward pass over the text.

Learning is expectation maximisation over the distinct words of each language with their counts, which
one grouped sum over all learning documents gives. A round is a map over the words (a forward and a
backward pass, then expected counts of pieces) and a grouped sum; what comes back to the driver is one
number for each piece and language. Scoring is a map over the documents.
"""

from __future__ import annotations

import base64
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwright.llm.common import fresh, map_texts, pieces
from veilwright.sources.scratch import written

ROUNDS = 3
#: Added to each expected count.
SMOOTH = 0.05
#: Cells (word places by languages) that one pass of the lattice holds.
CELLS = 2_000_000
#: Words of more bytes are taken with a scale for each stretch of ``STRETCH`` bytes, so that nothing vanishes.
PLAIN_MOST, STRETCH = 40, 8
#: Words counted before they are handed on, and word scores remembered.
COUNTED, REMEMBERED = 300_000, 300_000
#: Words up to these lengths are taken together, longer ones by powers of two.
SIZES = (4, 6, 8, 10, 12, 14, 16, 20, 24, 32, PLAIN_MOST, *(1 << k for k in range(6, 41)))
#: Words that one pass takes, and bytes of text.
TAKEN, TEXT_BYTES = 100_000, 12 << 20
#: A piece is found by so many bits of its code.
SLOT_BITS = 20
#: Languages of one model, whose chances are broadcast together.
LANGUAGES_MOST = 200
UNDETERMINED = "und"

#: ASCII letters in lower case and bytes of other characters; the rest is blank.
LETTER_BYTES = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)


def vocabulary_path(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read_vocabulary(path: str) -> list[bytes]:
    """Pieces that a lower-case word, with a blank before it, can hold; all single bytes are among them."""
    with open(path, "rb") as f:
        found = {base64.b64decode(line.split()[0]) for line in f}
    fit = {p for p in found if p == b" " or not p.removeprefix(b" ").translate(None, LETTER_BYTES[0x61:0x7B] + bytes(range(0x80, 0x100)))}
    return sorted(fit | {b" "} | {bytes([b]) for b in (*range(0x61, 0x7B), *range(0x80, 0x100))})


def hold_words(text: bytes | None) -> list[bytes]:
    """The words of a text, whole, each with a blank before it."""
    return [b" " + w for w in text.translate(LETTER_BYTES).split()] if text else []


def has_letter(text: bytes | None) -> bool:
    if not text:
        return False
    if text.translate(None, bytes(b for b in range(256) if not chr(b).isalpha() or b >= 0x80)):
        return True
    return not text.isascii() and any(c.isalpha() for c in text.decode())


class Lattice:
    """Which piece covers which stretch of which word; words of one length at a time."""

    def __init__(self, vocabulary: list[bytes]) -> None:
        self.size = len(vocabulary)
        self.codes = np.array([*(self._code(p) for p in vocabulary), 0], np.uint64)
        self.lengths = sorted({len(p) for p in vocabulary})
        self.powers = np.array([pow(int(_BASE), k, 2**64) for k in range(self.lengths[-1] + 1)], np.uint64)
        # Tables from bits of the code to the piece; what finds its slot taken goes to the next table,
        # and the slot is marked, so that only its visitors look there too.
        self.tables: list[tuple[np.uint64, np.ndarray, np.ndarray]] = []
        rest = np.arange(self.size)
        while len(rest):
            factor = _BASE * np.uint64(2 * len(self.tables) + 1)
            slots = (self.codes[rest] * factor) >> np.uint64(64 - SLOT_BITS)
            table = np.full(1 << SLOT_BITS, self.size, np.int32)
            table[slots[::-1]] = rest[::-1]
            late = table[slots] != rest
            shared = np.zeros(1 << SLOT_BITS, bool)
            shared[slots[late]] = True
            self.tables.append((factor, table, shared))
            rest = rest[late]

    @staticmethod
    def _code(piece: bytes) -> int:
        value = 0
        for b in piece:
            value = (value * int(_BASE) + b + 1) % 2**64
        return value

    def by_length(self, words: list[bytes], languages: int = 1):
        """``(places in the list, their lengths, size, codes)`` of words of about one length, filled up to ``size``.

        ``codes`` has a row for each prefix. What lies behind a word's end matches no piece.
        """
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        group = np.searchsorted(SIZES, lengths)
        for g in np.unique(group).tolist():
            at = np.flatnonzero(group == g)
            n = int(lengths[at].max())
            for some in np.array_split(at, -(-len(at) // max(1, CELLS // ((n + 1) * max(1, languages))))):
                letters = np.frombuffer(b"".join([words[i].ljust(n, b"\0") for i in some]), np.uint8).reshape(len(some), n)
                prefix = np.zeros((n + 1, len(some)), np.uint64)
                for k in range(n):
                    prefix[k + 1] = prefix[k] * _BASE + letters[:, k] + np.uint64(1)
                yield some, lengths[some], n, prefix

    def pieces(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of ``code`` that are a piece's, and which."""
        rows, found, asked = [], [], None
        for factor, table, shared in self.tables:
            own = code if asked is None else code[asked]
            slot = (own * factor) >> np.uint64(64 - SLOT_BITS)
            here = table[slot]
            hit = np.flatnonzero(self.codes[here] == own)
            rows.append(hit if asked is None else asked[hit])
            found.append(here[hit])
            more = np.flatnonzero(shared[slot])
            asked = more if asked is None else asked[more]
            if not len(asked):
                break
        return np.concatenate(rows), np.concatenate(found)

    def arcs(self, prefix: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``(begins, words, pieces, bounds)`` of all stretches that are a piece; those that end at j lie from ``bounds[j]`` to ``bounds[j + 1]``."""
        many = prefix.shape[1]
        begins, words, found, ends = [], [], [], []
        for d in self.lengths:
            if d > n:
                break
            rows, own = self.pieces((prefix[d:] - prefix[:-d] * self.powers[d]).ravel())
            begin = rows // many
            begins.append(begin.astype(np.int32))
            words.append((rows - begin * many).astype(np.int32))
            found.append(own)
            ends.append(begins[-1] + np.int32(d))
        end = np.concatenate(ends)
        order = np.argsort(end.astype(np.uint16) if n < 1 << 16 else end, kind="stable")
        bounds = np.concatenate([[0], np.cumsum(np.bincount(end, minlength=n + 1))])
        return np.concatenate(begins)[order], np.concatenate(words)[order], np.concatenate(found)[order], bounds

    def forward(self, prefix: np.ndarray, n: int, chance: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
        """Sums over all segmentations of each prefix of each word, the logarithms of their scales, and the arcs.

        Sums and scales have a row for each place, then words, then languages. A sum is ``alpha *
        exp(scale)``; scales change every ``STRETCH`` places of a long word. For each place there is
        ``(begins, words, pieces, weight)``, the weight as it connects the scaled sums of both ends.
        """
        begins, words, found, bounds = self.arcs(prefix, n)
        many, languages = prefix.shape[1], chance.shape[1]
        alpha = np.zeros((n + 1, many, languages))
        scale = np.zeros((n + 1, many, languages) if n > PLAIN_MOST else 1)
        alpha[0] = 1
        steps = []
        for j in range(1, n + 1):
            own = slice(bounds[j], bounds[j + 1])
            i, w, p = begins[own], words[own], found[own]
            weight = chance[p]
            if n > PLAIN_MOST:
                scale[j] = scale[j - 1]
                if j % STRETCH == 1 and j > 1:  # what is 0 there lies behind the word's end
                    scale[j] += np.log(np.where(alpha[j - 1] > 0, alpha[j - 1], 1))
                weight = weight * np.exp(scale[i, w] - scale[j, w])
            terms = alpha[i, w] * weight
            for k in range(languages):
                alpha[j, :, k] = np.bincount(w, terms[:, k], many)
            steps.append((i, w, p, weight))
        return alpha, scale, steps

    def scores(self, words: list[bytes], chance: np.ndarray) -> np.ndarray:
        """Log probability of each word in each language; ``chance`` is pieces by languages."""
        out = np.zeros((len(words), chance.shape[1]))
        for at, length, n, prefix in self.by_length(words, chance.shape[1]):
            alpha, scale, _ = self.forward(prefix, n, chance)
            each = np.arange(len(at))
            out[at] = np.log(alpha[length, each]) + (scale[length, each] if n > PLAIN_MOST else 0)
        return out

    def expected(self, words: list[bytes], counts: np.ndarray, chance: np.ndarray) -> np.ndarray:
        """How often each piece is expected in words of one language that occur ``counts`` times."""
        total = np.zeros(self.size)
        for at, length, n, prefix in self.by_length(words):
            alpha, _, steps = self.forward(prefix, n, chance[:, None])
            alpha = alpha[:, :, 0]
            beta, each = np.zeros((n + 1, len(at))), np.arange(len(at))
            beta[length, each] = 1 / alpha[length, each]
            seen = []
            for j in range(n, 0, -1):
                i, w, _, weight = steps[j - 1]
                weight = weight[:, 0] * beta[j, w]
                beta[i, w] += weight  # a begin and a word come once for one end
                seen.append(alpha[i, w] * weight * counts[at[w]])
            total += np.bincount(np.concatenate([step[2] for step in reversed(steps)]), np.concatenate(seen), self.size)
        return total


class Model:
    """Languages, the vocabulary, and chances of pieces by language."""

    def __init__(self, languages: list[str], vocabulary: list[bytes], chance: np.ndarray) -> None:
        self.languages, self.vocabulary, self.chance = languages, vocabulary, chance
        # What a worker has scored with this model; its next task finds it here.
        self.place: dict[bytes, int] = {}
        self.known = np.zeros((0, len(languages)))


def count_words(labelled: DataFrame) -> DataFrame:
    """``(lang, word, n)`` over all rows of ``(lang, text)``."""

    def count(batches):
        total: Counter = Counter()

        def out():
            keys = list(total)
            batch = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.binary()), pa.array([total[k] for k in keys], pa.int64())], names=["lang", "word", "n"])
            total.clear()
            return batch

        for batch in batches:
            for part in pieces(batch, 1):
                by_lang: dict[str, list[bytes]] = {}
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    by_lang.setdefault(lang, []).extend(hold_words(text))
                for lang, words in by_lang.items():
                    for word, n in Counter(words).items():
                        total[lang, word] += n
                if len(total) >= COUNTED:
                    yield out()
        yield out()

    return labelled.mapInArrow(count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def learn(labelled: DataFrame, vocabulary_file: str | None = None, rounds: int = ROUNDS, languages_most: int = LANGUAGES_MOST) -> list[Model]:
    """Models of rows ``(lang, text)``, one for each ``languages_most`` languages; rows without a lang or a text are left out.

    A language is learned from its own words alone, so which others share its model changes nothing.
    """
    vocabulary = read_vocabulary(vocabulary_file or vocabulary_path())
    words = written(count_words(labelled.where("lang IS NOT NULL AND text IS NOT NULL")), "langid-words")
    languages = sorted(r.lang for r in words.select("lang").distinct().collect())  # names only
    blocks = [languages[k : k + languages_most] for k in range(0, len(languages), languages_most)]
    return [_learned(words if len(blocks) == 1 else words.where(F.col("lang").isin(block)), block, vocabulary, rounds) for block in blocks]


def _learned(words: DataFrame, languages: list[str], vocabulary: list[bytes], rounds: int) -> Model:
    """The model of some languages, from their words ``(lang, word, n)``."""
    spark = words.sparkSession
    chance = np.full((len(vocabulary), len(languages)), 1 / len(vocabulary))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(Model(languages, vocabulary, chance))

        def expect(batches, shared=shared):
            model = shared.value
            lattice = Lattice(model.vocabulary)
            total = np.zeros((len(model.vocabulary), len(model.languages)))
            waiting: dict[str, tuple[list, list]] = {lang: ([], []) for lang in model.languages}

            def take(lang):
                own, n = waiting[lang]
                if own:
                    k = model.languages.index(lang)
                    total[:, k] += lattice.expected(own, np.array(n, np.float64), model.chance[:, k])
                    waiting[lang] = [], []

            for batch in batches:
                for lang, word, n in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                    waiting[lang][0].append(word)
                    waiting[lang][1].append(n)
                for lang in model.languages:
                    if len(waiting[lang][0]) >= TAKEN:
                        take(lang)
            for lang in model.languages:
                take(lang)
            piece, k = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(k), pa.array(total[piece, k])], names=["piece", "lang", "n"])

        found = words.mapInArrow(expect, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        weight = np.full((len(vocabulary), len(languages)), SMOOTH)
        weight[found.piece.to_numpy(), found.lang.to_numpy()] += found.n.to_numpy()
        chance = weight / weight.sum(axis=0)
    return Model(languages, vocabulary, chance)


def held_out(id_: Column) -> Column:
    """Whether a document is kept from learning: its id's checksum leaves no remainder. A null id counts as ''."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def predict(docs: DataFrame, models: list[Model], keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns with ``lang_pred`` and ``score``, the posterior of that language among all, each as likely beforehand.

    Null texts and texts without a letter are ``und`` with score 0; so is everything where no language
    was learned. An empty table gives no rows. A kept column with the name of a result gets ``_`` at its
    end. Of several models each reads the texts once, and the best language so far goes along.
    """
    carried: tuple[str, ...] = ()
    for model in models[:-1]:
        names = carried or tuple(fresh(docs, n) for n in ("best_lang", "best_log", "sum_log"))
        fields = f"`{names[0]}` string, `{names[1]}` double, `{names[2]}` double"
        docs = written(map_texts(docs, text, [c for c in docs.columns if c not in carried], fields, _scorer(docs, model, False), carried, limit=TEXT_BYTES), "langid-scores")
        carried = names
    last = models[-1] if models else Model([], [b" "], np.zeros((1, 0)))
    return map_texts(docs, text, keep, "lang_pred string, score double", _scorer(docs, last, True), carried, limit=TEXT_BYTES)


def _scorer(docs: DataFrame, model: Model, last: bool):
    """Setup of a map: the best language of a text, its log probability, and the logarithm of all languages' sum; at last, the result."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def setup():
        own = shared.value
        lattice = Lattice(own.vocabulary)

        def totals(texts: list[bytes | None]):
            words = [hold_words(t) for t in texts]
            place = own.place
            new = {w for of in words for w in of if w not in place}
            if len(place) + len(new) > REMEMBERED:
                place.clear()
                own.known = own.known[:0]
                new = {w for of in words for w in of}
            if new:
                listed = sorted(new)
                place.update(zip(listed, range(len(own.known), len(own.known) + len(listed)), strict=True))
                own.known = np.vstack([own.known, lattice.scores(listed, own.chance)])
            for text, of in zip(texts, words, strict=True):
                yield own.known[np.fromiter(map(place.__getitem__, of), np.int64, len(of))].sum(axis=0) if of and own.languages and has_letter(text) else None

        def scan(texts, langs=None, tops=None, sums=None):
            out: list[tuple] = []
            before = zip(langs, tops, sums, strict=True) if langs else repeat((None, -np.inf, -np.inf))
            for total, (lang, top, whole) in zip(totals(texts), before, strict=False):
                if total is not None:
                    best = int(np.argmax(total))
                    here = float(total[best])
                    whole = float(np.logaddexp(-np.inf if lang is None else whole, here + np.log(np.exp(total - here).sum())))
                    if lang is None or here > top:
                        lang, top = own.languages[best], here
                out.append((lang, top, whole))
            if last:
                return None, ([x[0] or UNDETERMINED for x in out], [min(1.0, float(np.exp(x[1] - x[2]))) if x[0] else 0.0 for x in out])
            return None, [list(c) for c in zip(*out, strict=True)] if out else [[]] * 3

        return scan

    return setup
