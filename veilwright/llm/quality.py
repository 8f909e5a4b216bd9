"""Quality rules as a short-circuit cascade of DataFrame expressions.

Every rule is a condition that rejects a text. A sample of rows from all partitions, as large for any
table, is written once; each rule is timed on it a few times, and one grouping gives which rules reject which sample rows together. The order is greedy: next
comes the rule that rejects most of the rows still left per second of its cost. The cascade is one
``CASE`` expression, so a text that a cheap rule rejects never meets the dear ones. The order changes
how long the job takes and the reason that is named, never the verdict.

All of it is one projection over the documents: no shuffle, no Python. Words of a text are compared by
64-bit hashes of 8-word windows inside that text.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from statistics import median

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwright.functions.spans import let, settled
from veilwright.llm.common import column, fresh, kept_columns
from veilwright.sources.scratch import written

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 8
#: Rows, as expected, of the sample that the order of the rules is chosen on, and how often each rule is timed on it.
SAMPLE_ROWS = 4000
TIMES = 3
SEED = 11


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def repeated_words(words: Column) -> Column:
    """Words that lie in an 8-word window found twice or more."""

    def doubled(hashes: Column) -> Column:
        n = F.size(hashes)
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        pairs = let(placed, lambda p: F.zip_with(F.slice(p, F.lit(1), n - 1), F.slice(p, F.lit(2), n - 1), lambda a, b: F.when(a.h == b.h, F.array(a.i, b.i))))
        places = F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull()))))
        return let(
            places,
            lambda p: F.aggregate(
                F.zip_with(F.slice(p, F.lit(1), F.size(p) - 1), F.slice(p, F.lit(2), F.size(p) - 1), lambda a, b: F.least(F.lit(REPEAT_WINDOW), b - a)),
                F.lit(REPEAT_WINDOW),
                lambda x, y: x + y,
            ),
        )

    def joined(step: int) -> Callable[[Column], Column]:
        def pairs(hashes: Column) -> Column:
            n = F.size(hashes) - step
            return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(1 + step), n), lambda a, b: F.xxhash64(a, b))

        return pairs

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    for step in (1, 2, 4):
        hashes = let(hashes, joined(step))
    count = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), doubled(h)).otherwise(0))
    return F.when(F.size(words) > REPEAT_WINDOW, count).otherwise(0).cast("long")


def doubled_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{SYMBOLS}]+", "")).cast("long")


@dataclass(frozen=True)
class Rule:
    """Rejects a row of ``(text, words, n_words, word_chars, n_symbols, ...)`` where ``reject`` is true."""

    name: str
    reject: Callable[[dict[str, Column]], Column]


#: The base of the contract: too short, or more than 30 % of the words repeated.
TOO_SHORT = Rule("too_short", lambda c: c["n_words"] < 20)
REPETITIVE = Rule("repetitive", lambda c: 100 * c["n_repeat_words"] > 30 * c["n_words"])
#: The method's own. Limits are shares, so that a long text is judged as a short one.
OWN_RULES = (
    Rule("symbols", lambda c: 10 * c["n_symbols"] > c["n_words"]),
    Rule("word_length", lambda c: (c["word_chars"] < 2 * c["n_words"]) | (c["word_chars"] > 25 * c["n_words"])),
    Rule("doubled_lines", lambda c: 2 * c["n_dup_lines"] > F.size(F.filter(F.split(c["text"], "\n"), lambda x: F.trim(x) != ""))),
    Rule("few_letters", lambda c: 2 * F.length(F.regexp_replace(c["text"], r"[^\p{L}\p{M}]+", "")) < c["word_chars"]),
    Rule("shouting", lambda c: 2 * F.length(F.regexp_replace(c["text"], r"[^\p{Lu}]+", "")) > c["word_chars"]),
    Rule("broken_off", lambda c: 2 * F.size(F.regexp_extract_all(c["text"], F.lit(r"(?m)(?:\.\.\.|…)[\x20\t\r]*$"), F.lit(0))) > F.size(F.split(c["text"], "\n"))),
)
RULES = (TOO_SHORT, REPETITIVE, *OWN_RULES)

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _prepared(docs: DataFrame, text: str, names: dict[str, str]) -> DataFrame:
    """The text (null as empty), its words, and the measures that cost little."""
    docs = docs.withColumn(names["text"], F.coalesce(column(text), F.lit("")))
    docs = docs.withColumn(names["words"], words_of(column(names["text"])))
    words = column(names["words"])
    return docs.withColumns(
        {
            names["n_words"]: F.size(words).cast("long"),
            names["word_chars"]: F.length(F.array_join(words, "")).cast("long"),
            names["n_symbols"]: symbols(column(names["text"])),
        }
    )


def _names(docs: DataFrame) -> dict[str, str]:
    return {n: fresh(docs, n) for n in ("text", "words", *MEASURES)}


def _inputs(names: dict[str, str], ready: tuple[str, ...]) -> dict[str, Column]:
    """What rules see; the dear measures are expressions, computed only where a rule is reached, unless ready."""
    c = {n: column(x) for n, x in names.items()}
    if "n_dup_lines" not in ready:
        c["n_dup_lines"] = doubled_lines(c["text"])
    if "n_repeat_words" not in ready:
        c["n_repeat_words"] = repeated_words(c["words"])
    return c


def order_rules(docs: DataFrame, text: str, rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejection per cost, measured on about ``rows`` rows, each as likely to be taken as any other.

    Long texts and copies are in the sample as often as in the table; nothing of it passes the driver.
    """
    texts = docs.select(column(text).alias("text"))
    share = min(1.0, rows / max(1, docs.count()))
    some = texts.sample(share, SEED) if share < 1 else texts
    sample = written(some.coalesce(docs.sparkSession.sparkContext.defaultParallelism), "quality-sample")
    names = _names(sample)
    ready = _prepared(sample, "text", names)
    inputs = _inputs(names, ())

    def seconds(value: Column) -> float:
        begin = time.perf_counter()
        ready.agg(F.sum(value.cast("int"))).collect()
        return time.perf_counter() - begin

    seconds(column(names["n_words"]))  # the first job pays for planning code that is not yet compiled
    timed = [(column(names["n_words"]), *(r.reject(inputs) for r in rules)) for _ in range(TIMES)]
    base, *each = (median(run) for run in zip(*[[seconds(value) for value in round_] for round_ in timed], strict=True))
    cost = [max(1e-3, own - base) for own in each]
    seen = ready.select(F.array(*[r.reject(inputs) for r in rules]).alias("hits")).groupBy("hits").count().collect()
    left = {tuple(r.hits): r["count"] for r in seen}
    order, rest = [], set(range(len(rules)))
    while rest:
        gain = {i: sum(n for hits, n in left.items() if hits[i]) / cost[i] for i in rest}
        best = min(rest, key=lambda i: (-gain[i], cost[i], i))
        left = {hits: n for hits, n in left.items() if not hits[best]}
        order.append(rules[best])
        rest.discard(best)
    return order


def cascade(rules: list[Rule], inputs: dict[str, Column]) -> Column:
    """Name of the first rule, in this order, that rejects; null where none does."""
    out = F.when(rules[0].reject(inputs), F.lit(rules[0].name))
    for rule in rules[1:]:
        out = out.when(rule.reject(inputs), F.lit(rule.name))
    return out


def measure(docs: DataFrame, keep: list[str], text: str = "text", rules: tuple[Rule, ...] = OWN_RULES) -> DataFrame:
    """``keep`` columns with the five measures, ``base_failed``, ``kept`` and ``rejected_by``.

    Null and empty texts have no words and fail the base as too short. Repeated rows are judged alike,
    row by row. An empty table gives no rows. A kept column with the name of a result gets ``_`` at its end.
    """
    order = order_rules(docs, text, rules)
    names = _names(docs)
    docs = _prepared(docs, text, names)
    c = {n: column(x) for n, x in names.items()}
    docs = docs.withColumns({names["n_dup_lines"]: doubled_lines(c["text"]), names["n_repeat_words"]: repeated_words(c["words"])})
    base = TOO_SHORT.reject(c) | REPETITIVE.reject(c)
    rejected = F.when(base, F.lit("base")).otherwise(cascade(order, c))
    docs = docs.select(*kept_columns(keep, [*MEASURES, "base_failed", "kept", "rejected_by"]), *[c[n].alias(n) for n in MEASURES], base.alias("base_failed"), rejected.alias("rejected_by"))
    return docs.withColumn("kept", F.col("rejected_by").isNull())


def keep_good(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that no rule rejects, with their own columns."""
    order = order_rules(docs, text, rules)
    names = _names(docs)
    verdict = fresh(docs, "rejected_by")
    ready = _prepared(docs, text, names)
    # Settled, else the filter would take its own copy of every expression down to the scan.
    return ready.withColumn(verdict, settled(cascade(order, _inputs(names, ())))).where(column(verdict).isNull()).select(*[column(c) for c in docs.columns])
