"""Pattern detection: a text table in, the same table with an array of findings out.

The patterns are unrolled into one projection, each behind a cheap gate, so the job is a single
map over the texts: no join with the pattern table, no shuffle, no Python.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwright.functions import validators
from veilwright.functions.dialect import to_java
from veilwright.functions.spans import FINDING, built_once, empty, in_order, let, match_starts, piece, settled, wide_form
from veilwright.sources.patterns import CONFIDENCE_FLOOR, CONTEXT_BOOST, CONTEXT_REACH, Pattern


# Words with a digit; the long s and the Kelvin sign fold to word characters.
_WORD = "0-9A-Za-z_ſ\u212a"
WORDS = f"(?<![{_WORD}])[A-Za-z_ſ\u212a]*+[0-9][{_WORD}]*+"


def lower_text(text: Column) -> Column:
    """Lower case that keeps every character in its place (a dotted capital I would grow)."""
    return F.lower(F.replace(text, F.lit("İ"), F.lit("i")))


def any_word(haystack: Column, words: tuple[str, ...]) -> Column:
    test = F.lit(False)
    for w in words:
        test = test | haystack.contains(w)
    return test


def sql_text(value: str) -> str:
    """A string literal of Spark SQL."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def holds(column: str, word: str) -> str:
    return f"contains({column}, {sql_text(word)})"


def _gate(p: Pattern, text: str) -> str:
    """Condition a text must meet before the pattern runs."""
    tests = []
    for term in p.gate:
        kind, _, regex = term.partition(":")
        if kind in ("#digit", "#mark"):
            tests.append("__" + kind[1:])
        elif kind in ("#class", "#run", "#word"):
            column = {"#class": text, "#run": "__runs", "#word": "__words"}[kind]
            tests.append(f"{column} RLIKE {sql_text(to_java(regex))}")
        else:
            tests.append("(" + " OR ".join(holds("__folded", w) for w in term.split("|")) + ")")
    if p.required:
        tests.append("(" + " OR ".join(holds("__lower", w) for w in p.context) + ")")
    return " AND ".join(tests)


def _tried(sets: tuple[tuple[Pattern, ...], ...], text: str, gated: bool) -> tuple[list[tuple[str, str]], list[tuple[int, ...]]]:
    """Expressions with their gates, those that several sets share once; and for each set the numbers of its own."""
    known: dict[tuple, int] = {}
    places = []
    for patterns in sets:
        met: Counter = Counter()
        own = []
        for p in patterns:
            tried = (to_java(p.regex, p.edges), _gate(p, text) if gated else "")
            met[tried] += 1  # a set may have two patterns of one expression
            own.append(known.setdefault((*tried, met[tried]), len(known) + 1))
        places.append(tuple(own))
    return [key[:2] for key in known], places


def _tries(tried: list[tuple[str, str]], text: str) -> str:
    """Matches of every expression, as one array; those without a match are left out."""
    items = []
    for k, (regex, gate) in enumerate(tried):
        found = f"regexp_extract_all({text}, {sql_text(regex)}, 0)"
        if gate:
            found = f"CASE WHEN {gate} THEN {found} END"
        items.append(f"named_struct('k', {k + 1}, 'm', {found})")
    return f"filter(array({', '.join(items)}), h -> size(h.m) > 0)"


def _facts(patterns: tuple[Pattern, ...], places: tuple[int, ...], size: int) -> str:
    """The pattern rows as a constant array, looked up by the number of the hit; null for those of other sets."""
    rows = ["NULL"] * size
    for p, k in zip(patterns, places, strict=True):
        words = ", ".join(sql_text(w) for w in p.context)
        boosted = min(round(p.score + CONTEXT_BOOST, 4), 1.0)
        rows[k - 1] = (
            f"named_struct('ord', {p.ord}, 'rule_id', {sql_text(p.rule_id)}, 'label', {sql_text(p.label)}, "
            f"'regex', {sql_text(to_java(p.regex, p.edges))}, 'score', {p.score}D, 'boosted', {boosted}D, "
            f"'context', cast(array({words}) AS array<string>), 'validator', {sql_text(p.validator)}, "
            f"'required', {str(p.required).lower()})"
        )
    return f"array({', '.join(rows)})"


def _finding(h: Column, value: Column, start: Column, confidence: Column, layer: str, layer_ord: int) -> Column:
    return F.struct(
        start.alias("start"),
        (-F.length(value)).alias("neg_len"),
        F.lit(layer_ord).alias("layer_ord"),
        h.ord.alias("ord"),
        (start + F.length(value)).alias("end"),
        h.rule_id.alias("rule_id"),
        h.label.alias("label"),
        value.alias("value"),
        confidence.alias("confidence"),
        F.lit(layer).alias("layer"),
    )


def near(lower: Column, wide: Column, start: Column, end: Column, words: Column, reach: int) -> Column:
    """One of the words stands in the lower-case text within ``reach`` characters of the span."""
    first = F.greatest(start - reach, F.lit(0))
    last = F.least(end + reach, F.length(lower))
    return let(
        piece(lower, wide, first, last - first), lambda w: F.exists(words, lambda k: F.contains(w, k))
    )


@built_once
def _prepared(text: str) -> tuple[list[Column], list[Column]]:
    """Helper columns of a text, in two steps; each is computed once per text."""
    body = F.col(text)
    first = [
        lower_text(body).alias("__lower"),
        body.rlike("[0-9]").alias("__digit"),
        body.rlike("[:=]").alias("__mark"),
    ]
    words = F.array_join(F.regexp_extract_all(body, F.lit(WORDS), 0), " ")
    second = [
        F.replace("__lower", F.lit("ſ"), F.lit("s")).alias("__folded"),
        F.when(F.col("__digit"), F.regexp_replace(body, "[^0-9]{3,}", "~")).alias("__runs"),
        F.when(F.col("__digit"), words).alias("__words"),
    ]
    return first, second


@built_once
def _hits(sets: tuple[tuple[Pattern, ...], ...], text: str, gated: bool) -> Column:
    return F.expr(_tries(_tried(sets, f"`{text}`", gated)[0], f"`{text}`")).alias("__hits")


@built_once
def _findings(sets: tuple[tuple[Pattern, ...], ...], which: int, text: str, layer: str, layer_ord: int, gated: bool) -> Column:
    """Findings of a set of patterns in a text, from its hits."""
    body, lower = F.col(text), F.col("__lower")
    patterns = sets[which]
    tried, places = _tried(sets, f"`{text}`", gated)
    facts = F.expr(_facts(patterns, places[which], len(tried)))
    hits = F.col("__hits")
    if len(patterns) < len(tried):
        hits = F.filter(hits, lambda h: F.array_contains(F.array(*[F.lit(k) for k in places[which]]), h.k))
    checks = {p.validator for p in patterns}
    some_context = any(p.context for p in patterns)

    def confidence(f: Column, value: Column, start: Column) -> Column:
        sure = f.score
        if some_context:
            close = near(
                lower, F.col("__wide_lower"), start, start + F.length(value), f.context, CONTEXT_REACH
            )
            sure = (
                F.when(F.size(f.context) == 0, f.score)
                .when(close, f.boosted)
                .when(~f.required, f.score)
            )
        return F.when(validators.passes(f.validator, value, checks), sure)

    def findings_of(h: Column) -> Column:
        return let(
            F.element_at(facts, h.k),
            lambda f: F.filter(
                F.zip_with(
                    h.m,
                    F.slice(match_starts(body, f.regex, h.m), F.lit(1), F.size(h.m)),
                    lambda v, s: _finding(f, v, s, confidence(f, v, s), layer, layer_ord),
                ),
                lambda x: x.confidence >= CONFIDENCE_FLOOR,
            ),
        )

    found = in_order(F.flatten(F.transform(hits, findings_of)))
    return settled(F.when(F.size("__hits") > 0, found).otherwise(empty(FINDING)))


def detect(
    texts: DataFrame,
    patterns: list[Pattern],
    text: str = "text",
    out: str = "findings",
    layer: str = "presidio",
    layer_ord: int = 1,
    gated: bool = True,
) -> DataFrame:
    """Add ``out``, the ordered findings of all patterns in column ``text``."""
    return detect_sets(texts, {out: patterns}, text, layer, layer_ord, gated)


def detect_sets(
    texts: DataFrame,
    sets: dict[str, list[Pattern]],
    text: str = "text",
    layer: str = "presidio",
    layer_ord: int = 1,
    gated: bool = True,
) -> DataFrame:
    """Add a column for each set of patterns, as ``detect`` does for one.

    A text is prepared once, and an expression that several sets share is tried once.
    """
    columns = [c for c in texts.columns if c not in sets]
    names = [n for n, patterns in sets.items() if patterns]
    rows = tuple(tuple(sets[n]) for n in names)
    none = [empty(FINDING).alias(n) for n in sets if n not in names]
    if not names:
        return texts.select(*columns, *none)
    first, second = _prepared(text)
    return (
        texts.select(*columns, *first)
        .select("*", *second)
        .select(*columns, "__lower", _hits(rows, text, gated))
        .withColumn("__wide_lower", F.when(F.size("__hits") > 0, wide_form(F.col("__lower"))))
        .select(*columns, *[_findings(rows, k, text, layer, layer_ord, gated).alias(n) for k, n in enumerate(names)], *none)
    )


def finding_rows(df: DataFrame, keys: list[str], findings: str = "findings") -> DataFrame:
    """One row per finding."""
    return df.select(*keys, F.explode(findings).alias("f")).select(
        *keys,
        F.col("f.rule_id").alias("rule_id"),
        F.col("f.ord").alias("pattern_ord"),
        F.col("f.label").alias("label"),
        F.col("f.value").alias("value"),
        F.col("f.start").alias("start"),
        F.col("f.end").alias("end"),
        F.col("f.confidence").alias("confidence"),
        F.col("f.layer").alias("layer"),
    )
