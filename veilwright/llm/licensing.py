"""License scans with ordered signature rules, as DataFrame expressions.

Texts without a keyword stop at one expression. The others are brought to a plain form; each rule is
tried only where its own keyword occurs, and gives the places of its matches as lengths of what lies
between and inside them. Those lengths become rows, and running sums make them intervals. A detection
inside another one of the same or a better priority is suppressed: sorted by start, and longest first,
that is a running maximum of ends. Rows exist only for detections, so documents are never shuffled.
"""

from __future__ import annotations

import json
from dataclasses import asdict
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilwright.functions.spans import let
from veilwright.llm.common import column, fresh, kept_columns, kept_names
from veilwright.llm.licences import RESERVED, STEMS, Signature, signatures
from veilwright.sources.scratch import written

#: Before and after A-Z are in lower case.
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: Words of a phrase, and its label.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
GATE = rf"(?i)licen|(?:^|{NOT_WORD})(?:{'|'.join(STEMS)})"
SURE = {1: 1.0, 2: 0.75, 3: 0.5}


def plain_form(text: Column) -> Column:
    """Words in lower case (A-Z), two blanks before, between and after."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(F.concat(F.lit(" "), lower, F.lit(" ")), f"{NOT_WORD}+", "  ")


def _blanks(piece: Column) -> Column:
    return F.length(piece) - F.length(F.replace(piece, F.lit(" "), F.lit("")))


def _words_in(piece: Column) -> Column:
    return F.floor(_blanks(piece) / 2).cast("long")


def _phrases(plain: Column) -> Column:
    """``(label, n, first, last)`` of each phrase that occurs; places in words."""
    out = []
    for phrase, label in PHRASES:
        pieces = F.split(plain, " " + phrase.replace(" ", "  ") + " ", -1)
        n_words = len(phrase.split())
        total = F.floor(_blanks(plain) / 2).cast("long") - 1
        out.append(
            F.when(
                F.contains(plain, F.lit(phrase.replace(" ", "  "))),
                F.struct(
                    F.lit(label).alias("label"), (F.size(pieces) - 1).cast("long").alias("n"),
                    _words_in(F.element_at(pieces, 1)).alias("first"), (total - _words_in(F.element_at(pieces, -1)) - n_words).alias("last"),
                ),
            )
        )
    return F.filter(F.array(*out), lambda x: x.isNotNull() & (x.n > 0))


def _rules(rules: tuple[Signature, ...]) -> Column:
    """The rules as one constant."""
    rows = json.dumps([asdict(r) for r in rules])
    return F.from_json(F.lit(rows), "array<struct<number:int,priority:int,label:string,keywords:array<string>,regex:string>>")


def _hits(plain: Column, rules: tuple[Signature, ...]) -> Column:
    """For each rule with a match: lengths before each match, and of each match."""
    telling = F.array(*[F.lit(w) for w in sorted({w for r in rules for w in r.keywords})])
    present = F.array_intersect(F.split(plain, "  "), telling)
    tried = let(present, lambda words: F.filter(_rules(rules), lambda r: F.forall(r.keywords, lambda k: F.array_contains(words, k)) & F.rlike(plain, r.regex)))
    return F.transform(
        tried,
        lambda r: F.struct(
            r.number.alias("number"), r.priority.alias("priority"), r.label.alias("label"),
            F.zip_with(
                F.transform(F.split(plain, r.regex, -1), lambda x: F.length(x)),
                F.transform(F.regexp_extract_all(plain, r.regex, F.lit(0)), lambda x: F.length(x)),
                lambda gap, size: F.struct(gap.alias("gap"), size.alias("size")),
            ).alias("cuts"),
        ),
    )


def detections(found: DataFrame, row: str, hits: str) -> DataFrame:
    """``(row, number, priority, label, start, end)`` of the matches that no other one suppresses."""
    rules = found.select(column(row).alias("row"), F.explode(column(hits)).alias("hit")).select("row", "hit.number", "hit.priority", "hit.label", F.posexplode("hit.cuts").alias("k", "cut"))
    rules = rules.where("cut.size IS NOT NULL")
    so_far = Window.partitionBy("row", "number").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("cut.gap") + F.col("cut.size")).over(so_far)
    placed = rules.select("row", "number", "priority", "label", end.alias("end"), (end - F.col("cut.size")).alias("start"))
    earlier = Window.partitionBy("row").orderBy("start", F.desc("end"), "priority", "number").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.lit(False)
    for p in sorted(SURE):
        reach = F.when(F.col("priority") == p, F.max(F.when(F.col("priority") <= p, F.col("end"))).over(earlier) >= F.col("end")).otherwise(reach)
    return placed.withColumn("inside", F.coalesce(reach, F.lit(False))).where("NOT inside").drop("inside")


#: Names of the results, and of what is added on the way to them.
RESULTS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "own", "best", "n_reserved")


def scan(docs: DataFrame, keep: list[str], text: str = "text", rules: tuple[Signature, ...] | None = None) -> DataFrame:
    """``keep`` columns with ``n_words, n_base, first_word, last_word, base_labels, labels, score``.

    Null and empty texts have no words and no labels; their score is 0. Repeated rows are scanned row by
    row; an empty table gives no rows. A kept column with the name of a result gets ``_`` at its end.
    """
    rules = signatures() if rules is None else rules
    own = kept_names(keep, list(RESULTS))
    kept = docs.select(*kept_columns(keep, list(RESULTS)))
    names = {n: fresh(kept, n) for n in ("row", "plain", "phrases", "hits", "lower", "whole")}
    plain, phrases, hits = (column(names[n]) for n in ("plain", "phrases", "hits"))
    whole = F.coalesce(column(text), F.lit(""))
    seen = docs.select(
        *kept_columns(keep, list(RESULTS)), F.monotonically_increasing_id().alias(names["row"]),
        F.size(F.array_remove(F.split(whole, f"{NOT_WORD}+", -1), "")).cast("long").alias("n_words"),
        F.lower(whole).alias(names["lower"]), whole.alias(names["whole"]),
    )
    # Plain substrings first: they cost a fraction of the expression, which only looks where one occurs.
    some = reduce(or_, [F.contains(column(names["lower"]), F.lit(stem)) for stem in ("licen", *STEMS)])
    gated = F.when(some, F.when(F.rlike(column(names["whole"]), F.lit(GATE)), plain_form(column(names["whole"]))))
    seen = seen.withColumn(names["plain"], gated).drop(names["lower"], names["whole"])
    seen = seen.withColumns({names["phrases"]: F.when(plain.isNotNull(), _phrases(plain)), names["hits"]: F.when(plain.isNotNull(), _hits(plain, rules))}).drop(names["plain"])
    found = written(seen, "license-scan")  # row numbers stay what they are from here on

    # Rights that are reserved are no license beside one that is named.
    named = F.col("label") != RESERVED
    best = detections(found, names["row"], names["hits"]).groupBy(F.col("row").alias(names["row"])).agg(
        F.collect_set(F.when(named, F.col("label"))).alias("own"), F.min(F.when(named, F.col("priority"))).alias("best"), F.count_if(~named).alias("n_reserved")
    )
    base = F.transform(F.coalesce(phrases, F.array()), lambda p: p.label)
    joined = found.join(best, names["row"], "left")
    listed = F.array_sort(F.array_distinct(F.concat(base, F.coalesce("own", F.array().cast("array<string>")))))
    listed = F.when((F.size(listed) == 0) & (F.col("n_reserved") > 0), F.array(F.lit(RESERVED))).otherwise(listed)
    sure = F.when(F.col("best") == 1, SURE[1]).when(F.col("best") == 2, SURE[2]).when(F.col("best") == 3, SURE[3]).when((F.size(base) > 0) | (F.col("n_reserved") > 0), 0.5).otherwise(0.0)
    return joined.select(
        *[column(own[c]) for c in keep], "n_words",
        F.aggregate(F.coalesce(phrases, F.array()), F.lit(0).cast("long"), lambda a, p: a + p.n).alias("n_base"),
        F.array_min(F.transform(phrases, lambda p: p["first"])).alias("first_word"), F.array_max(F.transform(phrases, lambda p: p["last"])).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"), F.array_join(listed, ",").alias("labels"), sure.alias("score"),
    )
