"""Masking: text and findings in, clean text and the applied spans out.  One row stays one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwright.functions.spans import applied, built_once, mask, maximal, placeholder, rewrite, settled, wide_form


@built_once
def _marks(findings: str, drop_contained: bool) -> Column:
    return settled(applied(F.col(findings), drop_contained))


@built_once
def _masked(text: str, marks: str) -> Column:
    return settled(mask(F.col(text), F.col("__wide"), F.col(marks)))


def redact(texts: DataFrame, text: str = "text", findings: str = "findings") -> DataFrame:
    """Add ``redacted_text`` and ``applied`` (label, original, start, end)."""
    body = F.col(text)
    marked = texts.withColumn("__marks", _marks(findings, True)).withColumn(
        "__wide", F.when(F.size("__marks") > 0, wide_form(body))
    )
    out = marked.withColumn("redacted_text", _masked(text, "__marks"))
    return out.withColumn("applied", applied_view(F.col("__marks"))).drop("__marks", "__wide")


def applied_view(marks: Column) -> Column:
    return F.transform(
        marks,
        lambda m: F.struct(
            placeholder(m.label).alias("label"),
            m.value.alias("original"),
            m.start.alias("start"),
            m.end.alias("end"),
        ),
    )


def mask_layer(
    texts: DataFrame, text: str = "text", findings: str = "findings", masked: str = "masked", marks: str = "marks"
) -> DataFrame:
    """Add the text a later layer sees, and the marks that map its positions back.

    Unlike ``redact`` this step lets a span inside a refused span stand.
    """
    body = F.col(text)
    return (
        texts.withColumn(marks, _marks(findings, False))
        .withColumn("__wide", F.when(F.size(marks) > 0, wide_form(body)))
        .withColumn(masked, _masked(text, marks))
        .drop("__wide")
    )


def escaped(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def highlight(texts: DataFrame, text: str = "text", findings: str = "findings") -> DataFrame:
    """Add ``highlighted``: the text as HTML with the spans in <mark> tags."""
    body = F.col(text)
    marked = texts.withColumn("__marks", _marks(findings, False)).withColumn(
        "__wide", F.when(F.size("__marks") > 0, wide_form(body))
    )
    html = rewrite(
        body,
        F.col("__wide"),
        F.col("__marks"),
        lambda m: F.concat(F.lit("<mark>"), escaped(m.value), F.lit("</mark>")),
        escaped,
    )
    return marked.withColumn("highlighted", settled(html)).drop("__marks", "__wide")


def maximal_spans(texts: DataFrame, findings: str = "findings", out: str = "maximal") -> DataFrame:
    """Add the findings that lie inside no earlier finding."""
    return texts.withColumn(out, settled(maximal(F.col(findings))))
