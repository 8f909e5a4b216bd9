"""The main job: texts in, clean texts with their findings out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwright.functions.spans import settled
from veilwright.operators.redact import redact
from veilwright.operators.reuse import scan_distinct
from veilwright.plans.cascade import Layer, Settings, cascade, default_layers


def without_allowed(df: DataFrame, words: list[str], findings: str = "findings") -> DataFrame:
    """Drop the findings whose value, in any case, is on the allow list."""
    if not words:
        return df
    allowed = [w.lower() for w in words]
    return df.withColumn(findings, settled(F.filter(findings, lambda f: ~F.lower(f.value).isin(*allowed))))


def scan_and_redact(
    texts: DataFrame,
    layers: list[Layer] | None = None,
    settings: Settings = Settings(),
    allowed: list[str] | None = None,
    reuse: bool = False,
    id_col: str = "id",
    text: str = "text",
) -> DataFrame:
    """``(id, text, ...) -> (id, redacted_text, findings, applied, layers)``.

    One map without a shuffle.  With ``reuse`` equal texts are scanned once and the result is joined
    back: worth its shuffle when copies are many or a model layer is in the list.
    """
    layers = layers or default_layers(settings)

    def job(df: DataFrame) -> DataFrame:
        found = without_allowed(cascade(df, layers, text=text), allowed or [])
        return redact(found, text=text)

    if reuse:
        return scan_distinct(texts, job, id_col=id_col, text=text)
    return job(texts.select(id_col, text)).select(id_col, "redacted_text", "findings", "applied", "layers")
