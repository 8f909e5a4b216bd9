"""The cascade: layers in order, each on the text that the layers before it have masked.

A layer is a function on DataFrames, not a callback per row.  The list of layers is walked on the
driver while the plan is built; the job that comes out is one map over the texts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwright.functions.spans import FINDING, built_once, empty, in_order, original_position, settled
from veilwright.operators.detect import detect_sets
from veilwright.operators.entropy import DEFAULT_LENGTH, DEFAULT_THRESHOLD, detect_entropy
from veilwright.operators.redact import mask_layer
from veilwright.sources.catalog import active_patterns, effective
from veilwright.sources.patterns import Pattern

# (texts, name of the text column, name of the findings column, position of the layer) -> texts
Scan = Callable[[DataFrame, str, str, int], DataFrame]


@dataclass(frozen=True)
class Layer:
    """``scan`` adds a findings column.  A layer that is not ready is skipped with a reason.

    ``failure`` names a column the scan may add: why it failed on that text, null where it did not.
    ``latency`` names one with the milliseconds it took; layers that are expressions run as one with others.
    ``keep`` decides which of the findings so far stay; a layer that has one adds none itself.
    ``adds`` names columns that the scan adds besides and that stay with the text.
    """

    name: str
    scan: Scan
    ready: bool = True
    skip_reason: str = "not ready"
    failure: str | None = None
    latency: str | None = None
    keep: Callable[[Column], Column] | None = None
    adds: tuple[str, ...] = ()


@dataclass(frozen=True)
class Settings:
    toggles: dict[str, bool] = field(default_factory=dict)
    profile: str = "compat"
    custom: tuple[tuple[str, str], ...] = ()
    entropy_threshold: float = DEFAULT_THRESHOLD
    entropy_length: int = DEFAULT_LENGTH
    gated: bool = True


def pattern_layer(settings: Settings = Settings(), also: dict[str, list[Pattern]] | None = None) -> Layer:
    """``also`` names columns with what other sets of patterns find in the text that the layer sees, in the same pass."""
    patterns, others = active_patterns(settings.toggles, settings.profile, list(settings.custom)), also or {}

    def scan(texts: DataFrame, text: str, out: str, position: int) -> DataFrame:
        return detect_sets(texts, {out: patterns, **others}, text=text, layer_ord=position, gated=settings.gated)

    return Layer("presidio", scan, adds=tuple(others))


def entropy_layer(settings: Settings = Settings()) -> Layer:
    state = effective(settings.toggles)

    def scan(texts: DataFrame, text: str, out: str, position: int) -> DataFrame:
        return detect_entropy(
            texts,
            settings.entropy_threshold,
            settings.entropy_length,
            state["entropy_keyword_gated"],
            state["entropy_unconditional"],
            text=text,
            out=out,
            layer_ord=position,
        )

    return Layer("entropy", scan)


def gate_layer(keep: Callable[[Column], Column] | None = None) -> Layer:
    """Hook at the end of the cascade: ``keep`` says of a finding whether it stays; the default keeps all."""

    def scan(texts: DataFrame, text: str, out: str, position: int) -> DataFrame:
        return texts.withColumn(out, empty(FINDING))

    return Layer("contextgate", scan, keep=keep)


def default_layers(settings: Settings = Settings(), ml: Layer | None = None) -> list[Layer]:
    """Patterns, entropy, then the model if there is one."""
    layers = [pattern_layer(settings), entropy_layer(settings)]
    return layers + ([ml] if ml else []) + [gate_layer()]


@built_once
def _moved(findings: str, marks: str) -> Column:
    """Findings of a masked text at their places in the original."""

    def move(f: Column) -> Column:
        start = original_position(f.start, F.col(marks))
        end = original_position(f.end, F.col(marks))
        return f.withField("start", start).withField("end", end).withField("neg_len", start - end)

    return F.transform(findings, move)


def cascade(texts: DataFrame, layers: list[Layer], text: str = "text") -> DataFrame:
    """Add ``findings`` (all layers, in span order) and ``layers`` (one entry per layer)."""
    added = [c for layer in layers if layer.ready for c in layer.adds]
    columns = [*(c for c in texts.columns if c not in added), *added]
    state = texts.withColumn("findings", empty(FINDING))
    infos: list[Column] = []
    seen = text
    marks: str | None = None
    for k, layer in enumerate(layers, start=1):
        if not layer.ready:
            infos.append(_info(layer.name, F.lit(0), F.lit(True), F.lit(layer.skip_reason), None))
            continue
        state = layer.scan(state, seen, f"__f{k}", k)
        found = _moved(f"__f{k}", marks) if marks else F.col(f"__f{k}")
        skipped, reason = F.lit(False), F.lit("")
        if layer.failure:
            skipped = F.col(layer.failure).isNotNull()
            reason = F.coalesce(F.col(layer.failure), F.lit(""))
            found = F.when(skipped, empty(FINDING)).otherwise(found)
        infos.append(_info(layer.name, F.size(F.col(f"__f{k}")), skipped, reason, layer.latency))
        if layer.keep:
            state = state.withColumn("findings", settled(F.filter("findings", layer.keep)))
        if layer.name == "contextgate":
            continue
        later = any(x.ready and x.name != "contextgate" for x in layers[k:])
        state = state.withColumn(
            "findings",
            settled(
                F.when(F.size(F.col(f"__f{k}")) > 0, in_order(F.concat("findings", found))).otherwise(
                    F.col("findings")
                )
            ),
        )
        if later:
            marks, seen = f"__m{k}", f"__t{k}"
            state = mask_layer(state, text=text, findings="findings", masked=seen, marks=marks)
    return state.withColumn("layers", settled(F.array(*infos))).select(*columns, "findings", "layers")


def _info(name: str, count: Column, skipped: Column, reason: Column, latency: str | None) -> Column:
    return F.struct(
        F.lit(name).alias("name"),
        count.cast("int").alias("findings_count"),
        skipped.alias("skipped"),
        reason.alias("skip_reason"),
        (F.col(latency) if latency else F.lit(None)).cast("double").alias("latency_ms"),
    )


def layer_report(scanned: DataFrame) -> DataFrame:
    """``(layer, texts, findings, skipped, timed, avg_ms, max_ms)`` of each layer over all scanned texts."""
    one = scanned.select(F.explode("layers").alias("l"))
    return one.groupBy(F.col("l.name").alias("layer")).agg(
        F.count("*").alias("texts"), F.sum("l.findings_count").cast("bigint").alias("findings"), F.count_if("l.skipped").alias("skipped"),
        F.count("l.latency_ms").alias("timed"), F.avg("l.latency_ms").alias("avg_ms"), F.max("l.latency_ms").alias("max_ms"),
    )
