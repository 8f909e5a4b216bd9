"""Precision and recall of findings against labelled spans.

A labelled text is one row: its truth spans (value, start, end, label) and its findings, both arrays.
A truth entity is caught by the first finding whose value holds it, is held by it, or whose span
touches it.  Ignored labels do not count as missed, but a finding that meets one is no false positive.

Both arrays sit in the row of their text, so matching is a map: nothing is joined and no pair of a
text leaves its row. How spans are found in each other is in ``matching``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from veilwright.operators.matching import Meeting, Pairs, meeting

#: Texts whose spans Python holds as objects at a time.
TEXTS_AT_ONCE = 256
CREDIT = "array<struct<value:string,start:int,end:int,label:string,by_layer:string,by_label:string>>"
WRONG = "array<struct<value:string,start:int,end:int,label:string,layer:string,ord:int>>"


def _met(labelled: DataFrame, truth: str, findings: str, fields: str, judge: Callable[[list[dict], list[dict], Meeting | Pairs], tuple]) -> DataFrame:
    """``id`` and ``fields`` made from the truth, the findings and how they meet, text by text; null arrays are empty."""
    span = lambda x: F.struct(x.value.alias("value"), x.start.cast("int").alias("start"), x.end.cast("int").alias("end"), x.label.alias("label"))
    found = lambda x: F.struct(x.value.alias("value"), x.start.cast("int").alias("start"), x.end.cast("int").alias("end"), x.label.alias("label"), x.layer.alias("layer"))
    rows = labelled.select("id", F.transform(truth, span).alias("truth"), F.transform(findings, found).alias("found"))
    schema = T.StructType([rows.schema["id"], *T.StructType.fromDDL(fields).fields])
    types = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, TEXTS_AT_ONCE) for whole in batches for at in range(0, whole.num_rows, TEXTS_AT_ONCE)):
            out = []
            for wanted, had in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                wanted, had = wanted or [], had or []
                plain = [[(x["value"], x["start"], x["end"]) for x in spans] for spans in (wanted, had)]
                out.append(judge(wanted, had, meeting(*plain)))
            made = [pa.array([o[i] for o in out], f.type) for i, f in enumerate(list(types)[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=types.names)

    return rows.mapInArrow(run, schema)


def score(labelled: DataFrame, ignored: list[str], truth: str = "truth", findings: str = "findings") -> DataFrame:
    """(id, truth, findings) -> (id, credited, wrong).

    ``credited``: counted truth spans with the layer and label of the finding that caught them, null
    when none did.  ``wrong``: findings that meet no truth span, with their position.
    """
    refused = frozenset(ignored)

    def judge(wanted: list[dict], had: list[dict], met: Meeting | Pairs) -> tuple:
        credited = []
        for t, plain in zip(wanted, met.truth, strict=True):
            if t["label"] not in refused:
                i = met.first(plain)
                by = had[i] if i is not None else {"layer": None, "label": None}
                credited.append(t | {"by_layer": by["layer"], "by_label": by["label"]})
        return credited, [had[i] | {"ord": i} for i in met.unmet()]

    return _met(labelled, truth, findings, f"credited {CREDIT}, wrong {WRONG}", judge)


def matches(labelled: DataFrame, truth: str = "truth", findings: str = "findings") -> DataFrame:
    """Which findings meet which truth spans."""

    def judge(wanted: list[dict], had: list[dict], met: Meeting | Pairs) -> tuple:
        return ([t | {"met": met.all(plain)} for t, plain in zip(wanted, met.truth, strict=True)],)

    met = _met(labelled, truth, findings, "met array<struct<value:string,start:int,end:int,label:string,met:array<int>>>", judge)
    return met.select("id", F.explode("met").alias("t")).select("id", "t.value", "t.start", "t.end", "t.label", F.explode("t.met").alias("pos"))


def credit_rows(scored: DataFrame) -> DataFrame:
    return scored.select("id", F.explode("credited").alias("c")).select("id", "c.*")


def wrong_rows(scored: DataFrame) -> DataFrame:
    return scored.select("id", F.explode("wrong").alias("w")).select("id", "w.*")


def caught(credited: DataFrame) -> DataFrame:
    return credited.where("by_layer is not null")


def missed(credited: DataFrame) -> DataFrame:
    return credited.where("by_layer is null").select("id", "value", "start", "end", "label")


def _share(part: Column, whole: Column) -> Column:
    return F.round(F.when(whole > 0, part / whole * 100).otherwise(0.0), 6)


def summary(scored: DataFrame) -> DataFrame:
    """One pass: what each text adds to the totals is counted in its row."""
    hit = F.size(F.filter("credited", lambda c: c.by_layer.isNotNull()))
    totals = scored.agg(
        F.coalesce(F.sum(hit), F.lit(0)).alias("caught"),
        F.coalesce(F.sum(F.size("credited") - hit), F.lit(0)).alias("missed"),
        F.coalesce(F.sum(F.size("wrong")), F.lit(0)).alias("false_pos"),
    )
    c, m, w = F.col("caught"), F.col("missed"), F.col("false_pos")
    return totals.select(
        "caught",
        "missed",
        "false_pos",
        _share(c, c + w).alias("precision_pct"),
        _share(c, c + m).alias("recall_pct"),
        F.round(F.when(2 * c + w + m > 0, F.lit(200.0) * c / (2 * c + w + m)).otherwise(0.0), 6).alias("f1"),
    )


def by_layer(scored: DataFrame) -> DataFrame:
    """Caught entities and false positives of each layer, in one pass."""
    hits = F.transform(
        F.filter("credited", lambda c: c.by_layer.isNotNull()),
        lambda c: F.struct(c.by_layer.alias("layer"), F.lit(True).alias("hit")),
    )
    misses = F.transform("wrong", lambda w: F.struct(w.layer.alias("layer"), F.lit(False).alias("hit")))
    return (
        scored.select(F.explode(F.concat(hits, misses)).alias("x"))
        .groupBy("x.layer")
        .agg(F.count_if("x.hit").alias("caught"), F.count_if(~F.col("x.hit")).alias("false_pos"))
        .withColumn("precision_pct", _share(F.col("caught"), F.col("caught") + F.col("false_pos")))
    )


def breakdown(scored: DataFrame) -> DataFrame:
    """``(level, layer, label, total, caught, missed, false_pos, precision_pct, recall_pct, f1)`` in one job.

    Levels: ``all``, ``layer``, ``layer_label`` (what each layer caught) and ``label``. Every truth span
    and every wrong finding is one row, counted at all levels by one grouping; a missed span has no layer
    and a wrong finding counts under its own label.
    """
    spans = F.transform("credited", lambda c: F.struct(c.by_layer.alias("layer"), c.label.alias("label"), F.lit(True).alias("truth")))
    extra = F.transform("wrong", lambda w: F.struct(w.layer.alias("layer"), w.label.alias("label"), F.lit(False).alias("truth")))
    rows = scored.select(F.explode(F.concat(spans, extra)).alias("x")).select("x.*")
    layer, label, truth = F.col("layer"), F.col("label"), F.col("truth")
    counted = rows.groupingSets([[], [layer], [layer, label], [label]], layer, label).agg(
        F.grouping_id().alias("g"), F.count_if(truth).alias("total"), F.count_if(truth & layer.isNotNull()).alias("caught"), F.count_if(~truth).alias("false_pos")
    )
    level = F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "layer").when(F.col("g") == 0, "layer_label").otherwise("label")
    named = counted.withColumns({"level": level, "missed": F.col("total") - F.col("caught")}).where("layer IS NOT NULL OR level IN ('all', 'label')")
    c, m, w = F.col("caught"), F.col("missed"), F.col("false_pos")
    return named.select(
        "level", "layer", "label", "total", "caught", "missed", "false_pos", _share(c, c + w).alias("precision_pct"), _share(c, c + m).alias("recall_pct"),
        F.round(F.when(2 * c + w + m > 0, F.lit(200.0) * c / (2 * c + w + m)).otherwise(0.0), 6).alias("f1"),
    )


def layer_label(credited: DataFrame) -> DataFrame:
    return caught(credited).groupBy(F.col("by_layer").alias("layer"), "label").agg(F.count("*").alias("caught"))


def by_label(credited: DataFrame, detectable: list[str]) -> DataFrame:
    return (
        credited.groupBy("label")
        .agg(F.count("*").alias("total"), F.count("by_layer").alias("caught"))
        .select(
            "label",
            "total",
            "caught",
            (F.col("total") - F.col("caught")).alias("missed"),
            _share(F.col("caught"), F.col("total")).alias("rate"),
            F.col("label").isin(*detectable).alias("detectable"),
        )
    )


def detectable_recall(credited: DataFrame, detectable: list[str]) -> DataFrame:
    inside = F.col("label").isin(*detectable)
    return credited.agg(
        F.count_if(inside & F.col("by_layer").isNotNull()).alias("detectable_caught"),
        F.count_if(inside).alias("detectable_total"),
        F.count_if(~inside).alias("model_only"),
    ).withColumn("recall_pct", _share(F.col("detectable_caught"), F.col("detectable_total")))


def wrong_labels(wrong: DataFrame) -> DataFrame:
    return wrong.groupBy("label").agg(F.count("*").alias("n"), F.min("layer").alias("layer"))


def wrong_samples(wrong: DataFrame, n: int = 15) -> DataFrame:
    """A few false positives, long values cut."""
    return (
        wrong.orderBy("id", "ord")
        .limit(n)
        .select(
            "id",
            "layer",
            "label",
            F.when(F.length("value") > 40, F.concat(F.substring("value", 1, 40), F.lit("..."))).otherwise(
                F.col("value")
            ).alias("value"),
        )
    )


def label_check(samples: DataFrame) -> DataFrame:
    """(id, expected, found): expected labels not found, and findings in a text that expects none."""
    return samples.select(
        "id",
        F.array_join(F.sort_array(F.array_except("expected", "found")), ",").alias("missing"),
        ((F.size("expected") == 0) & (F.size("found") > 0)).alias("unexpected"),
    )


def read_labelled(spark, path: str) -> DataFrame:
    """Labelled corpus in JSON -> (id, text, locale, domain, truth).  A value may be a string or a number."""
    schema = (
        "id string, text string, locale string, domain string, "
        "pii array<struct<value:string,start:int,end:int,label:string>>"
    )
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumnRenamed("pii", "truth")
