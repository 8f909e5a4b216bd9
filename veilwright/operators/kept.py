"""Scan results kept between runs.

A store is a folder with one bucketed table for each state of the rules. The state's fingerprint covers
everything that a result depends on, so a changed toggle, threshold, word list or model leads to another
table and every text is scanned again, while going back finds the old results. A run scans only the
texts that the table does not hold; the table's side of both joins is not shuffled.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwright.operators.redact import redact
from veilwright.operators.reuse import text_hash
from veilwright.plans.cascade import Layer, Settings, cascade, default_layers
from veilwright.plans.scan import without_allowed
from veilwright.sources.catalog import active_patterns, effective
from veilwright.sources.scratch import children, removed, written

#: To be raised whenever the same rules give other results than before.
FORMAT = 1
BUCKETS = 64
#: So many new texts are looked up in every task, and so many copies of a text may go to one task.
FEW, OFTEN = 100_000, 10_000
RESULT = ("redacted_text", "findings", "applied", "layers")


def fingerprint(settings: Settings = Settings(), allowed: list[str] | None = None, models: dict[str, str] | None = None) -> str:
    """Name of a state of the rules; ``models`` has a version for each model layer."""
    state = {
        "format": FORMAT,
        "patterns": [list(p) for p in active_patterns(settings.toggles, settings.profile, list(settings.custom))],
        "toggles": effective(settings.toggles),
        "entropy": [settings.entropy_threshold, settings.entropy_length],
        "allowed": sorted({w.lower() for w in allowed or []}),
        "models": sorted((models or {}).items()),
    }
    return hashlib.sha256(json.dumps(state, sort_keys=True, default=str).encode()).hexdigest()[:32]


def _scanned(texts: DataFrame, layers: list[Layer], allowed: list[str] | None) -> DataFrame:
    """``hash`` and the result of each text, and the run that made it."""
    return redact(without_allowed(cascade(texts, layers), allowed or [])).select("hash", *RESULT)


def kept_table(spark: SparkSession, folder: str, like: DataFrame) -> str:
    """The bucketed table in ``folder``, made known to this session; its files may stem from earlier ones."""
    name = "kept_" + hashlib.sha256(folder.encode()).hexdigest()[:32]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in like.schema)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({fields}) USING parquet CLUSTERED BY (hash) SORTED BY (hash) INTO {BUCKETS} BUCKETS LOCATION '{folder}'")
    spark.catalog.refreshTable(name)
    return name


def new_texts(rows: DataFrame, new: DataFrame) -> DataFrame:
    """``(hash, text)`` of each hash in ``new``, dealt out as the table is: a text moves once, its result never.

    Of a text with very many copies only rows with the least id are sent. With few new texts no other is sent.
    """
    is_least = F.col("id").eqNullSafe(F.col("least"))
    if new.count() <= FEW:
        sent = rows.join(F.broadcast(new), (F.col("hash") == F.col("new")) & is_least, "left_semi").repartition(BUCKETS, "hash")
    else:
        often = F.broadcast(new.where(F.col("copies") > OFTEN))
        least = rows.join(often, F.col("hash") == F.col("new"), "left").where(F.col("new").isNull() | is_least).select("hash", "text")
        sent = least.repartition(BUCKETS, "hash").join(new.select("new").repartition(BUCKETS, "new").hint("merge"), F.col("hash") == F.col("new"), "left_semi")
    return sent.dropDuplicates(["hash"]).select("hash", "text")


def scan_kept(
    texts: DataFrame, store: str, settings: Settings = Settings(), allowed: list[str] | None = None, layers: list[Layer] | None = None,
    models: dict[str, str] | None = None, id_col: str = "id", text: str = "text",
) -> DataFrame:
    """``(id, redacted_text, findings, applied, layers, scanned)``; new texts are scanned and kept before this returns.

    ``scanned`` tells whether the row's text was new. Equal texts are scanned once, a null text counts as
    one text. Ids may repeat and be null. Two runs at a time may both scan a text; one result is used.
    With layers of one's own, ``models`` must name every version that their results depend on.
    """
    spark, run = texts.sparkSession, uuid.uuid4().hex
    layers = layers or default_layers(settings)
    rows = texts.select(F.col(id_col).alias("id"), F.col(text).alias("text"), text_hash(text).alias("hash"))
    # The least id of a text is found from its hash alone, so no text is sorted or sent for that.
    once = rows.groupBy("hash").agg(F.min(F.struct("id")).alias("least"), F.count("*").alias("copies"))
    like = _scanned(rows.select("hash", "text"), layers, allowed).withColumn("run", F.lit(run))
    name = kept_table(spark, f"{store.rstrip('/')}/{fingerprint(settings, allowed, models)}", like)
    new = once.join(spark.table(name).select("hash"), "hash", "left_anti").select(F.col("hash").alias("new"), F.col("least.id").alias("least"), "copies")
    result = _scanned(new_texts(rows, written(new, "new-texts")), layers, allowed).withColumn("run", F.lit(run))
    result.write.insertInto(name)
    spark.catalog.refreshTable(name)
    kept = spark.table(name).groupBy("hash").agg(F.any_value(F.struct(*RESULT, "run")).alias("r"))  # by bucket, without a shuffle
    out = rows.select("id", "hash").join(kept, "hash").select("id", "r.*")
    return out.select(F.col("id").alias(id_col), *RESULT, (F.col("run") == run).alias("scanned"))


def invalidate(spark: SparkSession, store: str, but: str | None = None) -> list[str]:
    """Remove the results of all states of the rules (``but`` one); gives the fingerprints removed."""
    gone = [name for name in children(spark, store) if name != but]
    for name in gone:
        removed(spark, f"{store.rstrip('/')}/{name}")
    return gone
