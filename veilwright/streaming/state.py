"""Streams with results kept in state, and tables that a batch that runs again leaves as they were.

A micro-batch has a number. Everything a batch adds to a table goes to a folder of that number, made
from the folders of lower numbers and the batch alone, and a folder is written as a whole; so a batch
that is run again after a crash writes the same, and a reader never counts anything twice.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from veilwright.operators.fleet import panes
from veilwright.operators.kept import fingerprint
from veilwright.operators.redact import redact
from veilwright.operators.reuse import text_hash
from veilwright.plans.cascade import Settings, cascade, default_layers
from veilwright.plans.scan import without_allowed
from veilwright.sources.scratch import children, removed
from veilwright.streaming.jobs import ROCKSDB, each_batch

#: How far the clock of arrival may go back between batches; results are kept that much longer.
SLACK = "10 minutes"
#: Groups of texts in state. A call into Python is for a group, not for a text; checkpoints depend on it.
BUCKETS = 512
#: Rows that get their results at a time.
ROWS_AT_ONCE = 256


# --- scans that answer repeats -----------------------------------------------------------------------


def _milliseconds(times: pd.Series) -> int:
    return int(times.max().timestamp() * 1000)


class _Texts(StatefulProcessor):
    """A map by text hash for each bucket; what is ``due`` at a time is removed by one timer for all."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def opened(self, handle: StatefulProcessorHandle, name: str, value: str) -> None:
        self.handle, self.due = handle, handle.getMapState("due", "until long", "hashes array<string>")
        self.texts = handle.getMapState(name, "hash string", f"until long, {value}")

    def remind(self, put: dict[int, list[str]]) -> None:
        for until, hashes in put.items():
            before = self.due.getValue((until,))
            self.due.updateValue((until,), ([*before[0], *hashes] if before else hashes,))
            self.handle.registerTimer(until)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        due = self.due.getValue((now,))
        for own in due[0] if due else ():
            kept = self.texts.getValue((own,))
            if kept and kept[0] <= now:  # else it was put again since
                self.texts.removeKey((own,))
        if due:
            self.due.removeKey((now,))
        return iter(())

    def close(self) -> None:
        pass


class _Route(_Texts):
    """Lets the first row of a text through with its text; later ones go on without."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.opened(handle, "seen", "since long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        empty, met, put = not self.texts.exists(), {}, defaultdict(list)
        for part in rows:
            now, first = _milliseconds(part["arrived_at"]), []
            for own in part["hash"]:
                if own not in met:
                    kept = None if empty else self.texts.getValue((own,))
                    met[own] = kept[0] if kept else now
                new = met[own] <= now  # the timer waits for the watermark
                if new:
                    met[own] = now + self.keep_ms
                    self.texts.updateValue((own,), (met[own], now))
                    put[met[own]].append(own)
                first.append(new)
            yield part.assign(text=part["text"].where(first, None), first=first)[["bucket", "hash", "id", "text", "first", "arrived_at"]]
        self.remind(put)


class _Answer(_Texts):
    """Keeps the result of a text and gives it to every row of that text."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.opened(handle, "kept", "result string")

    def results(self, hashes: pd.Series) -> list[str | None]:
        """Results of rows as they are in state, each text asked for once."""
        own = {h: self.texts.getValue((h,)) for h in hashes.unique()}
        return [own[h][1] if own[h] else None for h in hashes]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        columns = ["id", "result", "first", "arrived_at"]
        put = defaultdict(list)
        waiting: list[pd.DataFrame] = []  # rows without results that came before the scanned row of their text
        for whole in rows:
            until = _milliseconds(whole["arrived_at"]) + self.keep_ms
            for part in _portions(whole):
                scanned, again = part[part["first"]], part[~part["first"]]
                for own, result in zip(scanned["hash"], scanned["result"], strict=True):
                    self.texts.updateValue((own,), (until, result))
                put[until] += scanned["hash"].tolist()
                yield scanned[columns]
                if len(again):
                    again = again.assign(result=pd.Series(self.results(again["hash"]), again.index, object))
                    ready = again["result"].notna()
                    waiting.append(again.loc[~ready, ["hash", *columns]])
                    yield again.loc[ready, columns]
        for part in _portions(pd.concat(waiting)) if waiting else ():
            late = part.assign(result=self.results(part["hash"]))
            if late["result"].isna().any():
                raise ValueError("a text was sent on without its result")
            yield late[columns]
        self.remind(put)


def _portions(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Some rows at a time: each gets a whole result, and a text may have very many rows."""
    return (rows.iloc[at : at + ROWS_AT_ONCE] for at in range(0, len(rows), ROWS_AT_ONCE))


def scan_once(texts: DataFrame, keep_ms: int = 3_600_000, settings: Settings = Settings(), allowed: list[str] | None = None, id_col: str = "id", text: str = "text") -> DataFrame:
    """``(id, redacted_text, findings, applied, layers, scanned, arrived_at)`` for every row of a stream.

    The first row of a text is scanned; its result is kept in state for ``keep_ms`` from its arrival, and
    rows with the same text that come meanwhile get it from there. ``scanned`` tells which it was. A null
    text is a text; ids may repeat and be null. Two stateful steps with the scan between them: the first
    keeps when a text was seen, the second its result, twice as long, so a row that was sent on without
    its text always finds it. Texts are grouped into ``BUCKETS``, each with a map by text hash, so that a
    group, its small frames and its timer cost once for many texts. Uses the RocksDB state store.
    """
    texts.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    id_type = texts.schema[id_col].dataType.simpleString()
    rules = F.lit(fingerprint(settings, allowed))  # results of other rules, left in the checkpoint, are not met
    arrived = texts.select(F.concat(rules, text_hash(text)).alias("hash"), F.col(id_col).alias("id"), F.col(text).alias("text"), F.current_timestamp().alias("arrived_at")).withWatermark("arrived_at", SLACK)
    grouped = arrived.withColumn("bucket", F.pmod(F.xxhash64("hash"), F.lit(BUCKETS)).cast("int")).groupBy("bucket")
    routed = grouped.transformWithStateInPandas(
        _Route(keep_ms), f"bucket int, hash string, id {id_type}, text string, first boolean, arrived_at timestamp", "Append", "EventTime", eventTimeColumnName="arrived_at"
    )
    # A row without its text costs next to nothing here: there is nothing to match in a null.
    found = redact(without_allowed(cascade(routed, default_layers(settings)), allowed or []))
    result = F.struct("redacted_text", "findings", "applied", "layers")
    shape = found.select(result.alias("r")).schema["r"].dataType
    ready = found.select("bucket", "hash", "id", F.when(F.col("first"), F.to_json(result, {"ignoreNullFields": "false"})).alias("result"), "first", "arrived_at")
    answered = ready.groupBy("bucket").transformWithStateInPandas(
        _Answer(2 * keep_ms), f"id {id_type}, result string, first boolean, arrived_at timestamp", "Append", "EventTime", eventTimeColumnName="arrived_at"
    )
    return answered.withColumn("r", F.from_json("result", shape)).select(F.col("id").alias(id_col), "r.*", F.col("first").alias("scanned"), "arrived_at")


# --- tables by batch ---------------------------------------------------------------------------------


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    return sorted(int(n.removeprefix("batch=")) for n in children(spark, folder) if n.startswith("batch="))


def put(df: DataFrame, folder: str, number: int) -> None:
    """What batch ``number`` adds to a table, in place of what an earlier try of it left."""
    df.write.mode("overwrite").parquet(f"{folder}/batch={number}")


def put_merged(changed: DataFrame, folder: str, number: int, keys: list[str]) -> None:
    """The state of a table after batch ``number``: the state before it, with the rows of ``changed`` in place of theirs.

    ``changed`` has one row for each key that the batch touched, as a whole (the update mode of an
    aggregation). The state before it stays too, so that the batch can run again.
    """
    spark = changed.sparkSession
    # The batch is read once: reading it again would run the aggregation again.
    put(changed, f"{folder}/changed", number)
    changed = spark.read.parquet(f"{folder}/changed/batch={number}")
    before = [n for n in _numbers(spark, folder) if n < number]
    if before:
        old = spark.read.parquet(f"{folder}/batch={before[-1]}")
        same = reduce(and_, [F.col(f"o.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys])
        changed = changed.unionByName(old.alias("o").join(changed.select(*keys).alias("c"), same, "left_anti"))
    put(changed, folder, number)
    for n in before[:-1]:
        removed(spark, f"{folder}/batch={n}")
        removed(spark, f"{folder}/changed/batch={n}")


def state_of(spark: SparkSession, folder: str) -> DataFrame:
    """The table as the last batch left it."""
    return spark.read.parquet(f"{folder}/batch={_numbers(spark, folder)[-1]}")


def live(counted: DataFrame, keys: list[str], folder: str, checkpoint: str) -> StreamingQuery:
    """A running aggregation as a table that is current after each batch."""
    return each_batch(counted, lambda batch, number: put_merged(batch, folder, number, keys), checkpoint, mode="update")


# --- windows by the time of observation --------------------------------------------------------------


def observed_counts(events: DataFrame, folder: str, checkpoint: str, clock: str = "observed_at", late: str = "10 minutes", keys: tuple[str, ...] = ("verdict",)) -> StreamingQuery:
    """Hourly counts by the events' own clock; events behind the watermark go to a table of their own.

    The watermark of a batch is the latest clock of the batches before it, less ``late``. Tables in
    ``folder``: ``panes`` (hour, keys, n), ``late`` (the events), ``clock`` (one row for each batch). All
    events are in one of the first two. An event without a time is late.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = [n for n in _numbers(spark, f"{folder}/clock") if n < number]
        past = spark.read.schema("latest timestamp").parquet(*[f"{folder}/clock/batch={n}" for n in before[-1:]]).first()[0] if before else None
        limit = F.lit(past).cast("timestamp") - F.expr(f"INTERVAL {late}")
        in_time = F.col(clock).isNotNull() & (F.coalesce(F.col(clock).cast("timestamp") >= limit, F.lit(True)) if past else F.lit(True))
        put(batch.where(~in_time), f"{folder}/late", number)
        put(panes(batch.where(in_time), clock, list(keys)), f"{folder}/panes", number)
        latest = F.greatest(F.max(F.col(clock).cast("timestamp")), F.lit(past).cast("timestamp"))
        put(batch.agg(latest.alias("latest")), f"{folder}/clock", number)

    return each_batch(events, step, checkpoint)


def observed_panes(spark: SparkSession, folder: str, keys: tuple[str, ...] = ("verdict",)) -> DataFrame:
    """Hourly counts of all batches, ready for ``fleet.sliding``."""
    return spark.read.parquet(f"{folder}/panes").drop("batch").groupBy("hour", *keys).agg(F.sum("n").alias("n"))


def late_events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/late").drop("batch")


# --- a feed of reports -------------------------------------------------------------------------------


def report_id(*parts: str) -> Column:
    """An id that a task that runs again makes again: a digest of what makes the report the one it is."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(p).cast("string"), F.lit("\x00")) for p in parts]), 256).substr(1, 32)


def feed(reports: DataFrame, send: Callable[[DataFrame, int], None], folder: str, checkpoint: str) -> StreamingQuery:
    """Give each report to ``send`` once, also when a batch runs again.

    What a batch sends is first written under its number; a batch whose mark is there has been sent. If
    the crash came between sending and marking, ``send`` gets the same rows under the same number again
    and can tell by that number, as each batch is sent whole.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number in _numbers(spark, f"{folder}/sent"):
            return
        put(batch, f"{folder}/reports", number)
        send(spark.read.parquet(f"{folder}/reports/batch={number}"), number)
        put(spark.range(1), f"{folder}/sent", number)

    return each_batch(reports, step, checkpoint)
