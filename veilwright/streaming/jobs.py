"""The continuous forms of the jobs.

They call the same functions as the batch jobs; a stateless map runs on a stream as it is.  State is
kept only for windows, for repeat suppression and for the uses of enrolment tokens.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from veilwright.operators import fleet, reports
from veilwright.operators.reuse import text_hash
from veilwright.plans.cascade import Settings
from veilwright.plans.scan import scan_and_redact

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(spark: SparkSession, folder: str, name: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder as they arrive; ``name`` is a file name or a pattern."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def scan_stream(texts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Every arriving text scanned and masked; no state."""
    return scan_and_redact(texts, settings=settings)


def first_sightings(texts: DataFrame, keep: str = "1 hour", text: str = "text") -> DataFrame:
    """Texts that did not arrive within the last ``keep``; the state holds hashes, not texts.

    The clock is the arrival of the batch. By a clock in the data an old text would lie behind the
    watermark and be dropped, seen before or not; so every text that is new here gets through.
    """
    arrived = texts.withColumn("hash", text_hash(text)).withColumn("arrived_at", F.current_timestamp())
    return arrived.withWatermark("arrived_at", keep).dropDuplicatesWithinWatermark(["hash"])


def ingest_stream(events: DataFrame, devices: DataFrame) -> DataFrame:
    """Authorised events of a stream; the devices are joined as they are at each batch.

    For events of batches that were already admitted; ``ingest_batches`` admits them first.
    """
    return fleet.authorised(events, devices)


def ingest_batches(events: DataFrame, devices: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Events of a stream whose batch is not too large and whose device may send them.

    A batch of events arrives as a whole, in one file, so its size is known within one trigger.
    """
    return each_batch(events, lambda batch, number: sink(fleet.ingest(batch, devices), number), checkpoint)


def verdict_panes(events: DataFrame, clock: str = "received_at", late: str | None = None) -> DataFrame:
    """Events per hour and verdict; ``fleet.sliding`` sums them over windows of a day.

    The state holds one count for each hour, not one for each window, and without ``late`` nothing is ever
    dropped. With it, hours past the watermark are forgotten and events behind it dropped
    (``state.observed_counts`` keeps them).
    """
    rows = events.withWatermark(clock, late) if late else events
    hours = rows.groupBy(F.window(clock, "1 hour").alias("w"), "verdict").agg(F.count("*").alias("n"))
    return hours.select(F.col("w.start").alias("hour"), "verdict", "n")


def live_counters(report_stream: DataFrame) -> DataFrame:
    """Requests by upstream and status, for update or complete mode."""
    return reports.requests_total(report_stream)


def live_histogram(report_stream: DataFrame, key: Column, ms: Column) -> DataFrame:
    return reports.latency_histogram(report_stream, key, ms)


def alerts(events: DataFrame) -> DataFrame:
    return events.where(F.col("verdict") == "runaway")


def to_parquet(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Everything there is now, exactly once, then stop."""
    return (
        stream.writeStream.outputMode(mode)
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def each_batch(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", once: bool = True) -> StreamingQuery:
    """Everything there is now, then stop; without ``once`` also what arrives later, until it is stopped."""
    writer = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def reloading_scan(
    texts: DataFrame,
    read_settings: Callable[[], Settings],
    sink: Callable[[DataFrame, int], None],
    checkpoint: str,
    once: bool = True,
) -> StreamingQuery:
    """Scan with rules that may change: they are read before each batch.

    Those for the first batch must be readable: without a good setting nothing is scanned. Later,
    settings that can not be read (a missing or broken file) leave the last good ones in force, with a
    warning.
    """
    current: dict[str, Settings] = {}

    def run(batch: DataFrame, number: int) -> None:
        try:
            current["settings"] = read_settings()
        except (OSError, ValueError, KeyError, PySparkException) as failure:
            if not current:
                raise
            logging.getLogger(__name__).warning("batch %d keeps the last settings: %s", number, failure)
        sink(scan_and_redact(batch, settings=current["settings"]), number)

    return each_batch(texts, run, checkpoint, once=once)


#: Groups of tokens in state. A call into Python is for a group, not for a token; checkpoints depend on it.
TOKEN_GROUPS = 512


class _Uses(StatefulProcessor):
    """Uses of tokens so far, a map by token for each group of tokens."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.used = handle.getMapState("used", "token_hash string", "uses long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh, before = not self.used.exists(), {}
        best, waiting, n_waiting = None, [], 0

        def first(parts: list[pd.DataFrame]) -> pd.DataFrame:
            """The first attempts of each token, as many as it has uses left."""
            ordered = pd.concat(parts, ignore_index=True).sort_values(["at", "unnamed", "attempt_id"])
            place = ordered.groupby("token_hash", sort=False).cumcount()
            return ordered[place + ordered["token_hash"].map(before) < ordered["max_uses"]]

        for part in rows:
            for own in set(part["token_hash"]) - before.keys():
                known = None if fresh else self.used.getValue((own,))
                before[own] = known[0] if known else 0
            waiting.append(part)
            n_waiting += len(part)
            if best is None or n_waiting >= len(best):  # else the same rows would be sorted for every part
                best, waiting, n_waiting = first(waiting if best is None else [best, *waiting]), [], 0
        if waiting:
            best = first([best, *waiting])
        if best is not None:
            for own, uses in best["token_hash"].value_counts(sort=False).items():
                self.used.updateValue((own,), (before[own] + uses,))
            yield best[["token_hash", "attempt_id", "unnamed", "at"]]

    def close(self) -> None:
        pass


def admissions(attempts: DataFrame, tokens: DataFrame) -> DataFrame:
    """Accepted enrolments of a stream of attempts.

    Attempts on tokens without a limit need no state and do not enter the grouped part.  For the
    others the state is the number of uses so far, and a batch keeps at most about twice as many attempts
    per token as the token has uses left, whatever arrives.  Tokens are dealt into ``TOKEN_GROUPS``, each
    with a map by token, so that a call and its frames cost once for many tokens.  Uses the RocksDB state
    store.
    """
    attempts.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    joined = attempts.join(F.broadcast(tokens) if _is_small(tokens) else tokens, "token_hash")
    valid = joined.where(~F.col("revoked") & (F.col("attempted_at") <= F.col("expires_at")))
    at, named = F.col("attempted_at").cast("timestamp"), F.col("attempt_id").cast("bigint")
    free = valid.where("max_uses = 0").select("token_hash", named.alias("attempt_id"), at.alias("attempted_at"))
    # Whole numbers only: pandas would make floats of ids with nulls and round times to its own range.
    limited = valid.where("max_uses > 0").select(
        F.pmod(F.xxhash64("token_hash"), F.lit(TOKEN_GROUPS)).cast("int").alias("bucket"), "token_hash", F.coalesce(named, F.lit(0)).alias("attempt_id"),
        named.isNull().alias("unnamed"), F.unix_micros(at).alias("at"), F.col("max_uses").cast("bigint").alias("max_uses"),
    )
    counted = limited.groupBy("bucket").transformWithStateInPandas(_Uses(), "token_hash string, attempt_id bigint, unnamed boolean, at bigint", "Append", "None")
    taken = counted.select("token_hash", F.when(~F.col("unnamed"), F.col("attempt_id")).alias("attempt_id"), F.timestamp_micros("at").alias("attempted_at"))
    return taken.unionByName(free)


def _is_small(df: DataFrame, limit: int = 64 << 20) -> bool:
    """Whether the planner's size estimate allows a broadcast."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) <= limit
