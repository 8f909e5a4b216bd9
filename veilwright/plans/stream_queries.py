"""Checked queries that run as streams over the table files and read back what the stream wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwright.operators import fleet as L
from veilwright.operators import reports as R
from veilwright.oracle import detection as O
from veilwright.plans import fleet_queries as Q
from veilwright.plans.cascade import Settings
from veilwright.plans.registry import ORACLES, query, with_tables
from veilwright.plans.report_queries import reports_of
from veilwright.plans.text_queries import _CLEAN
from veilwright.sources.catalog import active_patterns, everything_on
from veilwright.sources.patterns import profile
from veilwright.sources.scratch import is_folder, new_folder
from veilwright.sources.tables import read_table, spread
from veilwright.streaming import jobs as J
from veilwright.streaming import state as ST


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """The table as a stream, be it one file or a folder of files."""
    table = f"{sf}/{name}.parquet"
    folder, files = (table, "*") if is_folder(spark, table) else (sf, f"{name}.parquet")
    return J.file_stream(spark, folder, files, read_table(spark, sf, name).schema)


def _files(spark: SparkSession, sf: str, name: str, files: int = 4) -> DataFrame:
    """The table as a stream of several files, one for each batch."""
    folder = new_folder(spark, f"stream-{name}")
    table = read_table(spark, sf, name)
    table.repartition(files, table.columns[0]).write.parquet(folder)
    return J.file_stream(spark, folder, "*.parquet", table.schema, files_per_trigger=1)


def _written(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    folder = new_folder(spark, name)
    J.to_parquet(stream, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out")


_STREAM_TABLES = {
    "corpus": "SELECT doc_id AS id, text FROM documents",
    "l1": O.findings(profile("compat"), "corpus"),
    "k": O.folded("SELECT * FROM corpus", "SELECT * FROM l1", contained=False),
    "l2": O.entropy("k", 3.5, 16, unconditional=True),
    "f": "SELECT * FROM l1 UNION ALL SELECT * FROM l2",
    "k2": _CLEAN,
}


@query(
    "stream_scan",
    with_tables(
        "SELECT k2.id, k2.masked AS redacted_text, CAST(len(marks) AS INTEGER) AS applied_count FROM k2", **_STREAM_TABLES
    ),
)
def stream_scan(spark: SparkSession, sf: str) -> DataFrame:
    texts = _stream(spark, sf, "documents").selectExpr("doc_id AS id", "text")
    settings = Settings(toggles=everything_on(), entropy_threshold=3.5, entropy_length=16)
    out = J.scan_stream(texts, settings).select("id", "redacted_text", F.size("applied").alias("applied_count"))
    return _written(spark, out, "stream-scan")


@query("stream_ingest", with_tables(f"SELECT {Q.EV} FROM ev WHERE {Q._OK} AND {Q._ADMITTED}", **Q.TABLES))
def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    folder = new_folder(spark, "stream-ingest")

    def sink(batch: DataFrame, number: int) -> None:
        Q.ev(batch).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    events = Q.events_of(_stream(spark, sf, "events"))
    J.ingest_batches(events, Q.devices(spark, sf), sink, f"{folder}/state").awaitTermination()
    return Q.ev(spark.read.parquet(f"{folder}/out"))


@query(
    "stream_alerts", with_tables(f"SELECT {Q.EV} FROM ev WHERE verdict = 'runaway'", **Q.TABLES)
)
def stream_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return _written(spark, Q.ev(J.alerts(Q.events_of(_stream(spark, sf, "events")))), "stream-alerts")


@query(
    "stream_verdict_windows",
    with_tables(
        """SELECT w AS window_start, verdict, count(*) AS n FROM (
             SELECT verdict, unnest(generate_series(date_trunc('hour', received_at) - INTERVAL 23 HOUR, date_trunc('hour', received_at), INTERVAL 1 HOUR)) AS w FROM ev)
           GROUP BY 1, 2""",
        **Q.TABLES,
    ),
)
def stream_verdict_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly counts as they stand after the last batch, summed over windows of a day."""
    events = Q.events_of(_files(spark, sf, "events")).withColumn("received_at", F.col("received_at").cast("timestamp"))
    folder = new_folder(spark, "stream-windows")
    ST.live(J.verdict_panes(events), ["hour", "verdict"], f"{folder}/out", f"{folder}/state").awaitTermination()
    out = L.sliding(ST.state_of(spark, f"{folder}/out"), ["verdict"])
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    "stream_observed_windows",
    with_tables(
        """SELECT w AS window_start, verdict, count(*) AS n FROM (
             SELECT verdict, unnest(generate_series(date_trunc('hour', observed_at) - INTERVAL 23 HOUR, date_trunc('hour', observed_at), INTERVAL 1 HOUR)) AS w FROM ev)
           GROUP BY 1, 2""",
        **Q.TABLES,
    ),
)
def stream_observed_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Windows by the events' own clock over several files; events behind the watermark are added from their table."""
    events, folder = Q.events_of(_files(spark, sf, "events")), new_folder(spark, "stream-observed")
    ST.observed_counts(events, folder, f"{folder}/state").awaitTermination()
    late = L.panes(ST.late_events(spark, folder), "observed_at", ["verdict"])
    both = ST.observed_panes(spark, folder).unionByName(late).groupBy("hour", "verdict").agg(F.sum("n").alias("n"))
    return L.sliding(both, ["verdict"])


@query("stream_counters", ORACLES["requests_total"])
def stream_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Counters after the last of several batches, each merged by its number."""
    folder = new_folder(spark, "stream-counters")
    ST.live(J.live_counters(reports_of(_files(spark, sf, "events"))), ["upstream", "status"], f"{folder}/out", f"{folder}/state").awaitTermination()
    return ST.state_of(spark, f"{folder}/out").select("upstream", "status", "total")


@query("stream_histogram", ORACLES["latency_histogram"])
def stream_histogram(spark: SparkSession, sf: str) -> DataFrame:
    folder = new_folder(spark, "stream-histogram")
    counted = J.live_histogram(reports_of(_files(spark, sf, "events")), F.col("provider"), F.col("latency_ms"))
    ST.live(counted, ["name", "le"], f"{folder}/out", f"{folder}/state").awaitTermination()
    return ST.state_of(spark, f"{folder}/out").select("name", "le", "cumulative", "sum_seconds", "n")


@query("stream_scan_once", with_tables("SELECT id, masked AS redacted_text, CAST(len(marks) AS INTEGER) AS applied_count FROM k2", **_STREAM_TABLES))
def stream_scan_once(spark: SparkSession, sf: str) -> DataFrame:
    """Every row of several files with the result of its text, scanned once."""
    texts = _files(spark, sf, "documents").selectExpr("doc_id AS id", "text")
    settings = Settings(toggles=everything_on(), entropy_threshold=3.5, entropy_length=16)
    return _written(spark, ST.scan_once(texts, settings=settings), "stream-once").select("id", "redacted_text", F.size("applied").alias("applied_count"))


@query("stream_scanned_texts", "SELECT sha256(text) AS hash, count(*) AS n, CAST(1 AS BIGINT) AS scans FROM documents GROUP BY 1")
def stream_scanned_texts(spark: SparkSession, sf: str) -> DataFrame:
    """How often each text came, and how often it was scanned."""
    texts = _files(spark, sf, "documents").selectExpr("struct(doc_id, sha2(text, 256) AS hash) AS id", "text")
    out = _written(spark, ST.scan_once(texts), "stream-once")
    return out.groupBy("id.hash").agg(F.count("*").alias("n"), F.count_if("scanned").alias("scans"))


_OFF = {"email_regex": False}
_RELOADED = {
    "corpus": "SELECT doc_id AS id, text FROM documents",
    "on1": O.findings(active_patterns(), "corpus"),
    "off1": O.findings(active_patterns(_OFF), "corpus"),
}
for _state in ("on", "off"):
    _RELOADED[f"{_state}k"] = O.folded("SELECT * FROM corpus", f"SELECT * FROM {_state}1", contained=False)
    _RELOADED[f"{_state}2"] = O.entropy(f"{_state}k", 4.5, 20)
    _RELOADED[f"{_state}c"] = O.folded("SELECT * FROM corpus", f"SELECT * FROM {_state}1 UNION ALL SELECT * FROM {_state}2", contained=True)


@query(
    "stream_reloaded",
    with_tables("SELECT id, masked AS redacted_text FROM onc WHERE id % 4 IN (0, 3) UNION ALL SELECT id, masked FROM offc WHERE id % 4 IN (1, 2)", **_RELOADED),
)
def stream_reloaded(spark: SparkSession, sf: str) -> DataFrame:
    """Four arrivals: a rule is on, then off, then its setting can not be read, then it is on again."""
    folder, table = new_folder(spark, "stream-reloaded"), read_table(spark, sf, "documents")
    states = [Settings(), Settings(toggles=_OFF), None, Settings()]
    now = [states[0]]

    def read() -> Settings:
        if now[0] is None:
            raise ValueError("the settings can not be read")
        return now[0]

    def sink(batch: DataFrame, number: int) -> None:
        batch.select("id", "redacted_text").write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    def arrive(k: int) -> None:
        now[0] = states[k]
        spread(table).where(F.col("doc_id") % 4 == k).write.mode("append").parquet(f"{folder}/in")

    arrive(0)
    texts = J.file_stream(spark, f"{folder}/in", "*.parquet", table.schema).selectExpr("doc_id AS id", "text")
    stream = J.reloading_scan(texts, read, sink, f"{folder}/state", once=False)
    try:
        for k in range(4):  # the files of the next arrive when those of the last are scanned, in any number of batches
            if k:
                arrive(k)
            stream.processAllAvailable()
    finally:
        stream.stop()
    return spark.read.parquet(f"{folder}/out").select("id", "redacted_text")


@query("stream_feed", "SELECT event_id AS id, CAST(1 AS BIGINT) AS times FROM events")
def stream_feed(spark: SparkSession, sf: str) -> DataFrame:
    """Reports of a feed with ids made from what they hold, stopped and started again: each is sent once."""
    folder = new_folder(spark, "stream-feed")
    reports = _files(spark, sf, "events").select(ST.report_id("event_id", "ts").alias("report_id"), F.col("event_id").alias("id"))

    def send(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/received/batch={number}")

    for _ in range(2):
        ST.feed(reports, send, folder, f"{folder}/state").awaitTermination()
    received = spark.read.parquet(f"{folder}/received")
    return received.groupBy("report_id").agg(F.min("id").alias("id"), F.count("*").alias("times")).select("id", "times")


@query(
    "stream_admissions",
    with_tables(
        """SELECT token_hash, attempt_id, attempted_at FROM (
             SELECT a.*, t.max_uses, row_number() OVER (PARTITION BY token_hash ORDER BY attempted_at, attempt_id) AS pos
             FROM attempts a JOIN tokens t USING (token_hash) WHERE NOT t.revoked AND a.attempted_at <= t.expires_at)
           WHERE max_uses = 0 OR pos <= max_uses""",
        **Q._ENROL,
    ),
)
def stream_admissions(spark: SparkSession, sf: str) -> DataFrame:
    attempts = Q.attempts_of(_stream(spark, sf, "orders"))
    out = _written(spark, J.admissions(attempts, Q.tokens(spark, sf)), "stream-admissions")
    return out.withColumn("attempted_at", F.col("attempted_at").cast("timestamp_ntz"))


@query(
    "stream_first_texts",
    "SELECT sha256(text) AS hash, count(*) > 0 AS seen FROM documents GROUP BY 1",
)
def stream_first_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Repeat suppression: as many rows as there are distinct texts."""
    out = J.first_sightings(_stream(spark, sf, "documents").select("text")).select("hash", F.lit(True).alias("seen"))
    return _written(spark, out, "stream-first")


@query(
    "sink_reports",
    """SELECT CAST(ts AS DATE) AS date, count(*) AS n, CAST(sum(user_id % 4) AS BIGINT) AS findings FROM events GROUP BY 1""",
)
def sink_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Append reports to a log partitioned by day, and read the log back."""
    folder = new_folder(spark, "report-log")
    e = spread(read_table(spark, sf, "events"))
    rows = e.select(
        F.col("event_id").alias("id"), "ts", (F.col("user_id") % 4).alias("findings_count"), F.to_date("ts").alias("date")
    )
    R.write_reports(rows, folder)
    return spark.read.parquet(folder).groupBy("date").agg(
        F.count("*").alias("n"), F.sum("findings_count").cast("bigint").alias("findings")
    )
