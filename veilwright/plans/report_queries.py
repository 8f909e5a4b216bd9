"""Checked queries over scan reports.  Reports are derived from the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwright.operators import reports as R
from veilwright.oracle import detection as O
from veilwright.plans.registry import query, with_tables
from veilwright.plans.scan import scan_and_redact
from veilwright.plans.text_queries import _CASCADE, _CLEAN, BENCH
from veilwright.sources.derived import corpus
from veilwright.sources.scratch import new_folder
from veilwright.sources.tables import read_table

HOSTS = ["api.anthropic.com", "api.openai.com", "api.githubcopilot.com", "api"]
LABELS = ["EMAIL_ADDRESS", "US_SSN", "PHONE_NUMBER", "JWT", "ENTROPY-SECRET"]
NOW = "2024-01-31 00:00:00"
NOW_SQL = f"TIMESTAMP '{NOW}'"

_REPORTS = f"""SELECT event_id AS id, ts, ({O.words(HOSTS)})[CAST(event_id % 4 AS INTEGER) + 1] AS provider,
    CASE WHEN event_id % 4 = 3 THEN 'scan' ELSE 'proxy' END AS source, CAST(floor(value) AS BIGINT) AS latency_ms,
    event_type = 'error' AS blocked, CASE WHEN event_type = 'error' THEN 'blocked file' ELSE '' END AS reason,
    CAST(user_id % 4 AS INTEGER) AS findings_count,
    list_transform(range(0, CAST(user_id % 4 AS INTEGER)), lambda k: {{'label': ({O.words(LABELS)})[CAST((event_id + k) % 5 AS INTEGER) + 1],
        'original': 'value' || (event_id + k) % 17, 'layer': CASE WHEN (event_id + k) % 5 = 4 THEN 'entropy' ELSE 'presidio' END}}) AS redactions,
    [{{'name': 'presidio', 'skipped': event_id % 97 = 0, 'ms': CAST(user_id AS BIGINT)}},
     {{'name': 'entropy', 'skipped': event_id % 97 = 0 OR event_id % 50 = 0, 'ms': CAST(user_id * 7 AS BIGINT)}},
     {{'name': 'gliner', 'skipped': event_id % 97 = 0 OR event_id % 3 = 0, 'ms': CAST(user_id * 90 AS BIGINT)}}] AS layers
    FROM events"""
_STATUS = """CASE WHEN id % 97 = 0 THEN 'passthrough' WHEN id % 50 = 0 OR id % 3 = 0 THEN 'partial'
    WHEN findings_count = 0 THEN 'clean' ELSE 'full' END"""
FLAT = "id, ts, provider, source, latency_ms, findings_count, blocked, reason"
TABLES = {"reports": _REPORTS}


def reports(spark: SparkSession, sf: str) -> DataFrame:
    return reports_of(read_table(spark, sf, "events"))


def reports_of(e: DataFrame) -> DataFrame:
    eid = F.col("event_id")
    layer = lambda name, skipped, ms: F.struct(
        F.lit(name).alias("name"), skipped.alias("skipped"), ms.cast("bigint").alias("ms")
    )
    numbers = F.filter(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda k: k < F.col("user_id") % 4)
    rows = e.select(
        eid.alias("id"),
        "ts",
        F.element_at(F.array(*[F.lit(h) for h in HOSTS]), (eid % 4 + 1).cast("int")).alias("provider"),
        F.when(eid % 4 == 3, "scan").otherwise("proxy").alias("source"),
        F.floor("value").cast("bigint").alias("latency_ms"),
        (F.col("event_type") == "error").alias("blocked"),
        F.when(F.col("event_type") == "error", "blocked file").otherwise("").alias("reason"),
        (F.col("user_id") % 4).cast("int").alias("findings_count"),
        F.transform(
            numbers,
            lambda k: F.struct(
                F.element_at(F.array(*[F.lit(x) for x in LABELS]), ((eid + k) % 5 + 1).cast("int")).alias("label"),
                F.concat(F.lit("value"), ((eid + k) % 17).cast("string")).alias("original"),
                F.when((eid + k) % 5 == 4, "entropy").otherwise("presidio").alias("layer"),
            ),
        ).alias("redactions"),
        F.array(
            layer("presidio", eid % 97 == 0, F.col("user_id")),
            layer("entropy", (eid % 97 == 0) | (eid % 50 == 0), F.col("user_id") * 7),
            layer("gliner", (eid % 97 == 0) | (eid % 3 == 0), F.col("user_id") * 90),
        ).alias("layers"),
    )
    return rows.withColumn("status", R.request_status(F.col("layers"), F.size("redactions")))


def flat(df: DataFrame) -> DataFrame:
    return df.select(*FLAT.split(", "))


@query("report_by_id", with_tables(f"SELECT {FLAT} FROM reports WHERE id = 42", **TABLES))
def report_by_id(spark: SparkSession, sf: str) -> DataFrame:
    return flat(reports(spark, sf).where(F.col("id") == 42))


@query(
    "reports_filtered",
    with_tables(
        f"""SELECT {FLAT} FROM reports WHERE provider = 'api.openai.com' AND source = 'proxy' AND NOT blocked
            AND ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00'""",
        **TABLES,
    ),
)
def reports_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return flat(
        R.query_reports(
            reports(spark, sf),
            provider="api.openai.com",
            source="proxy",
            blocked=False,
            since=F.lit("2024-01-10 00:00:00").cast("timestamp"),
            until=F.lit("2024-01-20 12:00:00").cast("timestamp"),
        )
    )


for _n, _name in ((50, "reports_latest"), (8, "reports_recent"), (100, "reports_log")):

    def _latest(spark: SparkSession, sf: str, n: int = _n) -> DataFrame:
        return flat(R.query_reports(reports(spark, sf), limit=n))

    query(_name, with_tables(f"SELECT {FLAT} FROM reports ORDER BY ts DESC, id LIMIT {_n}", **TABLES))(_latest)


@query(
    "reports_search",
    with_tables(
        f"""SELECT {FLAT} FROM reports WHERE NOT blocked AND findings_count > 0 AND
            len(list_filter(redactions, lambda r: contains(lower(r.label), 'jwt') OR contains(lower(r.original), 'jwt'))) > 0""",
        **TABLES,
    ),
)
def reports_search(spark: SparkSession, sf: str) -> DataFrame:
    return flat(R.search(reports(spark, sf), "JWT", "redacted"))


@query("providers", with_tables("SELECT DISTINCT provider FROM reports", **TABLES))
def providers(spark: SparkSession, sf: str) -> DataFrame:
    return reports(spark, sf).select("provider").distinct()


@query(
    "report_stats",
    with_tables(
        f"""SELECT count(*) AS total_scanned, CAST(coalesce(sum(findings_count), 0) AS BIGINT) AS total_redactions,
              count(*) FILTER (WHERE blocked) AS total_blocked, round(coalesce(avg(latency_ms), 0), 6) AS avg_latency_ms
            FROM reports WHERE ts >= {NOW_SQL} - INTERVAL 10 DAY AND ts <= {NOW_SQL}""",
        **TABLES,
    ),
)
def report_stats(spark: SparkSession, sf: str) -> DataFrame:
    now = F.lit(NOW).cast("timestamp")
    return R.stats(reports(spark, sf), now - F.expr("INTERVAL 10 DAYS"), now)


@query(
    "hourly_buckets",
    with_tables(
        f"""SELECT CAST(b AS INTEGER) AS bucket, count(id) AS scanned, count(id) FILTER (WHERE findings_count > 0) AS redacted,
              count(id) FILTER (WHERE blocked) AS blocked, round(coalesce(avg(latency_ms), 0), 6) AS avg_latency
            FROM range(0, 24) n(b) LEFT JOIN reports ON ts <= {NOW_SQL} AND 23 - floor((epoch_us({NOW_SQL}) - epoch_us(ts)) / 3600000000.0) = b
            GROUP BY b""",
        **TABLES,
    ),
)
def hourly_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return R.hourly(reports(spark, sf), F.lit(NOW).cast("timestamp"))


@query(
    "report_trend",
    with_tables(
        """SELECT metric, recent, older, CASE WHEN recent = 0 AND older = 0 THEN '—' WHEN older = 0 THEN '+' || recent
              ELSE (CASE WHEN pct > 0 THEN '+' ELSE '' END) || pct || '%' END AS change
           FROM (SELECT *, CAST(floor((recent - older) * 100.0 / nullif(older, 0) + 0.5) AS BIGINT) AS pct FROM (
             SELECT 'scanned' AS metric, count(*) FILTER (WHERE r) AS recent, count(*) FILTER (WHERE NOT r) AS older FROM h
             UNION ALL SELECT 'redacted', count(*) FILTER (WHERE r AND findings_count > 0), count(*) FILTER (WHERE NOT r AND findings_count > 0) FROM h
             UNION ALL SELECT 'blocked', count(*) FILTER (WHERE r AND blocked), count(*) FILTER (WHERE NOT r AND blocked) FROM h))""",
        **TABLES,
        h="SELECT *, row_number() OVER (ORDER BY ts DESC, id) <= ceil((SELECT count(*) FROM reports) / 2.0) AS r FROM reports",
    ),
)
def report_trend(spark: SparkSession, sf: str) -> DataFrame:
    return R.trend(reports(spark, sf))


@query("request_status", with_tables(f"SELECT id, {_STATUS} AS status FROM reports", **TABLES))
def request_status(spark: SparkSession, sf: str) -> DataFrame:
    return reports(spark, sf).select("id", "status")


@query(
    "requests_total",
    with_tables(f"SELECT provider AS upstream, {_STATUS} AS status, count(*) AS total FROM reports GROUP BY 1, 2", **TABLES),
)
def requests_total(spark: SparkSession, sf: str) -> DataFrame:
    return R.requests_total(reports(spark, sf))


@query(
    "entities_total",
    with_tables(
        "SELECT r.label AS entity_type, r.layer AS layer, count(*) AS total FROM (SELECT unnest(redactions) AS r FROM reports) GROUP BY 1, 2",
        **TABLES,
    ),
)
def entities_total(spark: SparkSession, sf: str) -> DataFrame:
    return R.entities_total(reports(spark, sf))


@query(
    "errors_total",
    with_tables(
        "SELECT l.name AS layer, 'skipped' AS error_type, count(*) AS total FROM (SELECT unnest(layers) AS l FROM reports) WHERE l.skipped GROUP BY 1",
        **TABLES,
    ),
)
def errors_total(spark: SparkSession, sf: str) -> DataFrame:
    return R.errors_total(reports(spark, sf))


def _histogram(source: str, key: str, ms: str) -> str:
    bounds = ", ".join(f"('{b}', CAST({b} AS DOUBLE))" for b in R.LATENCY_BOUNDS) + ", ('+Inf', CAST('inf' AS DOUBLE))"
    return f"""SELECT {key} AS name, le, count(*) FILTER (WHERE {ms} / 1000.0 <= b) AS cumulative,
        round(sum({ms} / 1000.0), 4) AS sum_seconds, count(*) AS n FROM {source}, (VALUES {bounds}) v(le, b) GROUP BY 1, 2"""


@query("latency_histogram", with_tables(_histogram("reports", "provider", "latency_ms"), **TABLES))
def latency_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return R.latency_histogram(reports(spark, sf), F.col("provider"), F.col("latency_ms"))


@query(
    "latency_histogram_layers",
    with_tables(_histogram("(SELECT unnest(layers) AS l FROM reports)", "l.name", "l.ms"), **TABLES),
)
def latency_histogram_layers(spark: SparkSession, sf: str) -> DataFrame:
    rows = reports(spark, sf).select(F.explode("layers").alias("l"))
    return R.latency_histogram(rows, F.col("l.name"), F.col("l.ms"))


@query(
    "latency_percentiles",
    with_tables(
        """SELECT provider, round(quantile_cont(latency_ms, 0.5), 6) AS p50, round(quantile_cont(latency_ms, 0.95), 6) AS p95,
              round(quantile_cont(latency_ms, 0.99), 6) AS p99 FROM reports GROUP BY 1""",
        **TABLES,
    ),
)
def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return R.percentiles(reports(spark, sf))


@query(
    "layer_health",
    with_tables(
        "SELECT provider, bool_and(NOT l.skipped) AS healthy, count(*) FILTER (WHERE l.skipped) AS skipped FROM (SELECT provider, unnest(layers) AS l FROM reports) GROUP BY 1",
        **TABLES,
    ),
)
def layer_health(spark: SparkSession, sf: str) -> DataFrame:
    return R.layer_health(reports(spark, sf))


@query(
    "scan_reports_built",
    with_tables(
        """SELECT k2.id, CASE WHEN n.n IS NULL THEN 'clean' ELSE 'full' END AS status, CAST(coalesce(n.n, 0) AS INTEGER) AS findings_count,
             CAST(len(marks) AS INTEGER) AS applied_count, coalesce(n.labels, '') AS labels, false AS blocked
           FROM k2 LEFT JOIN (SELECT id, count(*) AS n, string_agg(label, ',' ORDER BY s, e DESC, layer_ord, ord) AS labels FROM f GROUP BY id) n ON n.id = k2.id""",
        **_CASCADE,
        k2=_CLEAN,
    ),
)
def scan_reports_built(spark: SparkSession, sf: str) -> DataFrame:
    scanned = scan_and_redact(corpus(spark, sf), settings=BENCH)
    timed = scanned.select(
        "*",
        F.timestamp_seconds(F.lit(1704067200) + F.col("id")).alias("ts"),
        F.lit("api").alias("provider"),
        F.lit("scan").alias("source"),
        F.lit(0).cast("bigint").alias("latency_ms"),
        F.lit(None).cast("boolean").alias("blocked"),
        F.lit(None).cast("string").alias("reason"),
    )
    return R.build_reports(timed).select(
        "id",
        "status",
        "findings_count",
        "applied_count",
        F.array_join(F.transform("redactions", lambda r: r.label), ",").alias("labels"),
        "blocked",
    )


# --- stored sketches ---------------------------------------------------------------------------------

#: Share of the values by which the rank of a percentile from a sketch may be off.
TOLERANCE = 0.02


@query(
    "latency_sketches",
    with_tables(
        """SELECT provider, range, p, count(*) AS n, true AS within FROM (
             SELECT provider, 'all' AS range FROM reports UNION ALL
             SELECT provider, 'ten days' FROM reports WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-20 00:00:00'), (VALUES (50), (95), (99)) v(p)
           GROUP BY 1, 2, 3""",
        **TABLES,
    ),
)
def latency_sketches(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles merged from hourly sketches that were stored, held against the ranks of their values among all."""
    folder = new_folder(spark, "sketches")
    rows = reports(spark, sf)
    R.latency_sketches(rows).write.parquet(folder)
    stored = spark.read.parquet(folder)
    low, high = (F.lit(f"2024-01-{day} 00:00:00").cast("timestamp") for day in (10, 20))
    ranges = {"all": (rows, stored), "ten days": (rows.where((F.col("ts") >= low) & (F.col("ts") < high)), stored.where((F.col("hour") >= low) & (F.col("hour") < high)))}
    out = []
    for name, (own, sketches) in ranges.items():
        points = R.sketch_percentiles(sketches).select("provider", "n", F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.col(f"p{p}").alias("value")) for p in (50, 95, 99)])).alias("x")).select("provider", "n", "x.p", "x.value")
        ranked = own.groupBy("provider", "latency_ms").agg(F.count("*").alias("many")).join(points, "provider").groupBy("provider", "p", "n").agg(
            F.sum(F.when(F.col("latency_ms") < F.col("value"), F.col("many")).otherwise(0)).alias("below"), F.sum(F.when(F.col("latency_ms") <= F.col("value"), F.col("many")).otherwise(0)).alias("up_to")
        )
        share = F.col("p") / 100
        within = (F.col("below") / F.col("n") <= share + TOLERANCE) & (F.col("up_to") / F.col("n") >= share - TOLERANCE)
        out.append(ranked.select("provider", F.lit(name).alias("range"), "p", "n", within.alias("within")))
    return out[0].unionByName(out[1])
