"""Scan reports: building them, searching them, adding them up.

A report: id, ts, provider, source, latency_ms, redactions (array of label, original, start, end,
layer), layers (array of name, findings_count, latency_ms, skipped), blocked, reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilwright.operators.numbering import numbered

# Upper bounds of the latency histogram, in seconds.
LATENCY_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def request_status(layers: Column, findings: Column) -> Column:
    """passthrough: every layer skipped; partial: some; clean: none and nothing found; else full."""
    return (
        F.when(F.forall(layers, lambda x: x.skipped), "passthrough")
        .when(F.exists(layers, lambda x: x.skipped), "partial")
        .when(findings == 0, "clean")
        .otherwise("full")
    )


def build_reports(scanned: DataFrame) -> DataFrame:
    """Scan results with request columns (ts, provider, source, latency_ms) -> reports.

    ``findings_count`` counts findings, ``applied_count`` those that were masked.
    """
    return scanned.select(
        "id",
        "ts",
        "provider",
        "source",
        "latency_ms",
        F.transform(
            "findings",
            lambda f: F.struct(
                f.label.alias("label"), f.value.alias("original"), f.start.alias("start"), f.end.alias("end"),
                f.layer.alias("layer"),
            ),
        ).alias("redactions"),
        "layers",
        request_status(F.col("layers"), F.size("findings")).alias("status"),
        F.size("findings").alias("findings_count"),
        F.size("applied").alias("applied_count"),
        F.coalesce("blocked", F.lit(False)).alias("blocked"),
        F.coalesce("reason", F.lit("")).alias("reason"),
        F.to_date("ts").alias("date"),
    )


def write_reports(reports: DataFrame, path: str) -> None:
    """Append to the report log, one folder per day."""
    reports.write.mode("append").partitionBy("date").parquet(path)


def query_reports(
    reports: DataFrame,
    provider: str | None = None,
    source: str | None = None,
    blocked: bool | None = None,
    since=None,
    until=None,
    limit: int = 0,
) -> DataFrame:
    """Newest first.  Both time bounds belong to the range; no limit means all."""
    out = reports
    if provider:
        out = out.where(F.col("provider") == provider)
    if source:
        out = out.where(F.col("source") == source)
    if blocked is not None:
        out = out.where(F.col("blocked") == blocked)
    if since is not None:
        out = out.where(F.col("ts") >= F.lit(since))
    if until is not None:
        out = out.where(F.col("ts") <= F.lit(until))
    return out.orderBy(F.desc("ts"), "id").limit(limit) if limit > 0 else out


def status_of(reports: DataFrame) -> Column:
    return F.when(F.col("blocked"), "blocked").when(F.size("redactions") > 0, "redacted").otherwise("clean")


def search(reports: DataFrame, term: str, status: str | None = None) -> DataFrame:
    """Term in provider, reason, or the label or original of a redaction, in any case."""
    t = term.lower()
    hit = (
        F.lower("provider").contains(t)
        | F.lower("reason").contains(t)
        | F.exists("redactions", lambda r: F.lower(r.label).contains(t) | F.lower(r.original).contains(t))
    )
    out = reports.where(hit)
    return out.where(status_of(reports) == status) if status else out


def stats(reports: DataFrame, since, until) -> DataFrame:
    return query_reports(reports, since=since, until=until).agg(
        F.count("*").alias("total_scanned"),
        F.coalesce(F.sum(F.size("redactions")), F.lit(0)).alias("total_redactions"),
        F.count_if("blocked").alias("total_blocked"),
        F.round(F.coalesce(F.avg("latency_ms"), F.lit(0.0)), 6).alias("avg_latency_ms"),
    )


def hourly(reports: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Buckets of one hour back from ``now``; bucket ``hours`` - 1 is the newest, empty ones are there."""
    micros = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    age = F.floor(micros / F.lit(3_600_000_000)).cast("int")
    counted = (
        reports.where((F.col("ts") <= now) & (F.col("ts") > now - F.expr(f"INTERVAL {hours} HOURS")))
        .groupBy((F.lit(hours - 1) - age).alias("bucket"))
        .agg(
            F.count("*").alias("scanned"),
            F.count_if(F.size("redactions") > 0).alias("redacted"),
            F.count_if("blocked").alias("blocked"),
            F.round(F.avg("latency_ms"), 6).alias("avg_latency"),
        )
    )
    every = reports.sparkSession.range(hours).select(F.col("id").cast("int").alias("bucket"))
    return every.join(counted, "bucket", "left").na.fill(0).na.fill(0.0)


def trend(reports: DataFrame) -> DataFrame:
    """Newer half of the reports against the older half; reports without a ts are the oldest.

    The boundary is the place at which the halves part. Counts by hour find its hour, counts by second
    in that hour its second, and only the reports of that second are numbered.
    """
    second = F.date_trunc("second", "ts")
    per_second = reports.groupBy(second.alias("sec")).agg(F.count("*").alias("n"))
    per_hour = per_second.groupBy(F.date_trunc("hour", "sec").alias("hour")).agg(F.sum("n").alias("n"))
    total = per_hour.agg(F.sum("n").alias("total")).select(F.ceil(F.col("total") / 2).alias("half"))

    def cut(counts: DataFrame, at: str) -> DataFrame:
        """The unit of time in which the boundary lies, and how many of its reports are recent."""
        newest = Window.orderBy(F.desc_nulls_last(at)).rowsBetween(Window.unboundedPreceding, -1)
        placed = counts.withColumn("before", F.coalesce(F.sum("n").over(newest), F.lit(0)))
        return placed.where((F.col("before") < F.col("half")) & (F.col("before") + F.col("n") >= F.col("half"))).select(
            F.col(at).alias("cut"), (F.col("half") - F.col("before")).alias("need")
        )

    # Hours are few whatever the log holds, and an hour has 3600 seconds: both windows are small.
    hours = cut(per_hour.crossJoin(F.broadcast(total)), "hour")
    inner = per_second.crossJoin(F.broadcast(hours.select(F.col("cut").alias("hour"), F.col("need").alias("half"))))
    seconds = cut(inner.where(F.date_trunc("hour", "sec").eqNullSafe(F.col("hour"))), "sec")
    tagged = reports.withColumn("sec", second).crossJoin(F.broadcast(seconds))
    here = F.col("sec").eqNullSafe(F.col("cut"))
    later = F.when(F.col("cut").isNull(), F.col("sec").isNotNull()).otherwise(F.coalesce(F.col("sec") > F.col("cut"), F.lit(False)))
    # All reports may have one time, so even this second is numbered by ranges.
    placed = numbered(tagged.where(here), "sec", [F.desc("ts"), "id"], "place_in_second")
    split = placed.withColumn("recent", F.col("place_in_second") < F.col("need")).drop("place_in_second").unionByName(tagged.where(~here).withColumn("recent", later))
    names = {"scanned": F.lit(True), "redacted": F.size("redactions") > 0, "blocked": F.col("blocked")}
    sums = [
        F.count_if(cond & (F.col("recent") == side)).alias(f"{name}_{half}")
        for name, cond in names.items()
        for half, side in (("recent", True), ("older", False))
    ]
    totals = split.agg(*sums)
    return totals.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(n).alias("metric"), F.col(f"{n}_recent").alias("recent"), F.col(f"{n}_older").alias("older"))
                    for n in names
                ]
            )
        ).alias("t")
    ).select("t.*").withColumn(
        "change",
        F.when((F.col("recent") == 0) & (F.col("older") == 0), "—")
        .when(F.col("older") == 0, F.concat(F.lit("+"), F.col("recent").cast("string")))
        .otherwise(
            F.concat(
                F.when(F.col("recent") > F.col("older"), F.when(_percent() != 0, "+").otherwise("")).otherwise(""),
                _percent().cast("string"),
                F.lit("%"),
            )
        ),
    )


def _percent() -> Column:
    """Rounded change; halves go up, as in the dashboard."""
    return F.floor((F.col("recent") - F.col("older")) * 100 / F.col("older") + 0.5).cast("bigint")


# --- counters and histograms -------------------------------------------------------------------------


def requests_total(reports: DataFrame) -> DataFrame:
    return reports.groupBy(F.col("provider").alias("upstream"), "status").agg(F.count("*").alias("total"))


def entities_total(reports: DataFrame) -> DataFrame:
    return (
        reports.select(F.explode("redactions").alias("r"))
        .groupBy(F.col("r.label").alias("entity_type"), F.col("r.layer").alias("layer"))
        .agg(F.count("*").alias("total"))
    )


def errors_total(reports: DataFrame) -> DataFrame:
    return (
        reports.select(F.explode("layers").alias("l"))
        .where("l.skipped")
        .groupBy(F.col("l.name").alias("layer"), F.lit("skipped").alias("error_type"))
        .agg(F.count("*").alias("total"))
    )


def latency_histogram(reports: DataFrame, key: Column, ms: Column) -> DataFrame:
    """Cumulative counts per bound, as rows; one pass, the bounds are columns until the end."""
    seconds = ms / F.lit(1000.0)
    bounds = [*LATENCY_BOUNDS, float("inf")]
    counted = reports.groupBy(key.alias("name")).agg(
        *[F.count_if(seconds <= b).alias(f"b{i}") for i, b in enumerate(bounds)],
        F.round(F.sum(seconds), 4).alias("sum_seconds"),
        F.count("*").alias("n"),
    )
    labels = [*[str(b) for b in LATENCY_BOUNDS], "+Inf"]
    rows = F.array(*[F.struct(F.lit(x).alias("le"), F.col(f"b{i}").alias("cumulative")) for i, x in enumerate(labels)])
    return counted.select("name", F.explode(rows).alias("b"), "sum_seconds", "n").select(
        "name", "b.le", "b.cumulative", "sum_seconds", "n"
    )


def percentiles(reports: DataFrame, exact: bool = True) -> DataFrame:
    """P50, P95 and P99 of the latency per provider, values between two reports interpolated.

    The exact form counts each latency first, so what is ordered are different latencies, not reports;
    no provider's reports are held in one buffer.  The sketch is the form for unbounded latencies.
    """
    points = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    if not exact:
        value = F.percentile_approx("latency_ms", list(points.values()), 10_000).cast("array<double>")
        return reports.groupBy("provider").agg(value.alias("p")).select(
            "provider", *[F.round(F.col("p")[i], 6).alias(n) for i, n in enumerate(points)]
        )
    counts = reports.groupBy("provider", "latency_ms").agg(F.count("latency_ms").alias("n"))
    own = Window.partitionBy("provider")
    up_to = own.orderBy("latency_ms").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.select("provider", "latency_ms", F.sum("n").over(up_to).alias("up_to"), F.sum("n").over(own).alias("total"))

    def at(rank: Column) -> Column:
        """The latency at a rank, counted from 0."""
        return F.min(F.when(F.col("up_to") > rank, F.col("latency_ms")))

    values = []
    for name, p in points.items():
        place = F.lit(p) * (F.col("total") - 1)
        values += [at(F.floor(place)).alias(f"{name}_low"), at(F.ceil(place)).alias(f"{name}_high")]
    found = placed.groupBy("provider", "total").agg(*values)

    def between(name: str, p: float) -> Column:
        place = F.lit(p) * (F.col("total") - 1)
        part = place - F.floor(place)
        return F.round(F.col(f"{name}_low") * (1 - part) + F.col(f"{name}_high") * part, 6).alias(name)

    return found.select("provider", *[between(name, p) for name, p in points.items()])


# --- sketches ----------------------------------------------------------------------------------------

#: Size of a sketch; the rank of a value it gives is off by about 2.3 / K of all values at most.
SKETCH_K = 400


def latency_sketches(reports: DataFrame) -> DataFrame:
    """``(hour, provider, sketch, n)``: a mergeable sketch of the latencies of each hour, to be stored."""
    timed = reports.where("latency_ms IS NOT NULL")
    return timed.groupBy(F.date_trunc("hour", "ts").alias("hour"), "provider").agg(
        F.kll_sketch_agg_bigint(F.col("latency_ms").cast("bigint"), SKETCH_K).alias("sketch"), F.count("*").alias("n")
    )


def sketch_percentiles(sketches: DataFrame, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """P50, P95 and P99 of each provider over a range of hours, from stored sketches alone; an hour is never read twice."""
    chosen = sketches.where((F.col("hour") >= since) if since is not None else F.lit(True)).where((F.col("hour") < until) if until is not None else F.lit(True))
    merged = chosen.groupBy("provider").agg(F.kll_merge_agg_bigint("sketch", SKETCH_K).alias("sketch"), F.sum("n").alias("n"))
    points = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    return merged.select("provider", "n", *[F.kll_sketch_get_quantile_bigint("sketch", F.lit(p)).alias(name) for name, p in points.items()])


def layer_health(reports: DataFrame) -> DataFrame:
    """Healthy when every layer of every report ran."""
    return reports.select("provider", F.explode("layers").alias("l")).groupBy("provider").agg(
        F.bool_and(~F.col("l.skipped")).alias("healthy"), F.count_if("l.skipped").alias("skipped")
    )
