"""Fleet data: organisations, devices, enrolment tokens, policies, monitoring events.

Changes are appended, never updated in place; the current state is the latest row per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilwright.operators.numbering import numbered

# Verdicts, the size limit of one batch, the policy of an organisation without one.
VERDICTS = ("protected", "runaway", "unknown")
MAX_BATCH = 500
SEED_POLICY = '{"image":"base:local","mountMode":"bind","denylist":[]}'


def accepted_batches(events: DataFrame, limit: int = MAX_BATCH) -> DataFrame:
    """Events of batches that are not too large; a batch is taken or refused whole.

    Sizes are counted before the join, so a huge batch is combined on the map side, and only the few
    refused batch ids travel to the events.
    """
    refused = events.groupBy("batch_id").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("batch_id")
    return events.join(refused, "batch_id", "left_anti")


def ingest(events: DataFrame, devices: DataFrame) -> DataFrame:
    """Authorised events with the organisation of their device."""
    return authorised(accepted_batches(events), devices)


def authorised(events: DataFrame, devices: DataFrame) -> DataFrame:
    """Events whose device exists, is not revoked and belongs to the organisation they name."""
    known = devices.where(~F.col("revoked")).select(F.col("id").alias("device_id"), "org_id")
    return events.join(known, ["device_id", "org_id"], "left_semi")


def rejected(events: DataFrame, devices: DataFrame) -> DataFrame:
    known = devices.where(~F.col("revoked")).select(F.col("id").alias("device_id"), "org_id")
    return events.join(known, ["device_id", "org_id"], "left_anti")


def org_scope(rows: DataFrame, orgs: DataFrame) -> DataFrame:
    """Rows of organisations that exist."""
    return rows.join(orgs.select("org_id"), "org_id", "left_semi")


def latest(events: DataFrame, org: str, n: int = 100) -> DataFrame:
    return (
        events.where(F.col("org_id") == org)
        .orderBy(F.desc("received_at"), "id")
        .limit(n if n > 0 else 100)
    )


def verdict_counts(events: DataFrame, since: Column) -> DataFrame:
    return events.where(F.col("received_at") >= since).groupBy("org_id", "verdict").agg(F.count("*").alias("n"))


def verdict_board(events: DataFrame, since: Column) -> DataFrame:
    """One row per organisation; a verdict without events counts 0."""
    counts = [F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS]
    return events.where(F.col("received_at") >= since).groupBy("org_id").agg(*counts)


def panes(events: DataFrame, clock: str, keys: list[str]) -> DataFrame:
    """``(hour, keys, n)``: events of each hour."""
    hour = F.date_trunc("hour", clock).cast(events.schema[clock].dataType)
    return events.groupBy(hour.alias("hour"), *keys).agg(F.count("*").alias("n"))


def sliding(counts: DataFrame, keys: list[str], size: int = 24) -> DataFrame:
    """``(window_start, keys, n)`` of all windows of ``size`` hours, one each hour, that hold an event.

    Made from hourly counts (``hour``, keys, ``n``), which are summed over the hours of a window; an event
    is never laid out once for each of its windows. An hour opens the windows that begin after the hour
    with events before it, ``size`` at most; events without a time are in no window.
    """
    counts = counts.where("hour IS NOT NULL")
    step = F.expr("INTERVAL 1 HOUR")
    before = F.lag("hour").over(Window.partitionBy(*keys).orderBy("hour"))  # a row for each hour
    earliest = F.col("hour") - F.expr(f"INTERVAL {size - 1} HOURS")
    opened = counts.withColumn("since", F.greatest(earliest, before + step))
    starts = opened.select(F.explode(F.sequence("since", "hour", step)).alias("hour"), *keys, F.lit(0).cast("bigint").alias("n"), F.lit(True).alias("is_start"))
    seconds = F.unix_seconds(F.col("hour").cast("timestamp"))
    ahead = Window.partitionBy(*keys).orderBy(seconds).rangeBetween(0, (size - 1) * 3600)
    both = counts.select("hour", *keys, "n", F.lit(False).alias("is_start")).unionByName(starts)
    summed = both.withColumn("n", F.sum("n").over(ahead)).where("is_start")
    return summed.select(F.col("hour").alias("window_start"), *keys, "n")


def device_last_seen(devices: DataFrame, events: DataFrame) -> DataFrame:
    """Devices with the time of their latest authorised event, null when there is none."""
    seen = authorised(events, devices).groupBy(F.col("device_id").alias("id")).agg(F.max("received_at").alias("last_seen_at"))
    return devices.join(seen, "id", "left")


def current_state(changes: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Latest row per key of an append-only change log."""
    return changes.groupBy(key).agg(
        F.max_by(F.struct(*columns), F.struct(*order)).alias("r")
    ).select(key, *[F.col(f"r.{c}").alias(c) for c in columns])


def token_hash(raw: Column) -> Column:
    return F.sha2(raw, 256)


def running_rank(rows: DataFrame, key: str, time: str, tie: str, out: str) -> DataFrame:
    """Position (from 1) of each row among those of its key, in order of time; a null time comes first.

    One key may own a third of all rows, all at one time: rows are numbered by ranges of (key, time, tie).
    """
    return numbered(rows, key, [time, tie], out).withColumn(out, F.col(out) + 1)


def admit(attempts: DataFrame, tokens: DataFrame) -> DataFrame:
    """Enrolment attempts with ``accepted``.

    In order of time a token takes attempts while it is neither revoked nor expired and has uses
    left; 0 uses means no limit.  Only valid attempts on limited tokens are ranked.
    """
    joined = attempts.join(tokens, "token_hash", "left")
    valid = (~F.col("revoked")) & (F.col("attempted_at") <= F.col("expires_at"))
    checked = joined.withColumn("valid", F.coalesce(valid, F.lit(False)))
    limited = checked.where(F.col("valid") & (F.col("max_uses") > 0))
    ranked = running_rank(limited, "token_hash", "attempted_at", "attempt_id", "use")
    ranked = ranked.withColumn("accepted", F.col("use") <= F.col("max_uses")).drop("use")
    rest = checked.where(~F.col("valid") | (F.col("max_uses") == 0)).withColumn("accepted", F.col("valid"))
    return ranked.unionByName(rest).drop("valid")


def policy_versions(writes: DataFrame) -> DataFrame:
    """Writes with their version: 1, 2, 3, .. per organisation, in order of time."""
    return running_rank(writes, "org_id", "written_at", "write_id", "version")


def policy_current(writes: DataFrame) -> DataFrame:
    """Last policy and number of writes per organisation; combined on the map side."""
    return writes.groupBy("org_id").agg(
        F.max_by("bundle", F.struct("written_at", "write_id")).alias("bundle"), F.count("*").alias("version")
    )


def canonical_bundle(bundle: Column, version: Column) -> Column:
    """Policy with default mount mode, a list instead of null, and its version."""
    b = F.from_json(bundle, "image string, mountMode string, denylist array<string>")
    return F.to_json(
        F.struct(
            b.image.alias("image"),
            F.coalesce(F.nullif(b.mountMode, F.lit("")), F.lit("bind")).alias("mountMode"),
            F.coalesce(b.denylist, F.array().cast("array<string>")).alias("denylist"),
            version.alias("version"),
        )
    )


def policy_effective(orgs: DataFrame, writes: DataFrame) -> DataFrame:
    """Policy of every organisation; one without writes gets the seed, version 0."""
    return orgs.select("org_id").join(policy_current(writes), "org_id", "left").select(
        "org_id",
        F.coalesce("bundle", F.lit(SEED_POLICY)).alias("bundle"),
        F.coalesce("version", F.lit(0)).cast("bigint").alias("version"),
    )
