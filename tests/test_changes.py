"""Change logs folded, now and at earlier times; lists in their orders; numbers within groups of any size."""

import datetime as dt
import random

from pyspark.sql import functions as F
from veilwright.operators import changes, fleet, numbering, reports, sessions

SCHEMA = "id string, change string, at timestamp, name string, revoked boolean, seen timestamp"


def at(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


ROWS = [
    ("a", "create", at(2), "first", False, None), ("a", "touch", at(3), None, None, at(3)), ("a", "revoke", at(5), None, True, None), ("a", "touch", at(6), None, None, at(4)),
    ("a", "create", at(7), "second", False, None),  # an id is made once
    ("b", "touch", at(1), None, None, at(1)), ("b", "create", at(2), "b", False, None),  # touched before it was there
    ("c", "revoke", at(2), None, True, None),  # never made
    ("d", "create", at(2), "d", False, None), ("d", "revoke", at(2), None, True, None),  # at once
    (None, "create", at(1), "x", False, None), ("e", "create", None, "x", False, None),
]


def test_fold_and_states_as_of(spark):
    log = spark.createDataFrame(ROWS, SCHEMA)
    fields = ["name", "revoked", "seen"]
    state = lambda when=None: {r.id: (r["name"], r.revoked, r.seen) for r in changes.fold(log, fields, when).collect()}
    assert state() == {"a": ("first", True, at(4)), "b": ("b", False, None), "d": ("d", True, None)}
    assert state(F.lit(at(3))) == {"a": ("first", False, at(3)), "b": ("b", False, None), "d": ("d", True, None)}
    assert state(F.lit(at(1, 23))) == {}
    counted = {r.id: r.n for r in changes.fold(log, ["name"], counts={"n": "touch"}).collect()}
    assert counted == {"a": 2, "b": 0, "d": 0}
    assert changes.fold(log.limit(0), fields).collect() == []


def test_logs_of_several_kinds(spark):
    rows = spark.createDataFrame([("a", at(1)), ("b", at(2))], "key string, made timestamp")
    log = changes.log(
        changes.change(rows, changes.CREATE, "key", F.col("made"), {"status": F.lit("building"), "ref": F.lit("")}),
        changes.change(rows.where("key = 'b'"), "result", "key", F.col("made") + F.expr("INTERVAL 1 HOUR"), {"status": F.lit("ready")}),
    )
    assert {r.id: (r.status, r.ref) for r in changes.fold(log, ["status", "ref"]).collect()} == {"a": ("building", ""), "b": ("ready", "")}


def test_places_in_lists(spark):
    rows = [("o1", "x", at(3)), ("o1", "y", at(1)), ("o1", "z", at(3)), ("o2", "w", None), (None, "v", at(1))]
    df = spark.createDataFrame(rows, "org string, id string, made timestamp")
    oldest = {r.id: r.place for r in changes.listed(df, "org", ["made", "id"]).collect()}
    newest = {r.id: r.place for r in changes.listed(df, "org", [F.desc("made"), "id"]).collect()}
    assert oldest == {"y": 1, "x": 2, "z": 3, "w": 1, "v": 1} and newest == {"x": 1, "z": 2, "y": 3, "w": 1, "v": 1}


def test_numbers_in_groups_of_any_size(spark):
    """One key holds most rows, all of them at one time, over many parts."""
    pick = random.Random(4)
    rows = [(pick.choice([None, "hot", "hot", "hot", "hot", "cold"]), at(1) if k % 9 else None, k, "own") for k in range(2000)]
    df = spark.createDataFrame(rows, "key string, at timestamp, tie int, part string").repartition(16)
    got = numbering.numbered(df, "key", ["at", "tie"], "n").collect()
    for key in (None, "hot", "cold"):
        own = sorted((r for r in got if r.key == key), key=lambda r: r.n)
        assert [r.n for r in own] == list(range(len(own))) and {r.part for r in own} == {"own"}
        assert [(r.at is not None, r.tie) for r in own] == sorted((r.at is not None, r.tie) for r in own)
    ranked = {r.tie: r.use for r in fleet.running_rank(df, "key", "at", "tie", "use").collect()}
    assert ranked == {r.tie: r.n + 1 for r in got}
    assert numbering.numbered(df.limit(0), "key", ["at"], "n").collect() == []


def test_trend_of_reports_with_one_time(spark):
    rows = [(k, at(1), [] if k % 2 else [("x",)], k < 6) for k in range(11)]
    df = spark.createDataFrame(rows, "id int, ts timestamp, redactions array<struct<label:string>>, blocked boolean")
    got = {r.metric: (r.recent, r.older) for r in reports.trend(df).collect()}
    assert got == {"scanned": (6, 5), "redacted": (3, 3), "blocked": (6, 0)}


def test_sketches_merge(spark):
    rows = [(dt.datetime(2024, 1, 1, k % 24), "ab"[k % 2], (k * 7919) % 5000 if k % 50 else None) for k in range(20_000)]
    df = spark.createDataFrame(rows, "ts timestamp, provider string, latency_ms int")
    stored = reports.latency_sketches(df)
    assert stored.count() == 24
    for r in reports.sketch_percentiles(stored).collect():
        own = sorted(x[2] for x in rows if x[1] == r.provider and x[2] is not None)
        assert r.n == len(own)
        for p, value in ((0.5, r.p50), (0.95, r.p95), (0.99, r.p99)):
            assert abs(sum(x < value for x in own) / len(own) - p) < 0.02


def test_passing(spark):
    rows = [(1, "a", True), (1, "b", False), (2, "a", None)]
    got = {r.user_id: (r.passing, r.total) for r in sessions.passing(spark.createDataFrame(rows, "user_id int, check string, ok boolean")).collect()}
    assert got == {1: (1, 2), 2: (0, 1)}


def test_scratch_tables_are_shared_and_can_be_removed(spark, monkeypatch):
    import pytest
    from veilwright.sources import scratch

    back = scratch.written(spark.range(3), "scratch-test")
    assert back.count() == 3 and scratch.children(spark, scratch.application_folder(spark)) != []
    folder = scratch.new_folder(spark, "alone")
    spark.range(1).write.parquet(folder)
    assert scratch.removed(spark, folder) and not scratch.removed(spark, folder) and scratch.children(spark, folder) == []

    class Cluster:
        class sparkContext:  # noqa: N801
            master, applicationId = "spark://x:7077", "app"
            getConf = staticmethod(dict)

        class conf:  # noqa: N801
            get = staticmethod(lambda key, *rest: {"spark.sql.warehouse.dir": "file:/tmp/w"}.get(key, *rest))

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_folder(Cluster)
    Cluster.conf.get = staticmethod(lambda key, *rest: {"spark.sql.warehouse.dir": "hdfs://n/w"}.get(key, *rest))
    assert scratch.new_folder(Cluster, "t").startswith("hdfs://n/w/scratch/app/t-")
