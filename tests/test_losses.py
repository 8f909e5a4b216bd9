"""Rows that must not get lost: null keys and times, late texts, neighbours of a failing text."""

import datetime as dt

import pytest
from conftest import SMALL
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from veilwright.operators import fleet, ml, reports
from veilwright.plans import fleet_queries
from veilwright.plans.all_queries import QUERIES
from veilwright.streaming import jobs

DAY = dt.datetime(2024, 3, 1, 10, 0, 0)


def test_running_rank_keeps_null_keys_and_times(spark):
    rows = [("a", DAY, 1), ("a", DAY, 2), ("a", None, 3), (None, DAY, 4), (None, None, 5), (None, DAY - dt.timedelta(days=3), 6)]
    rows += [("a", DAY + dt.timedelta(minutes=k, hours=k // 3), 10 + k) for k in range(1, 9)]
    df = spark.createDataFrame(rows, "k string, at timestamp, id long")
    got = {r.id: r.n for r in fleet.running_rank(df, "k", "at", "id", "n").collect()}
    assert len(got) == len(rows)
    for key in ("a", None):
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or DAY, r[2]))
        assert [got[r[2]] for r in own] == list(range(1, len(own) + 1))


@pytest.mark.parametrize("n", range(1, 9))
def test_trend_counts_reports_without_a_time(spark, n):
    times = [DAY, DAY, DAY, None, DAY + dt.timedelta(milliseconds=1), DAY + dt.timedelta(seconds=1), None, DAY - dt.timedelta(days=2)][:n]
    df = spark.createDataFrame([(i, t, ["x"], i % 2 == 0) for i, t in enumerate(times)], "id long, ts timestamp, redactions array<string>, blocked boolean")
    got = {r.metric: (r.recent, r.older) for r in reports.trend(df).collect()}
    half = -(-n // 2)
    assert got["scanned"] == (half, n - half)
    ranked = sorted(range(n), key=lambda i: (times[i] is None, -(times[i] or DAY).timestamp(), i))
    assert got["blocked"] == (sum(i % 2 == 0 for i in ranked[:half]), sum(i % 2 == 0 for i in ranked[half:]))


def test_a_failing_text_stands_alone():
    def predict(texts):
        if "bad" in texts:
            raise RuntimeError("no")
        return [[t] for t in texts]

    assert ml.isolated(predict, ["a", "bad", "c", "d", "bad", "f", "g", "h"]) == [["a"], None, ["c"], ["d"], None, ["f"], ["g"], ["h"]]
    assert ml.isolated(predict, []) == []


def test_an_entity_without_a_label_stays(spark):
    row = spark.createDataFrame([(("John Fox", "", 0, 8, 0.99),)], f"e {ml.ENTITY}")
    assert row.select(ml.keep_first(F.col("e"), ["PERSON"]).alias("k")).first().k


def test_late_texts_are_seen(spark, tmp_path):
    for k, texts in enumerate([["a", "b"], ["b", "c"], ["d", "a"]]):
        spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
        (tmp_path / "in").mkdir(exist_ok=True)
        for f in (tmp_path / f"in{k}").glob("part-*.parquet"):
            f.rename(tmp_path / "in" / f"{k}.parquet")
    stream = jobs.file_stream(spark, str(tmp_path / "in"), "*.parquet", "text string", files_per_trigger=1)
    jobs.to_parquet(jobs.first_sightings(stream), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c", "d"]


def test_rules_of_a_stream_must_be_readable_once(spark, tmp_path):
    def broken():
        raise OSError("no file")

    spark.createDataFrame([(1, "x")], "id long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, text string").parquet(str(tmp_path / "in"))
    with pytest.raises(StreamingQueryException, match="no file"):
        jobs.reloading_scan(stream, broken, lambda df, n: None, str(tmp_path / "c")).awaitTermination()


def test_sessions_are_in_order(spark):
    got = QUERIES["sessions_ranked"](spark, SMALL).collect()
    rank = {"runaway": 0, "unknown": 1}
    keys = [(rank.get(r.status, 2), -r.started_at.timestamp() if hasattr(r.started_at, "timestamp") else -r.started_at, r.pid) for r in got]
    assert keys == sorted(keys)


def test_one_large_and_many_small_batches(spark):
    sizes = [r["count"] for r in fleet_queries.events(spark, SMALL).groupBy("batch_id").count().collect()]
    assert max(sizes) > fleet.MAX_BATCH and min(sizes) <= fleet.MAX_BATCH


def test_percentiles(spark):
    import numpy as np

    rows = [("a", v) for v in (5, 1, 9, 9, 2, 2, 2, 30)] + [("b", 7), ("c", None), ("a", None)] + [(None, 3), (None, 4)]
    df = spark.createDataFrame(rows, "provider string, latency_ms long")
    got = {r.provider: (r.p50, r.p95, r.p99) for r in reports.percentiles(df).collect()}
    for key in ("a", "b", None):
        own = [v for k, v in rows if k == key and v is not None]
        assert got[key] == pytest.approx(tuple(np.percentile(own, [50, 95, 99])))
    assert got["c"] == (None, None, None)


def test_context_gate_keeps_what_it_is_told(spark):
    from veilwright.plans.cascade import cascade, gate_layer, pattern_layer

    df = spark.createDataFrame([(1, "mail a.b@corp.io, ssn 536-22-8726")], "id long, text string")
    labels = lambda layers: [f.label for f in cascade(df, layers).first().findings]
    assert labels([pattern_layer(), gate_layer()]) == labels([pattern_layer()])
    assert labels([pattern_layer(), gate_layer(lambda f: f.label != "US_SSN")]) == [x for x in labels([pattern_layer()]) if x != "US_SSN"] != []


def test_provider_addresses_are_joined_by_equality(spark):
    from veilwright.operators import sessions

    ends = ["10.0.0.2:443", "10.0.0.1:443", "10.0.0.2:443", "10.0.0.9:443", "10.0.0.1:22", "127.0.0.1:8080"]
    rows = [(1, "claude --x", "", " ".join(f"a->{e}\n" for e in ends)), (2, "aider", "", ""), (2, "aider", "", "a->10.0.0.1:80\n"), (3, "vi", "", "a->10.0.0.1:80\n")]
    snapshots = spark.createDataFrame(rows, "pid long, command string, env_text string, conn_text string")
    ips = spark.createDataFrame([("10.0.0.1",), ("10.0.0.2",), ("10.0.0.2",), (None,)], "ip string")
    got = sessions.classify(snapshots, ips, "127.0.0.1:8080")
    assert sorted((r.pid, r.direct_ai_conn, r.status) for r in got.collect()) == [(1, ends[:3], "runaway"), (2, [], "unknown"), (2, ["10.0.0.1:80"], "runaway")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and "collect_set" not in plan
