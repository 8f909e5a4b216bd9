"""Results kept between runs and in streams; tables that a repeated batch leaves as they were."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from veilwright.operators import fleet, kept
from veilwright.plans.cascade import Settings
from veilwright.streaming import jobs, state

SCHEMA = "id long, text string"


def texts(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def outcome(df):
    return sorted(((r.id, r.redacted_text, len(r.findings), r.scanned) for r in df.collect()), key=repr)


MAIL, MASK = "mail a.b@corp.io", "mail [REDACTED-EMAIL_ADDRESS]"


def test_kept_results(spark, tmp_path):
    store, first = str(tmp_path), texts(spark, [(1, MAIL), (1, MAIL), (None, MAIL), (2, None), (None, None), (3, "")])
    want = [(1, MASK, 1), (1, MASK, 1), (None, MASK, 1), (2, None, 0), (None, None, 0), (3, "", 0)]
    assert outcome(kept.scan_kept(first, store)) == sorted(((*w, True) for w in want), key=repr)
    assert outcome(kept.scan_kept(first, store)) == sorted(((*w, False) for w in want), key=repr)
    more = texts(spark, [(9, MAIL), (10, "new")])
    assert outcome(kept.scan_kept(more, store)) == [(10, "new", 0, True), (9, MASK, 1, False)]
    off = Settings(toggles={"email_regex": False})
    assert outcome(kept.scan_kept(more, store, off)) == [(10, "new", 0, True), (9, MAIL, 0, True)]
    assert outcome(kept.scan_kept(more, store, allowed=["A.B@corp.io"])) == [(10, "new", 0, True), (9, MAIL, 0, True)]
    assert outcome(kept.scan_kept(more, store)) == [(10, "new", 0, False), (9, MASK, 1, False)]
    # Another session finds the files of this one; what is not of the present rules can be removed.
    other = spark.newSession()
    assert outcome(kept.scan_kept(texts(other, [(9, MAIL)]), store)) == [(9, MASK, 1, False)]
    assert len(kept.invalidate(spark, store, but=kept.fingerprint())) == 2
    assert kept.invalidate(spark, store) == [kept.fingerprint()] and kept.invalidate(spark, store) == []
    assert outcome(kept.scan_kept(more, store, off)) == [(10, "new", 0, True), (9, MAIL, 0, True)]


def test_kept_side_is_not_shuffled(spark, tmp_path):
    df = kept.scan_kept(texts(spark, [(1, MAIL)]), str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    below = plan[: plan.index("kept_")]
    assert "Bucketed: true" in plan and "Exchange" not in below[below.rindex("Aggregate") :]


@pytest.mark.parametrize("few", [0, 100])
def test_a_new_text_moves_once(spark, tmp_path, monkeypatch, few):
    """Whether new texts are few or many, and whether a text has many copies; to the task of its bucket and no further."""
    monkeypatch.setattr(kept, "FEW", few)
    monkeypatch.setattr(kept, "OFTEN", 2)
    own = texts(spark, [(1, MAIL), (1, MAIL), (None, MAIL), (2, None), (None, None), (3, "x"), (4, "x"), (5, "old")])
    assert outcome(kept.scan_kept(own.where("id = 5"), str(tmp_path))) == [(5, "old", 0, True)]
    want = [(1, MASK, 1, True)] * 2 + [(None, MASK, 1, True), (2, None, 0, True), (None, None, 0, True), (3, "x", 0, True), (4, "x", 0, True), (5, "old", 0, False)]
    assert outcome(kept.scan_kept(own, str(tmp_path))) == sorted(want, key=repr)
    rows = own.select("id", "text", kept.text_hash("text").alias("hash"))
    new = rows.groupBy(F.col("hash").alias("new")).agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    plan = kept.new_texts(rows, new.localCheckpoint())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(hash#") == 1 and f", {kept.BUCKETS}), REPARTITION_BY_NUM" in plan


def test_fingerprint():
    prints = [kept.fingerprint(), kept.fingerprint(Settings(toggles={"ipv4": True})), kept.fingerprint(Settings(entropy_length=9)), kept.fingerprint(allowed=["x"]), kept.fingerprint(models={"gliner": "2"}), kept.fingerprint(Settings(custom=(("A", "a+"),)))]
    assert len(set(prints)) == len(prints) and kept.fingerprint(allowed=["X"]) == kept.fingerprint(allowed=["x"])


def add(spark, folder, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_stream_answers_repeats(spark, tmp_path):
    source, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    stream = lambda: jobs.file_stream(spark, source, "*.parquet", texts(spark, []).schema, files_per_trigger=1)
    add(spark, source, [(1, MAIL), (2, MAIL), (3, None), (None, "x")])
    add(spark, source, [(4, MAIL), (5, None), (6, "y")])
    jobs.to_parquet(state.scan_once(stream()), out, cp).awaitTermination()
    add(spark, source, [(7, MAIL), (8, "x"), (9, "z")])
    jobs.to_parquet(state.scan_once(stream()), out, cp).awaitTermination()  # goes on where it stopped
    got = outcome(spark.read.parquet(out))
    assert [g[:3] for g in got] == sorted([(1, MASK, 1), (2, MASK, 1), (3, None, 0), (None, "x", 0), (4, MASK, 1), (5, None, 0), (6, "y", 0), (7, MASK, 1), (8, "x", 0), (9, "z", 0)], key=repr)
    scans = {}
    for _, text, _, scanned in got:
        scans[text] = scans.get(text, 0) + scanned
    assert scans == {MASK: 1, None: 1, "x": 1, "y": 1, "z": 1}


def test_stream_forgets_results(spark, tmp_path, monkeypatch):
    """Once the timer is past, a text is scanned again."""
    monkeypatch.setattr(state, "SLACK", "0 seconds")
    source, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    for k in range(4):
        add(spark, source, [(k, MAIL)])
        stream = jobs.file_stream(spark, source, "*.parquet", texts(spark, []).schema, files_per_trigger=1)
        jobs.to_parquet(state.scan_once(stream, keep_ms=1), out, cp).awaitTermination()
    got = outcome(spark.read.parquet(out))
    assert [g[:3] for g in got] == [(k, MASK, 1) for k in range(4)] and all(g[3] for g in got)


def test_observed_clock(spark, tmp_path):
    folder, source, cp = (str(tmp_path / n) for n in ("tables", "in", "cp"))
    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    schema = "id int, verdict string, observed_at timestamp"
    files = [[(1, "a", at(5)), (2, "a", at(6, 30))], [(3, "a", at(6, 25)), (4, "b", at(6, 15)), (5, "b", None)], [(6, "a", at(9))], [(7, "a", at(8, 55)), (8, "a", at(6, 30))]]
    stream = lambda: jobs.file_stream(spark, source, "*.parquet", spark.createDataFrame([], schema).schema, files_per_trigger=1)
    for rows in files:
        add(spark, source, rows, schema)
        state.observed_counts(stream(), folder, cp).awaitTermination()  # stopped and started between files
    assert sorted(r.id for r in state.late_events(spark, folder).collect()) == [4, 5, 8]
    panes = {(r.hour.hour, r.verdict): r.n for r in state.observed_panes(spark, folder).collect()}
    assert panes == {(5, "a"): 1, (6, "a"): 2, (8, "a"): 1, (9, "a"): 1}


@pytest.mark.parametrize("size", [1, 3, 24])
def test_sliding_windows(spark, size):
    rows = [(k, "ab"[k % 2], dt.datetime(2024, 1, 1) + dt.timedelta(minutes=37 * k * (1 + k // 20))) for k in range(60)] + [(99, "a", None)]
    df = spark.createDataFrame(rows, "id int, verdict string, at timestamp")
    got = sorted(map(tuple, fleet.sliding(fleet.panes(df, "at", ["verdict"]), ["verdict"], size).collect()))
    plain = df.groupBy(F.window("at", f"{size} hours", "1 hour").alias("w"), "verdict").count().select("w.start", "verdict", "count")
    assert got == sorted(map(tuple, plain.collect()))


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    folder = str(tmp_path)
    schema = "upstream string, status string, total long"
    batches = [[("a", "x", 1), ("b", None, 2)], [("a", "x", 5)], [("c", "y", 1), ("b", None, 4)]]
    for number, rows in enumerate(batches):
        for _ in range(2):
            state.put_merged(spark.createDataFrame(rows, schema), folder, number, ["upstream", "status"])
    assert sorted(map(tuple, state.state_of(spark, folder).collect()), key=repr) == sorted([("a", "x", 5), ("b", None, 4), ("c", "y", 1)], key=repr)


def test_feed_gives_each_report_once(spark, tmp_path):
    folder, source, cp = (str(tmp_path / n) for n in ("feed", "in", "cp"))
    got, fail = {}, [True]
    stream = lambda: jobs.file_stream(spark, source, "*.parquet", texts(spark, []).schema, files_per_trigger=1)

    def send(batch, number):
        got[number] = sorted(r.report for r in batch.collect())
        if number == 1 and fail.pop():
            fail.append(False)
            raise OSError("the line is down")

    named = lambda: stream().withColumn("report", state.report_id("id", "text"))
    for k in range(3):
        add(spark, source, [(k, "r"), (k + 10, None)])
    with pytest.raises(Exception, match="the line is down"):
        state.feed(named(), send, folder, cp).awaitTermination()
    before = dict(got)
    fail[:] = [False]
    state.feed(named(), send, folder, cp).awaitTermination()
    assert got[0] == before[0] and got[1] == before[1] and sorted(got) == [0, 1, 2]
    assert len({x for own in got.values() for x in own}) == 6


def test_one_call_into_python_is_for_many_texts(spark, tmp_path, monkeypatch):
    """Texts share groups; those that share one are told apart, and a text may have more rows than a portion."""
    monkeypatch.setattr(state, "BUCKETS", 2)
    monkeypatch.setattr(state, "ROWS_AT_ONCE", 3)
    source, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    for _ in range(2):
        add(spark, source, [(k, f"{MAIL} {k % 20}") for k in range(60)])
    stream = jobs.file_stream(spark, source, "*.parquet", texts(spark, []).schema, files_per_trigger=1)
    once = state.scan_once(stream)
    jobs.to_parquet(once, out, cp).awaitTermination()
    got = outcome(spark.read.parquet(out))
    assert [g[:3] for g in got] == sorted([(k, f"{MASK} {k % 20}", 1) for k in range(60) for _ in range(2)], key=repr)
    assert len({g[1] for g in got if g[3]}) == 20 == sum(g[3] for g in got)
    assert "bucket" in once._jdf.queryExecution().analyzed().toString()


def test_one_call_into_python_is_for_many_tokens(spark, tmp_path, monkeypatch):
    """Tokens that share a group are told apart, in parts and batches of any size; ids are whole numbers, also beside nulls."""
    monkeypatch.setattr(jobs, "TOKEN_GROUPS", 2)
    day, big = lambda k: dt.datetime(1996, 1, 1) + dt.timedelta(days=k), 2**53 + 1
    tokens = spark.createDataFrame([(f"t{k}", k % 4, k == 5, day(40)) for k in range(9)] + [("many", 30, False, day(40))], "token_hash string, max_uses int, revoked boolean, expires_at timestamp")
    rows = [(big + k if k % 7 else None, f"t{k % 10}", day(50 - k % 60)) for k in range(120)] + [(big + k, "many", day(k % 3)) for k in range(50)]
    files = [rows[0::3], rows[1::3], rows[2::3]]
    schema = "attempt_id long, token_hash string, attempted_at timestamp"
    source, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for own in files:
            add(spark, source, own, schema)
            stream = jobs.file_stream(spark, source, "*.parquet", spark.createDataFrame([], schema).schema)
            taken = jobs.admissions(stream, tokens)
            jobs.to_parquet(taken, out, cp).awaitTermination()  # goes on where it stopped
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    want, uses = [], {}
    limits = {r.token_hash: r for r in tokens.collect()}
    for own in files:
        for i, token, at in sorted(own, key=lambda r: (r[2], r[0] is None, r[0])):
            t = limits.get(token)
            if t and not t.revoked and at <= t.expires_at and (t.max_uses == 0 or uses.get(token, 0) < t.max_uses):
                uses[token] = uses.get(token, 0) + 1
                want.append((token, i, at))
    got = [tuple(r) for r in spark.read.parquet(out).select("token_hash", "attempt_id", "attempted_at").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert uses["many"] == 30 and None in {i for _, i, _ in got}
    assert "bucket" in taken._jdf.queryExecution().analyzed().toString()
