import json

import pytest
from pyspark.sql import functions as F
from veilwright.operators import extract, hosts, ml
from veilwright.operators.blocking import blocked_extensions, content_is_blocked, file_is_blocked
from veilwright.plans.cascade import cascade, entropy_layer, pattern_layer
from veilwright.plans.scan import scan_and_redact
from veilwright.sources.catalog import effective
from veilwright.streaming import jobs


def body(*messages, **more):
    return json.dumps({"model": "m", "messages": list(messages), **more})


def test_last_user_message(spark):
    rows = [
        ("text", body({"role": "user", "content": "one"}, {"role": "user", "content": "[1] two"}, {"role": "assistant", "content": "x"})),
        ("parts", body({"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "image"}, {"type": "tool_result", "content": "b"}]})),
        ("nobody", body({"role": "assistant", "content": "x"})),
        ("number", body({"role": "user", "content": 5})),
        ("broken", "{"),
    ]
    out = {r.id: (r.text, r.error) for r in extract.last_user_message(spark.createDataFrame(rows, "id string, body string")).collect()}
    assert out["text"] == ("[1] two", "")
    assert out["parts"] == ("a\nb", "")
    assert out["nobody"][1] == "no user message found"
    assert out["number"][1] == "unsupported content format"
    assert out["broken"][1] == "parse request body"


def clean(df):
    return scan_and_redact(df).select("id", "redacted_text")


def test_rewrite_keeps_parts_and_other_fields(spark):
    parts = [{"type": "text", "text": "line one\nmail a.b@corp.io"}, {"type": "tool_result", "content": 'say "c.d@corp.io"', "tool_use_id": "t1"}]
    rows = [
        ("parts", body({"role": "system", "content": "a.b@corp.io"}, {"role": "user", "content": parts}, stream=True)),
        ("text", body({"role": "user", "content": "é a.b@corp.io"})),
        ("broken", "{"),
    ]
    out = {r.id: r.body for r in extract.rewrite_requests(spark.createDataFrame(rows, "id string, body string"), clean).collect()}
    done = json.loads(out["parts"])
    assert done["stream"] is True and done["messages"][0]["content"] == "a.b@corp.io"
    assert done["messages"][1]["content"] == [
        {"type": "text", "text": "line one\nmail [REDACTED-EMAIL_ADDRESS]"},
        {"type": "tool_result", "content": 'say "[REDACTED-EMAIL_ADDRESS]"', "tool_use_id": "t1"},
    ]
    assert json.loads(out["text"])["messages"] == [{"role": "user", "content": "é [REDACTED-EMAIL_ADDRESS]"}]
    assert out["broken"] == "{"


def test_rewrite_changes_nothing_but_texts(spark):
    mail, masked = "a.b@corp.io", "[REDACTED-EMAIL_ADDRESS]"

    def request(text, other):
        image = {"type": "image", "source": {"data": other, "kind": "x"}}
        nested = {"type": "tool_result", "tool_use_id": "t", "content": [{"type": "text", "text": text, "k": 1}, image], "is_error": False}
        parts = [{"type": "text", "text": text, "cache_control": {"type": "ephemeral"}}, image, nested, {"type": "text", "n": 5}, {"type": "tool_result", "content": text}]
        return body({"role": "user", "content": other}, {"role": "user", "name": "n", "content": parts}, {"role": "assistant", "content": other}, temperature=0.5)

    rows = [(i, request(f"{mail} {k}", mail)) for k, i in enumerate(["same", "same", None, None])]
    rows += [("same", body({"role": "user", "content": mail, "name": "z"})), (None, body({"role": "user", "content": f"x {mail}"}))]
    out = extract.rewrite_requests(spark.createDataFrame(rows, "id string, body string"), clean).collect()
    want = [json.loads(request(f"{masked} {k}", mail)) for k in range(4)]
    want += [json.loads(body({"role": "user", "content": masked, "name": "z"})), json.loads(body({"role": "user", "content": f"x {masked}"}))]
    order = lambda x: json.dumps(x, sort_keys=True)
    assert sorted(map(order, [json.loads(r.body) for r in out])) == sorted(map(order, want))
    assert [r.id for r in out].count("same") == 3


def test_tool_messages(spark):
    rows = [
        ("parts", json.dumps({"id": 1, "result": {"content": [{"type": "text", "text": 'a "b" a.b@corp.io'}, {"type": "text", "text": "c.d@corp.io"}], "k": 1}})),
        ("string", json.dumps({"result": "a.b@corp.io"})),
        ("params", json.dumps({"params": {"content": "a.b@corp.io", "n": 2}})),
        ("other", json.dumps({"result": {"x": 1}})),
        ("broken", "nope"),
    ]
    out = {r.id: r.message for r in extract.clean_rpc(spark.createDataFrame(rows, "id string, message string"), clean).collect()}
    mask = "[REDACTED-EMAIL_ADDRESS]"
    assert json.loads(out["parts"]) == {"id": 1, "result": {"content": [{"type": "text", "text": f'a "b" {mask}'}, {"type": "text", "text": mask}], "k": 1}}
    assert json.loads(out["string"]) == {"result": mask}
    assert json.loads(out["params"]) == {"params": {"content": mask, "n": 2}}
    assert out["other"] == rows[3][1] and out["broken"] == "nope"


def test_nothing_hides_behind_a_repeated_key_or_a_broken_body(spark):
    mail, mask = "bob@corp.io", "[REDACTED-EMAIL_ADDRESS]"
    message = '{"role":"assistant","role":"user","content":"x","content":"mail %s"}' % mail
    rows = [
        ("model", '{"model":"a","model":"b","messages":[{"role":"user","content":"mail %s"}]}' % mail),
        ("message", '{"messages":[],"messages":[%s]}' % message),
        ("part", '{"messages":[{"role":"user","content":[{"type":"x","type":"text","text":"","text":"%s"}]}]}' % mail),
        ("cut", '{"messages":[{"role":"user","content":"mail %s' % mail), ("list", '["mail %s"]' % mail), ("string", '"mail %s"' % mail),
        ("odd", '{"messages":"mail %s"}' % mail), ("huge", '{"n":1e999,"messages":[{"role":"user","content":"%s"}]}' % mail), ("nothing", None), ("none", '{"messages":null}'),
    ]
    out = {r.id: r for r in extract.rewrite_requests(spark.createDataFrame(rows, "id string, body string"), clean).collect()}
    assert len(out) == len(rows) and not any(mail in (r.body or "") for r in out.values())
    assert json.loads(out["model"].body) == {"model": "b", "messages": [{"role": "user", "content": f"mail {mask}"}]}
    assert json.loads(out["message"].body) == {"messages": [{"role": "user", "content": f"mail {mask}"}]}
    assert json.loads(out["part"].body) == {"messages": [{"role": "user", "content": [{"type": "text", "text": mask}]}]}
    wrong = {"cut", "list", "string", "odd", "huge", "nothing"}
    assert {i for i, r in out.items() if r.error == "parse request body"} == wrong and out["none"].error == "no user message found"
    assert all(out[i].body == dict(rows)[i].replace(mail, mask) for i in wrong - {"nothing"}) and out["nothing"].body is None

    rows = [("twice", '{"result":"x","result":"mail %s"}' % mail), ("text", '{"result":{"content":[{"text":"a","text":"%s"}]}}' % mail), ("cut", '{"result":"%s' % mail)]
    out = {r.id: r for r in extract.clean_rpc(spark.createDataFrame(rows, "id string, message string"), clean).collect()}
    assert json.loads(out["twice"].message) == {"result": f"mail {mask}"} and json.loads(out["text"].message) == {"result": {"content": [{"text": mask}]}}
    assert (out["cut"].message, out["cut"].error) == ('{"result":"%s' % mask, "parse message")


def test_hosts_and_bypass(spark):
    rows = [("API.openai.com:443", "GET", "/v1/models"), ("x.y", "options", "/v1/chat"), ("x.y", "GET", "/v1/models/gpt"), ("x.y", "GET", "/.well-known/a")]
    out = spark.createDataFrame(rows, "host string, method string, path string").select(
        hosts.decision(F.col("host"), list(hosts.INTERCEPTED), ["x.y"]).alias("d"),
        hosts.bypass_reason(F.col("method"), F.col("path")).alias("b"),
    ).collect()
    assert [(r.d, r.b) for r in out] == [("scan", "exact_match"), ("reject", "method_match"), ("reject", ""), ("reject", "prefix_match")]


def test_blocking(spark):
    rows = [("/app/.env", "x"), ("/src/main.go", "A=1\r\nB_C=2\r\nD=3"), ("a/KEY.PEM", "A=1\nB=")]
    out = spark.createDataFrame(rows, "path string, text string").select(
        file_is_blocked(F.col("path"), [".env", ".pem"]).alias("f"), content_is_blocked(F.col("text")).alias("c")
    ).collect()
    assert [(r.f, r.c) for r in out] == [(True, False), (False, True), (True, False)]
    assert blocked_extensions([".PEM", ".x"], effective({"file_block_key": False}), True) == ([".env", ".tfstate", ".pem", ".p12", ".pfx", ".x"], True)


@pytest.mark.parametrize(
    "label,text,score,kept",
    [
        ("PERSON", "John Smith", 0.95, True), ("ORGANIZATION", "Acme", 0.9, False), ("PERSON", "J", 0.85, False),
        ("PERSON", "John", 0.55, False), ("PERSON", "Patient", 0.95, False), ("EMAIL", "no at sign", 0.9, False),
        ("PASSWORD", "password", 0.9, False), ("PASSWORD", "hunter22x", 0.9, True), ("ADDRESS", "[street]", 0.9, False),
        ("ADDRESS", "your street", 0.9, False), ("IP_ADDRESS", "10.0.0.1", 0.9, False), ("IBAN", "a__b1", 0.9, False),
    ],
)
def test_first_model_filter(spark, label, text, score, kept):
    row = spark.createDataFrame([((text, label, 0, len(text), score),)], f"e {ml.ENTITY}")
    assert row.select(ml.keep_first(F.col("e"), ml.suppressed_labels()).alias("k")).first().k is kept


@pytest.mark.parametrize(
    "label,text,kept",
    [
        ("PRIVATE_PERSON", "John Smith", True), ("PRIVATE_PERSON", "john smith", False), ("SECRET", "abcd", False),
        ("SECRET", "abcdefgh1", True), ("PRIVATE_URL", "/path", False), ("PRIVATE_EMAIL", "bcdfg", False),
        ("PRIVATE_DATE", "1/1/1", False), ("ACCOUNT_NUMBER", "12345", True), ("PRIVATE_EMAIL", "[REDACTED-X]", False),
    ],
)
def test_second_model_filter(spark, label, text, kept):
    row = spark.createDataFrame([((text, label, 0, len(text), 0.95),)], f"e {ml.ENTITY}")
    assert row.select(ml.keep_second(F.col("e")).alias("k")).first().k is kept


def stub_model():
    """A loader whose model marks every "John Smith" and refuses a batch with the word boom."""

    def load():
        def predict(texts):
            if any("boom" in t for t in texts):
                raise RuntimeError("model is down")
            out = []
            for t in texts:
                at = t.find("John Smith")
                span = {"text": "John Smith", "label": "PERSON", "start": at, "end": at + 10, "score": 0.95}
                out.append([] if at < 0 else [span])
            return out

        return predict

    return load


def test_model_layer_in_any_order(spark):
    texts = spark.createDataFrame([("a", "mail a.b@corp.io from John Smith")], "id string, text string")
    model = ml.model_layer(stub_model())
    for layers in ([pattern_layer(), entropy_layer(), model], [model, pattern_layer(), entropy_layer()]):
        row = scan_and_redact(texts, layers=layers).first()
        assert row.redacted_text == "mail [REDACTED-EMAIL_ADDRESS] from [REDACTED-PERSON]"
        assert {(f.label, f.start, f.end) for f in row.findings} == {("EMAIL_ADDRESS", 5, 16), ("PERSON", 22, 32)}


def test_failing_model_is_isolated(spark):
    texts = spark.createDataFrame([("a", "boom a.b@corp.io")], "id string, text string")
    row = cascade(texts, [pattern_layer(), ml.model_layer(stub_model())]).first()
    assert len(row.findings) == 1
    assert [(x.name, x.skipped) for x in row.layers] == [("presidio", False), ("gliner", True)]


def test_rules_reload_between_batches(spark, tmp_path):
    from veilwright.plans.cascade import Settings

    source, out = str(tmp_path / "in"), []
    texts = [("a", "mail a.b@corp.io"), ("b", "mail a.b@corp.io"), ("c", "mail a.b@corp.io")]
    for row in texts:
        spark.createDataFrame([row], "id string, text string").coalesce(1).write.mode("append").parquet(source)
    states = iter([Settings(), Settings(toggles={"email_regex": False}), None])

    def settings():
        s = next(states)
        if s is None:
            raise ValueError("bad config")
        return s

    def sink(df, number):
        out.extend(r.redacted_text for r in df.collect())

    stream = jobs.file_stream(spark, source, "*.parquet", "id string, text string", files_per_trigger=1)
    jobs.reloading_scan(stream, settings, sink, str(tmp_path / "state")).awaitTermination()
    assert out == ["mail [REDACTED-EMAIL_ADDRESS]", "mail a.b@corp.io", "mail a.b@corp.io"]


def test_labelled_corpus_with_string_and_number_values(spark, tmp_path):
    from veilwright.operators import evaluate
    from veilwright.operators.detect import detect
    from veilwright.sources.patterns import profile

    path = tmp_path / "labelled.json"
    text = "mail a.b@corp.io pin 4711 name Ann ip 10.20.30.40"
    pii = [
        {"value": "a.b@corp.io", "start": 5, "end": 16, "label": "email"},
        {"value": 4711, "start": 21, "end": 25, "label": "pin"},
        {"value": "Ann", "start": 31, "end": 34, "label": "name"},
    ]
    path.write_text(json.dumps([{"id": "s1", "text": text, "locale": "en", "domain": "x", "pii": pii}]))
    labelled = evaluate.read_labelled(spark, str(path))
    assert [t.value for t in labelled.first().truth] == ["a.b@corp.io", "4711", "Ann"]
    scored = evaluate.score(detect(labelled, profile("compat")), ["name"])
    row = evaluate.summary(scored).first()
    assert (row.caught, row.missed, row.false_pos) == (1, 1, 1)
    assert (row.precision_pct, row.recall_pct, row.f1) == (50.0, 50.0, 50.0)


def test_a_model_gets_texts_in_portions():
    import pandas as pd

    texts = ["ab"] * 600 + [None, "x" * (1 << 20), "cd"] + ["y" * 100_000] * 12
    got = list(ml.portions(iter([pd.Series(texts), pd.Series([], dtype=object), pd.Series(["last"])])))
    assert [t for part in got for t in part] == [t or "" for t in texts] + ["last"]
    assert all(0 < len(part) <= 256 and (len(part) == 1 or sum(map(len, part)) <= 1 << 19) for part in got)


def test_spans_of_a_batch_come_back_in_their_places(spark):
    def load():
        def predict(texts):
            assert len(texts) <= 256
            if any(t.endswith("7") for t in texts):
                raise ValueError
            return [[{"text": t, "label": "PERSON", "start": 0, "end": len(t), "score": 0.9}] for t in texts]
        return predict

    df = spark.range(3000).coalesce(1).selectExpr("id", "concat('Ann ', id) AS text")
    got = cascade(df, [ml.model_layer(load)]).selectExpr("id", "findings.value AS v", "layers[0].skipped AS skipped").collect()
    assert len(got) == 3000
    assert all((r.v, r.skipped) == (([], True) if r.id % 10 == 7 else ([f"Ann {r.id}"], False)) for r in got)
