"""Spans found in each other, against trying every pair; time limits of a model."""

import random
import time

import pytest
from pyspark.sql import functions as F
from veilwright.operators import deadline, evaluate, matching, ml
from veilwright.plans.cascade import cascade


def meets(t, f):
    return f[0] in t[0] or t[0] in f[0] or (f[1] <= t[2] and f[2] >= t[1])


@pytest.mark.parametrize("in_order", [True, False])
def test_meeting_against_all_pairs(in_order):
    pick = random.Random(5)
    for _ in range(300):
        def spans(n):
            out = []
            for _ in range(n):
                start = pick.randint(0, 60)
                value = "".join(pick.choice("abé") for _ in range(pick.choice([0, 1, 1, 2, 2, 3, 4, 6])))
                out.append((value, start, start + pick.choice([0, 1, 2, 20])))
            return sorted(out, key=lambda s: (s[1], -s[2])) if in_order else out

        truth, found = spans(pick.randint(0, 9)), spans(pick.randint(0, 9))
        truth = [t if pick.random() < 0.5 else (t[0] + "xyz", *t[1:]) for t in truth]
        m = matching.Meeting(truth, found)
        for t in truth:
            want = [i for i, f in enumerate(found) if meets(t, f)]
            assert m.all(t) == want and m.first(t) == (want[0] if want else None)
        assert m.unmet() == [i for i, f in enumerate(found) if not any(meets(t, f) for t in truth)]


def test_few_pairs_are_tried_one_by_one():
    pick = random.Random(6)
    for _ in range(300):
        truth, found = ([("".join(pick.choice("abé") for _ in range(pick.randint(0, 4))), at := pick.randint(0, 60), at + pick.choice([0, 1, 20])) for _ in range(pick.randint(0, 10))] for _ in range(2))
        m, whole = matching.meeting(truth, found), matching.Meeting(truth, found)
        assert isinstance(m, matching.Pairs) == (len(truth) * len(found) <= matching.FEW_PAIRS)
        assert [m.all(t) for t in truth] == [whole.all(t) for t in truth] and [m.first(t) for t in truth] == [whole.first(t) for t in truth] and m.unmet() == whole.unmet()


def test_many_spans_in_one_text():
    n = 10_000
    truth = [(f"name {i} of many", 40 * i, 40 * i + 10) for i in range(n)]
    found = [(f"name {i}", 40 * i + 20, 40 * i + 25) if i % 2 else (f"other {i}", 40 * i + 5, 40 * i + 8) for i in range(n)]
    begin = time.time()
    m = matching.Meeting(truth, found)
    firsts, unmet = [m.first(t) for t in truth], m.unmet()
    assert time.time() - begin < 10
    held = {f[0]: i for i, f in enumerate(found)}
    for k in (0, 1, 7, 1234, 9999):
        want = [i for i, f in enumerate(found) if meets(truth[k], f)]
        assert firsts[k] == want[0] and m.all(truth[k]) == want
    assert unmet == [] and len(held) == n


def test_score_with_nothing(spark):
    rows = [(1, [], []), (2, None, None), (3, [("ab", 0, 2, "X")], []), (4, [], [("ab", 0, 2, "Y", "l")])]
    schema = "id int, truth array<struct<value:string,start:int,end:int,label:string>>, findings array<struct<value:string,start:int,end:int,label:string,layer:string>>"
    got = {r.id: (len(r.credited), len(r.wrong)) for r in evaluate.score(spark.createDataFrame(rows, schema), []).collect()}
    assert got == {1: (0, 0), 2: (0, 0), 3: (1, 0), 4: (0, 1)}
    levels = {(r.level, r.layer, r.label): (r.total, r.caught, r.false_pos) for r in evaluate.breakdown(evaluate.score(spark.createDataFrame(rows, schema), [])).collect()}
    assert levels == {("all", None, None): (1, 0, 1), ("layer", "l", None): (0, 0, 1), ("layer_label", "l", "Y"): (0, 0, 1), ("label", None, "X"): (1, 0, 0), ("label", None, "Y"): (0, 0, 1)}


def slow_model():
    """A loader that travels as it is: workers do not see this module."""

    def load():
        import os
        import time

        def predict(texts):
            for t in texts:
                if t == "hang":
                    time.sleep(600)
                if t == "exit":
                    os._exit(3)
                if t == "fail":
                    raise ValueError(t)
                print("a model may print")
            return [[{"text": t, "label": "PERSON", "start": 0, "end": len(t), "score": 0.9}] for t in texts]

        return predict

    return load


def test_a_late_text_ends_the_process_and_no_other(spark):
    texts = ["Ann One", "hang", "Bob Two", "fail", "Cid Three", "exit", "hang", "Dee Four"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    got = cascade(df, [ml.model_layer(slow_model(), timeout_ms=1500)]).select("id", "findings", F.element_at("layers", 1)["skip_reason"].alias("reason")).collect()
    reasons = {texts[r.id]: r.reason for r in got}
    assert reasons == {"Ann One": "", "Bob Two": "", "Cid Three": "", "Dee Four": "", "hang": "timeout after 1500ms", "fail": "scan failed", "exit": "scan failed"}
    assert {r.id for r in got if r.findings} == {0, 2, 4, 7}


def unloadable():
    def load():
        raise OSError("no such model")

    return load


def test_a_model_that_does_not_load_fails_the_job(spark):
    with pytest.raises(RuntimeError, match="no such model"):
        list(deadline.timed(unloadable(), 100)(iter([["a"]])))
    df = spark.createDataFrame([(1, "a")], "id int, text string")
    with pytest.raises(Exception, match="no such model"):
        cascade(df, [ml.model_layer(unloadable(), timeout_ms=100)]).collect()


def test_children_are_ended_with_the_worker():
    run = deadline.timed(slow_model(), 1000)
    answers = run(iter([["Ann One"], ["Bob Two"]]))
    assert next(answers)[0][1] is None
    answers.close()  # the generator's end is the child's


def test_late_texts_do_not_wait_for_each_other():
    texts = [("hang" if k % 4 == 1 else "exit" if k % 16 == 2 else "fail" if k % 16 == 3 else f"Ann {k}") for k in range(64)]
    begin = time.monotonic()
    got = list(deadline.timed(slow_model(), 1000, forks=8)(iter([texts[:5], [], texts[5:30], texts[30:]])))
    seconds = time.monotonic() - begin
    assert [len(x) for x in got] == [5, 0, 25, 34]
    said = [reason for answers in got for _, reason, _ in answers]
    assert said == [{"hang": "timeout after 1000ms", "exit": "scan failed", "fail": "scan failed"}.get(t) for t in texts]
    assert [a[0][0]["text"] for answers in got for a in answers if a[0]] == [t for t in texts if t.startswith("Ann")]
    assert seconds < 10  # 16 texts hang for a second each
