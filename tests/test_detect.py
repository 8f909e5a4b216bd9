import re
from pathlib import Path

from conftest import SMALL
from pyspark.sql import functions as F
from veilwright.operators.detect import _tried, detect, detect_sets, finding_rows
from veilwright.sources import catalog
from veilwright.sources.derived import corpus
from veilwright.sources.patterns import profile

FIXTURES = Path(__file__).parent.parent / "FIXTURES.md"


def fixture_rows():
    """Rule, hit, value, miss, start, end, confidence from the tables of FIXTURES.md."""
    for line in FIXTURES.read_text().splitlines():
        cells = [c.replace("\\n", "\n") for c in re.findall(r"`([^`]*)`", line)]
        numbers = re.search(r"\| (\d+) \| (\d+) \| ([\d.]+) \|", line)
        if line.startswith("| `") and numbers and len(cells) == 4:
            yield (*cells, int(numbers[1]), int(numbers[2]), float(numbers[3]))


def test_catalogue_counts():
    tiers = [r[5] for r in catalog.RULES]
    assert (len(catalog.RULES), len(catalog.GROUPS)) == (85, 37)
    assert [tiers.count(t) for t in (1, 2, 3)] == [24, 33, 28]
    assert (len(profile("compat")), len(profile("extended")), len(profile("simple"))) == (63, 70, 29)


def test_one_hit_and_one_near_miss_per_rule(spark):
    rows = list(fixture_rows())
    assert len(rows) == 66
    texts = spark.createDataFrame(
        [(f"{kind}:{r[0]}", r[i]) for r in rows for kind, i in (("hit", 1), ("miss", 3))], "id string, text string"
    )
    found = {}
    for f in finding_rows(detect(texts, profile("extended")), ["id"]).collect():
        found.setdefault((f.id, f.rule_id), []).append((f.value, f.start, f.end, round(f.confidence, 4)))
    for rule, _, value, _, start, end, confidence in rows:
        assert (value, start, end, confidence) in found.get((f"hit:{rule}", rule), []), rule
        assert (f"miss:{rule}", rule) not in found, rule


def test_gates_change_nothing(spark):
    texts = corpus(spark, SMALL)
    for name in ("extended", "simple_extended"):
        gated = finding_rows(detect(texts, profile(name)), ["id"])
        plain = finding_rows(detect(texts, profile(name), gated=False), ["id"])
        assert gated.count() > 0
        assert gated.exceptAll(plain).count() == 0 and plain.exceptAll(gated).count() == 0


def test_value_is_the_text_at_its_place(spark):
    rows = finding_rows(detect(corpus(spark, SMALL), profile("extended")), ["id", "text"])
    wrong = rows.where(F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")) != F.col("value"))
    assert wrong.count() == 0


def test_offsets_behind_wide_characters_and_in_long_texts(spark):
    filler = "é😀 abc\n" * 6000
    texts = spark.createDataFrame([("a", "😀ü a.b@corp.io"), ("b", filler + "mail a.b@corp.io" + filler)], "id string, text string")
    found = {r.id: (r.start, r.end, r.confidence) for r in finding_rows(detect(texts, profile("compat")), ["id"]).collect()}
    n = len(filler)
    assert found == {"a": (3, 14, 0.5), "b": (n + 5, n + 16, 0.5)}


def test_toggles(spark):
    on = catalog.active_patterns({"email_regex": False, "ipv4": True})
    ids = {p.rule_id for p in on}
    assert "email_regex" not in ids and "ipv4" in ids and "ipv6" not in ids
    assert catalog.active_patterns({}, "simple", [("T", "x")])[-1].label == "T"


def test_filter_on_findings_does_not_copy_the_detection(spark):
    found = detect(corpus(spark, SMALL), profile("compat")).where(F.size("findings") > 0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    documents = plan.count("regexp_extract_all(text#")
    assert plan.count("Filter (size(findings") >= 1 and documents < 200


def test_an_expression_of_several_sets_is_tried_once(spark):
    texts = corpus(spark, SMALL)
    twice = [*profile("simple"), *(p._replace(ord=p.ord + 500, label="AGAIN") for p in profile("simple")[:4])]  # one set, one expression twice
    sets = {"old": profile("simple"), "findings": profile("compat"), "none": [], "twice": twice}
    for gated in (True, False):
        both = detect_sets(texts, sets, gated=gated)
        assert both.columns[:2] == ["id", "text"] and set(both.columns) == {"id", "text", *sets}
        for name, patterns in sets.items():
            got, want = finding_rows(both, ["id"], name), finding_rows(detect(texts, patterns, gated=gated), ["id"])
            assert (want.count() > 0) == bool(patterns)
            assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    plan = detect_sets(texts, {k: sets[k] for k in ("old", "findings")})._jdf.queryExecution().analyzed().toString()
    regexes = {(p.regex, p.edges) for name in ("simple", "compat") for p in profile(name)}
    assert len(_tried((tuple(sets["old"]), tuple(sets["findings"])), "text", True)[0]) == len(regexes) == 72 < 29 + 63
    assert plan.count("AS __digit#") == 1  # the text is prepared once


def test_the_older_set_in_the_pass_of_the_pattern_layer(spark):
    from veilwright.plans.cascade import cascade, entropy_layer, pattern_layer

    texts = corpus(spark, SMALL)
    found = cascade(texts, [pattern_layer(also={"old": profile("simple")}), entropy_layer()])
    plain = cascade(detect(texts, profile("simple"), out="old"), [pattern_layer(), entropy_layer()])
    assert sorted(found.columns) == sorted(plain.columns)
    same = [c for c in plain.columns if c != "layers"]
    assert found.select(*same).exceptAll(plain.select(*same)).count() == 0 and found.count() == plain.count()
