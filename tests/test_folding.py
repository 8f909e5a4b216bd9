"""Folding beside and inside values: the long s, the Kelvin sign, an i with a dot above or without one."""

import random

import pytest
from oracle import cell
from veilwright.operators.detect import detect, finding_rows
from veilwright.oracle import detection as O
from veilwright.sources.patterns import profile
from veilwright.sources.planted import RULE_TEXTS

SIGNS = "İıſK̇é "


def texts(n, seed):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        sample = RULE_TEXTS[k % len(RULE_TEXTS)][1].replace("¶", "\n")
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(sample))
            sign = rng.choice(SIGNS)
            sample = sample[:at] + sign + sample[at + rng.randint(0, 1) :]
        if rng.random() < 0.3:
            sample = sample.replace("s", "ſ").replace("k", "K") if rng.random() < 0.5 else sample.upper().replace("I", "İ")
        out.append(f"{rng.choice(['', 'x ', 'İ', 'K'])}{sample}{rng.choice(['', ' y', 'İ', 'ſ', 'K'])}")
    return list(enumerate(out))


@pytest.mark.parametrize("name", ["extended", "simple_extended"])
def test_same_findings_as_sql(spark, name):
    import duckdb

    rows = texts(900, 7)
    df = spark.createDataFrame(rows, "id long, text string").repartition(8)
    plain = finding_rows(detect(df, profile(name), gated=False), ["id"]).select("id", "label", "start", "end", "value")
    gated = finding_rows(detect(df, profile(name)), ["id"]).select("id", "label", "start", "end", "value")
    con = duckdb.connect()
    con.execute("CREATE TABLE corpus (id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO corpus VALUES (?, ?)", rows)
    sql = con.execute(f"SELECT id, label, s, e, value FROM ({O.findings(profile(name), 'corpus')})").fetchall()
    want = sorted(tuple(map(cell, r)) for r in sql)
    for got in (plain, gated):
        ours = sorted(tuple(r) for r in got.collect())
        assert len(ours) > 200
        assert [x for x in ours if x not in set(want)][:5] == [] and [x for x in want if x not in set(ours)][:5] == []
