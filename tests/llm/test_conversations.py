"""Trie and repair of conversations against plain forms: blocks, batches and parts cut anywhere."""

import hashlib
import random

import brute
import pytest
from conftest import SMALL
from pyspark.sql import functions as F
from veilwright.llm import conversation_queries, ordering, repair, trie
from veilwright.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows_of(df):
    return [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]


def trie_rows(rows):
    nodes = brute.trie_nodes(brute.rebuilt(rows), lambda turn: len(turn[1].encode()))
    return sorted(((*n[:7], sha(",".join(map(str, n[7])))) for n in nodes), key=repr)


def repair_rows(rows):
    by = {c: [] for c, *_ in rows}
    for c, *row in brute.damaged(rows):
        by[c].append(tuple(row))
    out = []
    for c, own in by.items():
        faulty = brute.with_faults(own)
        turns = [t for t, _, _ in own if t is not None]
        counts = [sum(f == kind for *_, f in faulty) for kind in ("blank", "duplicate", "truncated")]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(faulty, faulty[1:], strict=False))
        cost, audit, lines = brute.cheapest_edits(faulty)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((c, gaps, *counts, illegal, cost, audit, sha("\n".join(f"{r}:{x}" for r, x in lines))))
    return sorted(out, key=repr)


def ordered(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize(("name", "plain"), [("op11_conversation_trie", trie_rows), ("op12_conversation_repair", repair_rows)])
def test_small_tables(spark, name, plain):
    assert ordered(QUERIES[name](spark, SMALL)) == plain(rows_of(spark.read.parquet(f"{SMALL}/conversations.parquet")))


def awkward(seed):
    """Conversations that share beginnings, repeat, end early, go on for long, and have nulls, ties and other roles."""
    pick = random.Random(seed)
    out = []
    for c in range(60):
        n = pick.choice([1, 2, 3, 5, 8, 30])
        for t in range(n):
            role = pick.choice(["user", "assistant"]) if pick.random() < 0.3 else ["user", "assistant"][t % 2]
            role = pick.choice([None, "", "system", "tool", "unknown"]) if pick.random() < 0.1 else role
            text = pick.choice([None, "", " \n", "a.", "b", "déjà vu!"]) if pick.random() < 0.4 else f"turn {t % 7}."
            turn = None if pick.random() < 0.05 else t // 2 if pick.random() < 0.1 else t
            out.append((c - 3, turn, role, text))
    out += [(1000 + k, t, "user" if t % 2 == 0 else "assistant", f"same {t}.") for k in range(40) for t in range(6)]
    out += [(None, 1, "user", "no id."), (None, 2, "assistant", "none")]
    return out + out[:20]


@pytest.fixture
def tight(spark, monkeypatch):
    """Small blocks, batches and chunks, many parts."""
    monkeypatch.setattr(trie, "BLOCK", 3)
    monkeypatch.setattr(repair, "BLOCK", 4)
    monkeypatch.setattr(repair, "FAN", 2)
    monkeypatch.setattr(ordering, "HELD_BYTES", 40)
    monkeypatch.setattr(ordering, "CHUNK_BYTES", 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_of_awkward_conversations(spark, tight, tmp_path, seed):
    rows = awkward(seed)
    spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("pos", "node", "depth", "start", "token", "base", "h")}).repartition(4).write.parquet(str(tmp_path / "conversations.parquet"))
    assert ordered(QUERIES["op11_conversation_trie"](spark, str(tmp_path))) == trie_rows(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_repair_of_awkward_conversations(spark, tight, tmp_path, seed):
    rows = awkward(seed)
    spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("row", "code", "fault", "block", "sum", "kind", "copy", "edit")}).repartition(4).write.parquet(str(tmp_path / "conversations.parquet"))
    assert ordered(QUERIES["op12_conversation_repair"](spark, str(tmp_path))) == repair_rows(rows)


def test_long_conversations(spark, tmp_path):
    """Thousands of turns in one conversation, shared by another up to the last."""
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t}." if t % 11 else "cut") for c in (0, 1) for t in range(3000)]
    rows[-1] = (1, 2999, "assistant", "another end.")
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    assert ordered(QUERIES["op11_conversation_trie"](spark, str(tmp_path))) == trie_rows(rows)
    assert ordered(QUERIES["op12_conversation_repair"](spark, str(tmp_path))) == repair_rows(rows)


def test_empty_tables(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    turns, ids = conversation_queries.rebuilt(nothing)
    assert [x.count() for x in trie.prefix_trie(turns, ids)] == [0, 0]
    assert [x.count() for x in repair.repair(nothing)] == [0, 0, 0]


def test_one_split_of_a_span_is_enough():
    """The cells over halves give what the whole chart over all splits gives, and what a walk gives."""
    pick = random.Random(7)
    text = {"d": ("user", "", "blank"), "o": ("tool", "x.", None), "O": ("tool", "x", "truncated")}
    for i in "sua":
        role = {"s": "system", "u": "user", "a": "assistant"}[i]
        text |= {i: (role, "x.", None), i.upper(): (role, "x", "truncated")}
    for n in [0, 1, 1, 2, 2, 3, 3, *[pick.randint(1, 9) for _ in range(150)]]:
        codes = "".join(pick.choice("dsuaoSUAOuaua") for _ in range(n))
        got = repair.cheapest(repair.span_cell(codes)) if codes else repair.cheapest(repair.NOTHING)
        assert got == brute.chart(codes) == brute.cheapest_edits([text[c] for c in codes])[:2]


def test_numbers_and_digests_of_groups(spark, tight):
    pick = random.Random(3)
    rows = [(pick.choice([None, 1, 1, 1, 1, 2, 3]), pick.randint(0, 9) if i % 50 else None, pick.choice(["", "é", "long piece " * 9, None])) for i in range(700)]
    df = spark.createDataFrame(rows, "g long, k long, piece string").repartition(6)
    got = ordering.numbered(df, "g", ["k", "piece"], "row").collect()
    for g in {r.g for r in got}:
        own = sorted((r for r in got if r.g == g), key=lambda r: r.row)
        key = [(r.k is not None, r.k or 0, r.piece is not None, r.piece or "") for r in own]
        assert [r.row for r in own] == list(range(len(own))) and key == sorted(key)
        assert len(own) == sum(g == x[0] for x in rows)
    digests = {r.g: r.sha256 for r in ordering.joined_digests(df, "g", ["k", "piece"], "piece", "\n").collect()}
    for g in {r.g for r in got}:
        own = sorted((r for r in got if r.g == g), key=lambda r: r.row)
        assert digests[g] == sha("\n".join(r.piece or "" for r in own))
    assert ordering.joined_digests(df.limit(0), "g", ["k"], "piece", ",").collect() == []
