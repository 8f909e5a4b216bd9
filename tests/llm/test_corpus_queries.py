"""The corpus queries against SQL where there is some, else against plain forms, on the smallest tables."""

import hashlib
import zlib

import brute
import numpy as np
import pytest
from conftest import SMALL
from oracle import compare, connect
from tokenizers import Tokenizer
from veilwright.llm import attribution, secrets, tokens
from veilwright.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.fixture(scope="module")
def texts(spark):
    return sorted(tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())


@pytest.fixture(scope="module")
def encoded(texts):
    tokenizer = Tokenizer.from_file(tokens.vocabulary_path())
    return {i: tokenizer.encode(t or "", add_special_tokens=False) for i, t in texts}


def test_there_is_a_query_for_each_operator():
    assert [sum(n.startswith(f"op{k}_") for n in QUERIES) for k in range(1, 14)] == [1] * 13


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, con, name):
    difference, _, _ = compare(QUERIES[name](spark, SMALL), con, ORACLES[name])
    assert difference == ""


def test_language_of_held_out_documents(spark):
    got = QUERIES["op2_language_id"](spark, SMALL).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert len(got) == len(lang)
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in lang if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_wavelet_shards_round_trip(spark, texts, encoded):
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op4_token_id_output"](spark, SMALL).collect()}
    at, want = 0, {}
    for i, _ in texts:
        ids = [*encoded[i].ids, 1]
        want[i] = (at, len(ids), crc(ids))
        at += len(ids)
    assert got == want


def test_token_counts_of_sections(spark, texts, encoded):
    got = {r.doc_id: r for r in QUERIES["op5_token_counts"](spark, SMALL).collect()}
    for i, text in texts:
        edges = attribution.sentence_edges(text or "")
        counts, crossing = [0] * len(edges), 0
        for start, end in encoded[i].offsets:
            shares = [min(end, high) - max(start, low) for low, high in zip([0, *edges], edges, strict=False)]
            counts[int(np.argmax(shares))] += 1
            crossing += sum(s > 0 for s in shares) > 1
        assert (got[i].n_tokens, got[i].n_crossing, got[i].section_ends, got[i].section_tokens) == (len(encoded[i].ids), crossing, edges, counts)


def test_packing(spark, texts, encoded):
    rows = QUERIES["op6_best_fit_packing"](spark, SMALL).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, _ in texts:
        ids = [*encoded[i].ids, 1]
        assert sorted(by_doc[i]) == [(k, a, len(ids[a : a + 4096]), crc(ids[a : a + 4096])) for k, a in enumerate(range(0, len(ids), 4096))]
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r.length for r in rows)
    assert len(by_sequence) <= -(-total // 4096) + 1


def test_near_duplicates(spark, texts):
    got = {r.doc_id: r.class_id for r in QUERIES["op7_minhash_near_dedup"](spark, SMALL).collect()}
    assert got == brute.near_classes(texts)


def test_secrets(spark, texts):
    got = {r.doc_id: r for r in QUERIES["op9_secret_scans"](spark, SMALL).collect()}
    assert len(got) == len(texts)
    for i, text in texts:
        base = brute.secret_base(text or "")
        r = got[i]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == kind for _, k, _ in base) for kind in ("assign", "access", "hex")]
        rank = {"assign": 0, "access": 1, "hex": 2}
        listed = ",".join(f"{k}:{a}:{b}" for a, k, b in sorted(base, key=lambda s: (s[0], rank[s[1]])))
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert not listed or set(listed.split(",")) <= set(r.spans.split(","))
        weak = brute.secret_links(text or "", [(a, b, k) for a, k, b in base])
        assert set(r.spans.split(",")) - {""} == {f"{k}:{a}:{b}" for a, b, k in weak} | set(listed.split(",")) - {""}
    assert secrets.KINDS[:3] == ("assign", "access", "hex")
