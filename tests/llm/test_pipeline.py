"""Every stage of the corpus pipeline on what the stage before kept, against SQL or plain forms."""

import brute
import corpus_pipeline
import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer
from veilwright.llm import secrets, tokens
from veilwright.llm.filter_queries import DECONTAMINATE_SQL, QUALITY_SQL
from veilwright.sources.scratch import written

SMALL = "/root/testdata/sf0.01"  # the smallest tables hold no secret
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """Rows before each stage and after the last."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SMALL), f"test-{name}"))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def sql(docs, statement):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(texts(docs).items()))
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{SMALL}/benchmark.parquet'")
    cursor = con.execute(statement)
    names = [d[0] for d in cursor.description]
    return [dict(zip(names, r, strict=True)) for r in cursor.fetchall()]


def test_all_but_the_last_keep_the_columns(stages):
    assert all(sorted(df.columns) == sorted(COLUMNS) for df in stages[:-1])
    assert [df.count() for df in stages[:-2]] == sorted((df.count() for df in stages[:-2]), reverse=True)


def test_quality_rules(stages):
    assert set(texts(stages[1])) == {r["doc_id"] for r in sql(stages[0], QUALITY_SQL) if r["kept"]}


def test_near_duplicates(stages):
    assert set(texts(stages[2])) == set(brute.near_classes(sorted(texts(stages[1]).items())).values())


def test_decontamination(stages):
    assert set(texts(stages[3])) == {r["doc_id"] for r in sql(stages[2], DECONTAMINATE_SQL) if not r["contaminated"]}


def test_secrets_are_masked(stages):
    before, after = stages[3].collect(), {r.doc_id: r for r in stages[4].collect()}
    assert len(before) == len(after)
    masked = 0
    for r in before:
        base = [(a, b, k) for a, k, b in brute.secret_base(r.text or "")]
        spans = base + brute.secret_links(r.text or "", base)
        if not spans:
            assert after[r.doc_id] == r
            continue
        masked += 1
        assert not any(r.text[a:b] in after[r.doc_id].text for a, b, _ in spans)
        assert after[r.doc_id].text == secrets.redact(r.text, spans) and after[r.doc_id].n_chars == len(after[r.doc_id].text)
        assert (after[r.doc_id].lang, after[r.doc_id].source) == (r.lang, r.source)
    assert masked > 0


def test_packing(stages):
    tokenizer = Tokenizer.from_file(tokens.vocabulary_path())
    by_doc, filled = {}, {}
    for r in stages[5].collect():
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
        filled[r.sequence_id] = filled.get(r.sequence_id, 0) + r.length
    for i, text in texts(stages[4]).items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert sorted(by_doc.pop(i)) == [(k, a, len(ids[a : a + 4096]), tokens.crc(ids[a : a + 4096].tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
    assert by_doc == {}
    assert max(filled.values()) <= 4096 and len(filled) <= -(-sum(filled.values()) // 4096) + 1


def test_run_applies_all_stages(spark, stages):
    ours, theirs = corpus_pipeline.run(spark, SMALL), stages[5]
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, ours.select(*key).collect())) == sorted(map(tuple, theirs.select(*key).collect()))
