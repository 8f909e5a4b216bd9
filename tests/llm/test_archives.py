"""Archives written and read back: magic in payloads, cut files, parts and windows of any size."""

import hashlib

import pytest
from pyspark.sql import functions as F
from veilwright.llm import warc
from veilwright.llm.archive_queries import page_records
from veilwright.sources.scratch import new_folder

RECORD = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
PAGES = [
    (1, "http://a/é x", RECORD * 30), (2, None, None), (3, "u\r\nX: 1", ""), (4, "x", "WARC/1.1\r\n"), (5, "y", "a" * 99), (6, "z", "a" * 99), (7, "q", "b" * 100), (8, "q", "b" * 100),
    (None, "q", "b" * 100), (8, "q", "b" * 100), (9, "k", "é" * 50 + "\r\n\r\n" + RECORD + "WARC/1.1\r\n"), (10, "k", "WARC/1.1"), (11, "big", "x\r\n\r\n" * 50_000), (12, "m", "WARC/1.1\r\n" * 2000), (-3, "neg", RECORD * 30),
]


def pages(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("own") for c in ("file", "value", "id", "bytes", "digest", "first", "again", "body")})


def plain(rows):
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        ids = [p for p, _, h in rows if h == html and p is not None]
        first = min(ids, default=None) if len(data) >= 100 else None
        again = first is not None and page != first
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("compression", "window", "part"), [("gzip", warc.WINDOW, "128m"), ("none", 300, "1k"), ("none", 1000, "7k"), ("gzip", 5000, "1k"), ("none", 1 << 30, "33")])
def test_round_trip(spark, compression, window, part):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    folder = new_folder(spark, "warc-test")
    warc.write(pages(spark).repartition(2), folder, compression=compression)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", part if part != "33" else "9000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = warc.read(spark, folder, window)
        assert sorted(map(tuple, page_records(got).collect()), key=repr) == plain(PAGES)
        urls = {r.id: r.url for r in got.select(F.col("headers")["warc-record-id"].alias("id"), F.col("headers")["warc-target-uri"].alias("url")).collect()}
        assert urls["<urn:page:1>"] == "http://a/é x" and urls["<urn:page:3>"] == "u%0D%0AX: 1" and urls["<urn:page:2>"] is None
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_empty_table(spark):
    folder = new_folder(spark, "warc-test")
    warc.write(pages(spark, []), folder)
    assert warc.read(spark, folder).collect() == []


def test_only_what_the_chain_reaches(spark, tmp_path):
    """A record cut off at the end, a broken length, a file that starts otherwise; other blocks than HTTP."""
    other = "WARC/1.1\r\nWARC-Type: metadata\r\ncontent-length:4\r\nX-Twice: 1\r\nX-Twice: 2\r\n\r\na: b\r\n\r\n"
    (tmp_path / "cut.warc").write_bytes((other + RECORD + RECORD[:-9]).encode())
    (tmp_path / "broken.warc").write_bytes((other + RECORD.replace(": 5", ": 6") + RECORD).encode())
    (tmp_path / "late.warc").write_bytes(("junk" + RECORD).encode())
    (tmp_path / "no_length.warc").write_bytes((RECORD + RECORD.replace("Length", "Width") + RECORD).encode())
    (tmp_path / "empty.warc").write_bytes(b"")
    got = sorted((r.file.rsplit("/", 1)[1], r.headers["warc-type"], r.payload) for r in warc.read(spark, str(tmp_path)).collect())
    assert got == [("broken.warc", "metadata", "a: b"), ("broken.warc", "response", "hello\r"), ("cut.warc", "metadata", "a: b"), ("cut.warc", "response", "hello"), ("no_length.warc", "response", "hello")]
    first = [r.headers for r in warc.read(spark, str(tmp_path)).collect() if r.headers["warc-type"] == "metadata"]
    assert all(h["x-twice"] == "1" and h["content-length"] == "4" for h in first)
