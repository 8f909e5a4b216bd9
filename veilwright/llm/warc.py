"""WARC archives written and read by Spark's text files, with every record boundary verified.

Writing: a record is a header, an HTTP response and two line ends; the latter are the line separator of
the text writer. Of equal payloads only the one with the least page id is stored, the others refer to it.

Reading: the magic that opens a record is the line separator of the text reader, so tasks read any part
of an archive and each piece between two magics is a candidate record. As a payload may hold the magic
too, a candidate is only a record when the chain of lengths from the file's start arrives at it. Each
candidate gives the place of its successor (its header's length and Content-Length). Within windows of
``WINDOW`` bytes chains are followed to where they leave the window; between windows pointers are
doubled from the file's start, so a file of n windows takes log n rounds. Only what is reached stays,
and pieces that were cut at a magic in a payload are put together again.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilwright.llm.common import column
from veilwright.sources.scratch import written

END = "\r\n"
MAGIC = "WARC/1.1" + END
AFTER = 2 * END  # ends a header, and a record
#: Payloads of fewer bytes are never referred to.
LEAST_REVISIT = 100
#: Bytes of an archive whose candidates one task holds.
WINDOW = 4 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:page:"


def _line(name: str, value) -> F.Column:
    """A header line; null where the value is. Line ends in a value are escaped."""
    return F.concat(F.lit(f"{name}: "), F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), F.lit(END))


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url: str = "url", html: str = "html", date: str = "1970-01-01T00:00:00Z", compression: str = "gzip") -> None:
    """A response or revisit record for each row; ``compression`` is of whole files (``none``: files can be read in parts).

    A null payload is empty, a null url is left out. Rows with a null id refer to the least id of their
    payload if there is one; of repeated rows with the least id each is a response. An empty table
    writes no record. Extra columns are not read.
    """
    payload = F.coalesce(column(html), F.lit(""))
    keyed = pages.select(column(id_col).cast("long").alias("id"), column(url).alias("url"), payload.alias("payload"), F.sha2(payload.cast("binary"), 256).alias("digest"), F.octet_length(payload).alias("bytes"))
    first = keyed.where(F.col("bytes") >= LEAST_REVISIT).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # A table by itself, so that a digest with very many pages can be split in the join.
    known = keyed.join(written(first, "warc-firsts"), "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit(f"<{URN}"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("bytes").cast("string"), F.lit(AFTER))
    known = known.withColumns({"again": again, "body": F.concat(http, F.when(~again, F.col("payload")).otherwise(""))})
    lines = (
        _line("WARC-Type", F.when(F.col("again"), "revisit").otherwise("response")), _line("WARC-Record-ID", urn(F.col("id"))), _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")), _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        F.when(F.col("again"), F.concat(_line("WARC-Refers-To", urn(F.col("first"))), _line("WARC-Profile", F.lit(PROFILE)))),
        _line("Content-Type", F.lit("application/http;msgtype=response")), _line("Content-Length", F.octet_length("body").cast("string")),
    )
    record = F.concat(F.lit(MAGIC), *[F.coalesce(x, F.lit("")) for x in lines], F.lit(END), "body")
    known.select(record.alias("value")).write.option("lineSep", AFTER).option("compression", compression).text(folder)


def candidates(pieces: DataFrame) -> DataFrame:
    """``(file, block, seq, at, next)`` of each piece that follows a magic; ``next`` is null where no whole record can be."""
    totals = pieces.groupBy("file", "block").agg(F.sum("length").alias("n"))
    files = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part that was read by itself
    bases = totals.select("file", "block", F.coalesce(F.sum("n").over(files), F.lit(0)).alias("base"), (F.sum("n").over(Window.partitionBy("file")) - len(MAGIC)).alias("size"))
    inside = Window.partitionBy("file", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("length").over(inside), F.lit(0))
    placed = pieces.select("file", "block", "seq", "head", "content", before.alias("before")).join(bases, ["file", "block"])
    at = F.col("base") + F.col("before") - len(MAGIC)
    after = F.col("at") + len(MAGIC) + F.col("head") + len(AFTER) + F.col("content") + len(AFTER)
    return placed.withColumn("at", at).withColumn("next", after).where("at >= 0 OR content IS NOT NULL").select("file", "block", "seq", "at", F.when((F.col("at") >= 0) & (F.col("next") <= F.col("size")), F.col("next")).alias("next"))


def _exits(table: pa.Table) -> pa.Table:
    """Of one window: where the chain of each candidate leaves it, null if it breaks within."""
    follow = dict(zip(table["at"].to_pylist(), table["next"].to_pylist(), strict=True))
    out: dict[int, int | None] = {}
    for at in sorted(follow, reverse=True):
        to = follow[at]
        out[at] = out[to] if to in out else to
    return pa.table({"file": table["file"], "at": table["at"], "exit": pa.array([out[a] for a in table["at"].to_pylist()], pa.int64())})


def _reached(table: pa.Table) -> pa.Table:
    """Of one window: the candidates on the chain from its entry."""
    follow = dict(zip(table["at"].to_pylist(), table["next"].to_pylist(), strict=True))
    on, at = set(), next((e for e in table["entry"].to_pylist() if e is not None), None)
    while at in follow:
        on.add(at)
        at = follow[at]
    return table.drop(["entry", "window"]).append_column("reached", pa.array([a in on and follow[a] is not None for a in table["at"].to_pylist()], pa.bool_()))


def verified(found: DataFrame, window: int = WINDOW) -> DataFrame:
    """Candidates with ``reached``: the chain from the start of the file arrives there and the record is whole."""
    found = written(found.withColumn("window", F.expr(f"at div {int(window)}")), "warc-candidates")
    hops = written(found.select("file", "window", "at", "next").groupBy("file", "window").applyInArrow(_exits, "file string, at long, exit long").where("exit IS NOT NULL"), "warc-hops")
    reach = written(found.where("at = 0").select("file", "at"), "warc-reach")
    n = reach.count()
    while n:
        went = reach.join(hops, ["file", "at"]).select("file", F.col("exit").alias("at"))
        reach = written(reach.unionByName(went).distinct(), "warc-reach")
        before, n = n, reach.count()
        if n == before:
            break
        onward = hops.select("file", F.col("at").alias("exit"), F.col("exit").alias("then"))
        hops = written(hops.join(onward, ["file", "exit"]).select("file", "at", F.col("then").alias("exit")), "warc-hops")
    # The chain enters a window once; the end of the file may lie in its last window too.
    entries = reach.groupBy("file", F.expr(f"at div {int(window)}").alias("window")).agg(F.min("at").alias("entry"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema if f.name != "window") + ", reached boolean"
    return written(found.join(entries, ["file", "window"], "left").groupBy("file", "window").applyInArrow(_reached, schema), "warc-verified")


def sized(df: DataFrame) -> DataFrame:
    """``value`` with the bytes of its header and what that says of its content; null where there is none."""
    value = F.col("value")
    head = F.when(F.contains(value, F.lit(AFTER)), F.substring_index(value, AFTER, 1))
    length = F.regexp_extract(F.concat(F.lit(END), head, F.lit(END)), r"(?i)\r\nContent-Length:[ \t]*([0-9]{1,15})[ \t]*\r\n", 1)
    return df.withColumns({"head": F.octet_length(head).cast("long"), "content": F.nullif(length, F.lit("")).cast("long")})


def pieces_of(spark: SparkSession, folder: str) -> DataFrame:
    """What lies between magics: ``(file, block, seq, value, length, head, content)``, read once and kept.

    ``block`` is where the part begins that was read by itself, ``seq`` orders its pieces, ``length``
    counts bytes with the magic that follows.
    """
    value = F.col("value")
    raw = spark.read.option("lineSep", MAGIC).text(folder).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    raw = raw.withColumns({"seq": F.monotonically_increasing_id(), "length": (F.octet_length(value) + len(MAGIC)).cast("long")})
    return written(sized(raw), "warc-pieces")


def fields(text: F.Column) -> F.Column:
    """Lines ``name: value`` as a map, names in lower case, the first of a repeated name."""
    lines = F.filter(F.split(text, END), lambda x: F.contains(x, F.lit(":")))
    name = lambda x: F.lower(F.trim(F.substring_index(x, ":", 1)))
    names = F.transform(lines, name)
    first = F.filter(lines, lambda x, i: F.array_position(names, name(x)) == i + 1)
    return F.map_from_arrays(F.transform(first, name), F.transform(first, lambda x: F.trim(F.substr(x, F.locate(":", x) + 1))))


def read(spark: SparkSession, folder: str, window: int = WINDOW) -> DataFrame:
    """``(file, headers, http, payload)`` of every record that the chain from its file's start reaches.

    ``headers`` and ``http`` map lower-case names to values; ``http`` is null, and the payload the whole
    block, where the block is no HTTP message. A file that does not begin with a record gives none; nor
    does a record that is cut off, nor what follows it. An empty folder of files gives no rows.
    """
    pieces = pieces_of(spark, folder)
    checked = verified(candidates(pieces), window)
    # Pieces that are no whole record by themselves: those not reached, and the records that hold them.
    files = checked.where("NOT reached").select("file").distinct()
    owner = F.last(F.when(F.col("reached"), F.struct("at", "next")), ignorenulls=True).over(Window.partitionBy("file").orderBy("at"))
    owned = checked.join(files, "file", "left_semi").withColumn("owner", owner)
    owned = owned.select("file", "block", "seq", "reached", F.when(F.col("at") < F.col("owner.next"), F.col("owner.at")).alias("record"))
    split = owned.where("NOT reached AND record IS NOT NULL").select("file", "record").distinct()
    odd = written(owned.where("NOT reached").unionByName(owned.where("reached").join(split, ["file", "record"], "left_semi")).drop("reached"), "warc-odd")
    key = ["file", "block", "seq"]
    alone = pieces.where("content IS NOT NULL").join(odd.select(*key), key, "left_anti").select("file", "value", "head", "content")
    parts = pieces.select(*key, "value").join(odd.where("record IS NOT NULL"), key).groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("block", "seq", "value"))).alias("parts"))
    joined = sized(parts.select("file", F.array_join("parts.value", MAGIC).alias("value")))  # of one record
    records = alone.unionByName(joined)
    block = F.substr(F.col("value").cast("binary"), (F.col("head") + len(AFTER) + 1).cast("int"), F.col("content").cast("int"))
    records = records.select("file", fields(F.substring_index("value", AFTER, 1)).alias("headers"), block.cast("string").alias("block"))
    is_http = F.startswith(F.col("headers")["content-type"], F.lit("application/http"))
    head = F.when(is_http, F.substring_index("block", AFTER, 1))
    payload = F.when(is_http, F.substr(F.col("block").cast("binary"), F.octet_length(head) + len(AFTER) + 1).cast("string")).otherwise(F.col("block"))
    return records.select("file", "headers", fields(head).alias("http"), payload.alias("payload"))
