"""Query of the archives."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilwright.llm import warc
from veilwright.llm.registry import query
from veilwright.sources.scratch import new_folder
from veilwright.sources.tables import read_table

WARC_SQL = f"""
WITH payloads AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), firsts AS (
  SELECT *, CASE WHEN payload_bytes >= {warc.LEAST_REVISIT} THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM payloads
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM firsts
"""


def page_of(urn):
    """The page id within a record id; null where there is none."""
    return F.nullif(F.regexp_extract(urn, f"^<{warc.URN}(-?[0-9]+)>$", 1), F.lit("")).cast("long")


def page_records(records):
    """The contract's columns of the records read."""
    again = F.col("headers")["warc-type"] == "revisit"
    digest = F.substring_index(F.col("headers")["warc-payload-digest"], ":", -1)
    return records.select(
        page_of(F.col("headers")["warc-record-id"]).alias("page_id"),
        F.when(again, F.col("http")["content-length"].cast("long")).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(again, digest).otherwise(F.sha2(F.col("payload").cast("binary"), 256)).alias("payload_digest"),
        F.col("headers")["warc-type"].alias("record_type"), page_of(F.col("headers")["warc-refers-to"]).alias("refers_to"),
    )


@query("op13_warc", WARC_SQL)
def warc_records(spark, sf_dir):
    folder = new_folder(spark, "warc")
    warc.write(read_table(spark, sf_dir, "pages"), folder)
    return page_records(warc.read(spark, folder))
