"""Query of the shards."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilwright.llm import sharding
from veilwright.llm.registry import documents, query

SHARDS = 24

#: CRC-32 by its table of 256 remainders; ids are different in ``documents``.
SHARD_SQL = f"""
WITH remainders AS (
  SELECT list_transform(range(256), lambda n: list_reduce(
    list_concat([n::BIGINT], range(8)), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS tab
), sized AS (
  SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 8 AS size,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes
  FROM documents
), summed AS (
  SELECT doc_id, size,
         xor(list_reduce(list_concat([4294967295::BIGINT], bytes), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM sized, remainders
), placed AS (
  SELECT *, row_number() OVER (ORDER BY doc_id) AS row_at, sum(size) OVER () AS all_bytes,
         coalesce(sum(size) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_byte
  FROM summed
), cut AS (
  SELECT *, least({SHARDS - 1}, ((2 * first_byte + size) * {SHARDS}) // (2 * all_bytes))::INT AS shard FROM placed
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, (row_at - min(row_at) OVER (PARTITION BY shard))::BIGINT AS slot,
       NULL::INT AS grown_shard
FROM cut
"""


@query("op1_sharding", SHARD_SQL)
def shards(spark, sf_dir):
    placed = sharding.shard(documents(spark, sf_dir), SHARDS, ["doc_id"])
    return placed.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})
