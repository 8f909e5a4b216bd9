"""Queries of conversations: the prefix trie, and structure repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilwright.llm import repair, trie
from veilwright.llm.ordering import joined_digests, numbered
from veilwright.llm.registry import query
from veilwright.llm.repair import spaced
from veilwright.sources.scratch import written
from veilwright.sources.tables import read_table

#: A rebuilt conversation takes fewer turns than this from the first of its group.
HEADS, GROUP = 9, 5
DAMAGES = 20
EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


_CRC = """remainders AS (
  SELECT list_transform(range(256), lambda n: list_reduce(
    list_concat([n::BIGINT], range(8)), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS tab
)"""


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII string, with ``tab`` in scope."""
    codes = f"list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295)"


#: Every prefix of every rebuilt conversation by name; sums over a subtree go along the paths of its least members.
TRIE_SQL = f"""
WITH {_CRC}, turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, token) - 1 AS pos
  FROM (SELECT conv_id, turn, octet_length(encode(text)) AS weight, md5(length(role) || ':' || role || text) AS token FROM turns)
), ids AS (
  SELECT conv_id, conv_id - ((conv_id % {GROUP} + {GROUP}) % {GROUP}) AS base, {_crc32('conv_id::VARCHAR')} % {HEADS} AS h
  FROM (SELECT DISTINCT conv_id FROM turns), remainders
), taken AS (
  SELECT i.conv_id, o.pos, o.token, o.weight FROM ids i JOIN own o ON o.conv_id = i.base AND o.pos < i.h
), rebuilt AS (
  SELECT * FROM taken UNION ALL
  SELECT conv_id, o.pos - i.h + coalesce(m.n, 0), o.token, o.weight
  FROM own o JOIN ids i USING (conv_id) LEFT JOIN (SELECT conv_id, count(*) AS n FROM taken GROUP BY 1) m USING (conv_id) WHERE o.pos >= i.h
), paths AS (
  SELECT conv_id, pos + 1 AS depth, string_agg(token, '') OVER (PARTITION BY conv_id ORDER BY pos) AS name, weight FROM rebuilt
  UNION ALL SELECT conv_id, 0, '', 0 FROM ids
), nodes AS (
  SELECT name, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(weight) AS weight FROM paths GROUP BY 1, 2
), children AS (
  SELECT left(name, 32 * (depth - 1)::INT) AS name, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1
), below AS (
  SELECT p.name, count(*) FILTER (WHERE c.n IS NULL) AS n_leaves, sum((x.n_convs - 1) * x.weight) AS saved
  FROM nodes x LEFT JOIN children c ON c.name = x.name JOIN paths p ON p.conv_id = x.conv_id AND p.depth <= x.depth GROUP BY 1
), ends AS (
  SELECT name, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS listed
  FROM (SELECT conv_id, arg_max(name, depth) AS name FROM paths GROUP BY 1) GROUP BY 1
)
SELECT x.conv_id, x.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, x.n_convs, coalesce(c.n, 0)::BIGINT AS n_children, b.n_leaves::BIGINT AS n_leaves,
       b.saved::BIGINT AS saved_tokens, sha256(coalesce(e.listed, '')) AS ends_sha256
FROM nodes x JOIN below b ON b.name = x.name LEFT JOIN children c ON c.name = x.name LEFT JOIN ends e ON e.name = x.name
LEFT JOIN nodes p ON x.depth > 0 AND p.name = left(x.name, 32 * (x.depth - 1)::INT)
"""


def rebuilt(conversations):
    """``(conv_id, pos, token, weight)`` of the rebuilt turns, and all ``conv_id``; rows without one are in no conversation.

    Turns with the same number are in the order of checksums of role and text.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    token = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    turns = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", F.unhex(token).alias("token"), F.octet_length(text).cast("long").alias("weight"))
    own = written(numbered(turns, "conv_id", ["turn", "token"], "pos").drop("turn"), "rebuilt-turns")
    first = own.where(F.col("pos") < HEADS - 1).groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("pos", "token", "weight"))).alias("items"))
    ids = own.select("conv_id").distinct().withColumns({"base": F.expr(f"conv_id - pmod(conv_id, {GROUP})"), "h": (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")})
    nothing = F.array().cast(first.schema["items"].dataType)
    heads = written(ids.join(first, "base", "left").select("conv_id", "h", F.slice(F.coalesce("items", nothing), F.lit(1), F.col("h")).alias("head")), "rebuilt-heads")
    taken = heads.select("conv_id", F.posexplode("head").alias("pos", "turn")).select("conv_id", F.col("pos").cast("long"), "turn.token", "turn.weight")
    rest = own.join(heads.select("conv_id", "h", F.size("head").alias("m")), "conv_id").where("pos >= h")
    return taken.unionByName(rest.select("conv_id", (F.col("pos") - F.col("h") + F.col("m")).alias("pos"), "token", "weight")), heads.select("conv_id")


@query("op11_conversation_trie", TRIE_SQL)
def conversation_trie(spark, sf_dir):
    turns, ids = rebuilt(read_table(spark, sf_dir, "conversations"))
    nodes, ends = trie.prefix_trie(turns, ids)
    listed = ends.select(F.hex("node").alias("node"), "conv_id", F.col("conv_id").cast("string").alias("text"))
    hashes = joined_digests(listed, "node", ["conv_id"], "text", ",", "ends_sha256")
    return nodes.withColumn("node", F.hex("node")).join(hashes, "node", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256")
    )


#: A walk over the rows, the cheapest way into each state; then the edits are carried out.
REPAIR_SQL = f"""
WITH RECURSIVE {_CRC}, damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % {DAMAGES} AS kind FROM conversations, remainders)
  WHERE kind <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS row FROM damaged
), faulty AS (
  SELECT *, CASE WHEN ink = '' THEN 'blank' WHEN row > min(row) OVER (PARTITION BY conv_id, role, text) THEN 'duplicate'
                 WHEN right(ink, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM (SELECT *, regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g') AS ink FROM placed)
), inserted(p, r, cost, audit) AS (
  VALUES (0, 0, 0, ''), (0, 2, 5, 'I'), (0, 3, 10, 'II'), (1, 1, 0, ''), (1, 2, 5, 'I'), (1, 3, 10, 'II'), (2, 2, 0, ''), (2, 3, 5, 'I'), (3, 3, 0, ''), (3, 2, 5, 'I')
), leads(r, q, initial) AS (VALUES (0, 1, 's'), (0, 2, 'u'), (1, 2, 'u'), (2, 3, 'a'), (3, 2, 'u')
), steps AS (
  SELECT conv_id, row, r, r AS q, 2 AS cost, 'D' AS edit FROM faulty, (VALUES (0), (1), (2), (3)) v(r)
  UNION ALL SELECT conv_id, row, r, q, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END, 'K' FROM faulty, leads WHERE fault NOT IN ('blank', 'duplicate') AND left(role, 1) = initial
  UNION ALL SELECT conv_id, row, r, q, CASE fault WHEN 'truncated' THEN 6 ELSE 1 END, 'R' FROM faulty, leads WHERE fault NOT IN ('blank', 'duplicate') AND initial <> 's'
), walk AS (
  SELECT conv_id, 0 AS row, 0 AS state, {{'cost': 0, 'audit': ''}} AS best FROM (SELECT DISTINCT conv_id FROM faulty)
  UNION ALL
  SELECT w.conv_id, s.row::INTEGER, s.q, min({{'cost': w.best.cost + i.cost + s.cost, 'audit': w.best.audit || i.audit || s.edit}})
  FROM walk w JOIN inserted i ON i.p = w.state JOIN steps s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.row = w.row + 1 AND s.r = i.r
  GROUP BY w.conv_id, s.row, s.q
), ended AS (
  SELECT w.conv_id, min({{'cost': w.best.cost + i.cost, 'audit': w.best.audit || i.audit}}) AS best
  FROM walk w JOIN (SELECT conv_id, max(row) AS row FROM faulty GROUP BY 1) n ON n.conv_id IS NOT DISTINCT FROM w.conv_id AND n.row = w.row JOIN inserted i ON i.p = w.state AND i.r IN (0, 3)
  GROUP BY w.conv_id
), edits AS (
  SELECT *, count(*) FILTER (WHERE edit <> 'I') OVER so_far AS row, count(*) FILTER (WHERE edit <> 'D') OVER so_far AS out
  FROM (SELECT conv_id, k, substr(best.audit, k::INT, 1) AS edit FROM ended, unnest(range(1, length(best.audit) + 1)) u(k))
  WINDOW so_far AS (PARTITION BY conv_id ORDER BY k ROWS UNBOUNDED PRECEDING)
), lines AS (
  SELECT e.conv_id, k, edit, CASE WHEN edit = 'I' THEN '' ELSE f.text END AS text, f.role,
         max(CASE WHEN out = 1 AND edit = 'K' AND left(f.role, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS led, out
  FROM edits e LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.row = e.row AND e.edit <> 'I' WHERE edit <> 'D'
), repaired AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (out - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY k) AS listed FROM lines GROUP BY 1
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
         count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
         count(*) FILTER (WHERE before IS NOT NULL AND before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT *, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY row) AS before FROM faulty) GROUP BY 1
)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(e.best.cost, 0)::BIGINT AS cost, coalesce(e.best.audit, '') AS audit, sha256(coalesce(listed, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counted n ON n.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM c.conv_id
"""


def damaged(conversations):
    """Rows with one of five faults each, or none, by a checksum of their id and turn."""
    kind = (F.crc32(F.concat(spaced(F.col("conv_id")), F.lit(":"), spaced(F.col("turn"))).cast("binary")) % DAMAGES).cast("int")
    rows = conversations.select("conv_id", "turn", spaced(F.col("role")).alias("role"), spaced(F.col("text")).alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


@query("op12_conversation_repair", REPAIR_SQL)
def conversation_repair(spark, sf_dir):
    conversations = read_table(spark, sf_dir, "conversations")
    audits, edits, lines = repair.repair(damaged(conversations))
    return repair_report(conversations.select("conv_id").distinct(), audits, edits, lines)


def repair_report(ids, audits, edits, lines):
    """A row for each id: faults, cost, audit and the checksum of the repaired lines."""
    initial = F.substring("role", 1, 1)
    # Rows next to each other: the following one is found by its number, so no conversation is gathered.
    here, there = edits.select("conv_id", "row", initial.alias("initial")), edits.select(F.col("conv_id").alias("conv_"), (F.col("row") - 1).alias("row_"), initial.alias("next"))
    pairs = here.join(there, F.col("conv_id").eqNullSafe(F.col("conv_")) & (F.col("row") == F.col("row_")))
    illegal = pairs.where(~F.concat("initial", "next").isin("su", "ua", "au")).groupBy("conv_id").agg(F.count("*").alias("illegal"))
    turns = edits.where("turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.count("*").alias("n")).groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    faults = edits.groupBy("conv_id").agg(*[F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in ("blank", "duplicate", "truncated")])
    hashes = joined_digests(lines.withColumn("line", F.concat("role", F.lit(":"), "text")), "conv_id", ["row", "step"], "line", "\n", "repaired_sha256")
    out = ids
    for part in (turns, faults, illegal, audits, hashes):
        part = part.withColumnRenamed("conv_id", "conv_")
        out = out.join(part, F.col("conv_id").eqNullSafe(F.col("conv_")), "left").drop("conv_")
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(EMPTY)).alias("repaired_sha256"))
