"""Queries of the quality rules and of decontamination."""

from __future__ import annotations

from veilwright.llm import decontaminate, quality, secrets
from veilwright.llm.registry import WORDS, documents, query
from veilwright.sources.tables import read_table

QUALITY_SQL = r"""
WITH parts AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS eight FROM parts, unnest(range(1, len(w) - 6)) u(i)
), often AS (
  SELECT doc_id, eight FROM windows GROUP BY ALL HAVING count(*) > 1
), repeats AS (
  SELECT doc_id, count(DISTINCT p) AS n
  FROM windows JOIN often USING (doc_id, eight), unnest(range(i, i + 8)) u(p) GROUP BY doc_id
), measured AS (
  SELECT doc_id, t, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM parts LEFT JOIN repeats USING (doc_id)
), based AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (
         10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 25 * n_words
         OR 2 * n_dup_lines > len(list_filter(string_split(t, chr(10)), lambda x: trim(x, ' ') <> ''))
         OR 2 * length(regexp_replace(t, '[^\p{L}\p{M}]+', '', 'g')) < word_chars
         OR 2 * length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) > word_chars
         OR 2 * len(regexp_extract_all(t, '(?m)(?:\.\.\.|…)[\x20\t\r]*$')) > len(string_split(t, chr(10)))
       ) AS kept
FROM based
"""

DECONTAMINATE_SQL = rf"""
WITH docs AS (SELECT doc_id, {WORDS} AS w FROM documents),
bench AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, w, least(13, len(w)) AS l
  FROM (SELECT item_id, {WORDS} AS w FROM benchmark) WHERE len(w) > 0
), wanted AS (
  SELECT DISTINCT item, l, array_to_string(w[i:i+l-1], ' ') AS words FROM bench, unnest(range(1, len(w) - l + 2)) u(i)
), places AS (
  SELECT doc_id, i, l, array_to_string(w[i:i+l-1], ' ') AS words
  FROM docs, (SELECT DISTINCT l FROM wanted), unnest(range(1, len(w) - l + 2)) u(i)
), found AS (
  SELECT doc_id, i, l, item FROM places JOIN wanted USING (l, words)
), hits AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM found, unnest(range(i, i + l)) u(p) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n, 0) > 0 AND 20 * coalesce(n, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query("op3_quality_rules", QUALITY_SQL)
def quality_rules(spark, sf_dir):
    """Which rule comes first depends on timings, so its name is left out here."""
    return quality.measure(documents(spark, sf_dir).select("doc_id", "text"), ["doc_id"]).drop("rejected_by")


@query("op8_benchmark_decontamination", DECONTAMINATE_SQL)
def benchmark_decontamination(spark, sf_dir):
    return decontaminate.annotate(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"), ["doc_id"])


@query("op9_secret_scans")
def secret_scans(spark, sf_dir):
    return secrets.find(documents(spark, sf_dir), ["doc_id"])
