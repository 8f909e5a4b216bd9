"""Query of the license scans."""

from __future__ import annotations

from veilwright.llm import licensing
from veilwright.llm.licences import RESERVED, signatures
from veilwright.llm.registry import WORDS, documents, query

RULES_SQL = ", ".join(f"({r.number}, {r.priority}, '{r.label}', '{r.regex}')" for r in signatures())
PHRASES_SQL = ", ".join(f"('{label}', '{words}', {len(words.split())})" for words, label in licensing.PHRASES)

LICENSE_SQL = rf"""
WITH rules(number, priority, label, regex) AS (VALUES {RULES_SQL}), phrases(label, words, n_words) AS (VALUES {PHRASES_SQL}),
texts AS (SELECT doc_id, {WORDS} AS w FROM documents),
plain AS (SELECT doc_id, len(w)::BIGINT AS n, '  ' || array_to_string(w, '  ') || '  ' AS t FROM texts),
-- a phrase at each place where its words stand in a row
places AS (
  SELECT doc_id, label, i - 1 AS place FROM texts, phrases, unnest(range(1, len(w) + 1)) u(i)
  WHERE array_to_string(w[i:i+n_words-1], ' ') = words
), base AS (
  SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY doc_id
), tried AS (
  SELECT doc_id, number, priority, label, string_split_regex(t, regex) AS gaps, regexp_extract_all(t, regex) AS hits
  FROM plain, rules WHERE regexp_matches(t, regex)
), matched AS (
  SELECT doc_id, number, priority, label, len(hits[k]) AS size,
         list_sum(list_transform(gaps[1:k], lambda x: len(x))) + list_sum(list_transform(hits[1:k], lambda x: len(x))) AS stop
  FROM tried, unnest(range(1, len(hits) + 1)) u(k)
), spans AS (SELECT *, stop - size AS start FROM matched),
left_over AS (
  SELECT * FROM spans a WHERE NOT EXISTS (
    SELECT 1 FROM spans b WHERE b.doc_id = a.doc_id AND b.start <= a.start AND b.stop >= a.stop AND b.priority <= a.priority
      AND (b.start < a.start OR b.stop > a.stop OR b.priority < a.priority OR b.number < a.number))
), own AS (
  SELECT doc_id, list(DISTINCT label) FILTER (WHERE label <> '{RESERVED}') AS labels, min(priority) FILTER (WHERE label <> '{RESERVED}') AS best,
         count(*) FILTER (WHERE label = '{RESERVED}') AS reserved
  FROM left_over GROUP BY doc_id
), joined AS (
  SELECT *, list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(own.labels, [])))) AS listed, coalesce(base.labels, []) AS of_base
  FROM plain LEFT JOIN base USING (doc_id) LEFT JOIN own USING (doc_id)
)
SELECT doc_id, n AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       array_to_string(list_sort(of_base), ',') AS base_labels,
       CASE WHEN len(listed) = 0 AND reserved > 0 THEN '{RESERVED}' ELSE array_to_string(listed, ',') END AS labels,
       CASE WHEN best = 1 THEN 1.0 WHEN best = 2 THEN 0.75 WHEN best = 3 OR n_base > 0 OR reserved > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
FROM joined
"""


@query("op10_license_scans", LICENSE_SQL)
def license_scans(spark, sf_dir):
    return licensing.scan(documents(spark, sf_dir), ["doc_id"])
