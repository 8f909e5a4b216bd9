"""Checked queries for evaluation and for model spans.

Truth is what the older patterns find, prediction what the main patterns find, both on the corpus.
Model spans are the capitalised words of the documents, with label, score and place computed from
where they stand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwright.functions.spans import let, match_starts, settled
from veilwright.operators import evaluate as V
from veilwright.operators import ml as M
from veilwright.operators import rulesets
from veilwright.operators.detect import detect_sets
from veilwright.oracle import detection as O
from veilwright.plans.registry import query, with_tables
from veilwright.plans.request_queries import RULE_TABLES, toggles, users
from veilwright.sources.derived import corpus
from veilwright.sources.patterns import Pattern, profile
from veilwright.sources.scratch import new_folder
from veilwright.sources.tables import read_texts

IGNORED = ["IBAN", "IP-ADDRESS"]
DETECTABLE = ["EMAIL", "SSN", "PHONE", "CREDIT-CARD", "JWT"]

_TABLES = {
    "corpus": O.corpus(),
    "truth": f"SELECT DISTINCT id, value, s, e, label FROM ({O.findings(profile('simple'), 'corpus')})",
    "pred": f"SELECT id, value, s, e, label, layer, row_number() OVER (PARTITION BY id ORDER BY s, e DESC, ord) - 1 AS pos FROM ({O.findings(profile('compat'), 'corpus')})",
    "pairs": "SELECT t.id, t.value, t.s, t.e, t.label, p.pos, p.label AS by_label, p.layer AS by_layer FROM truth t JOIN pred p ON t.id = p.id AND (contains(t.value, p.value) OR contains(p.value, t.value) OR (p.s <= t.e AND p.e >= t.s))",
    "credited": f"""SELECT t.id, t.value, t.s, t.e, t.label, c.by_layer, c.by_label FROM truth t LEFT JOIN
        (SELECT id, value, s, e, label, min_by(by_layer, pos) AS by_layer, min_by(by_label, pos) AS by_label FROM pairs GROUP BY 1, 2, 3, 4, 5) c
        USING (id, value, s, e, label) WHERE t.label NOT IN ({', '.join(O.lit(x) for x in IGNORED)})""",
    "wrong": "SELECT p.* FROM pred p ANTI JOIN (SELECT DISTINCT id, pos FROM pairs) x ON x.id = p.id AND x.pos = p.pos",
}


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with truth and findings, from one pass over the corpus."""
    both = detect_sets(corpus(spark, sf), {"old": profile("simple"), "findings": profile("compat")})
    spans = F.transform(
        "old", lambda f: F.struct(f.value.alias("value"), f.start.alias("start"), f.end.alias("end"), f.label.alias("label"))
    )
    return both.select("id", settled(F.array_distinct(spans)).alias("truth"), "findings")


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return V.score(labelled(spark, sf), IGNORED)


def _credited(spark: SparkSession, sf: str) -> DataFrame:
    return V.credit_rows(_scored(spark, sf))


def _wrong(spark: SparkSession, sf: str) -> DataFrame:
    return V.wrong_rows(_scored(spark, sf))


def _spans(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("start", "span_start").withColumnRenamed("end", "span_end")


def _register(name: str, sql: str, run) -> None:
    query(name, with_tables(sql, **_TABLES))(run)


_T = "id, value, s AS span_start, e AS span_end, label"
_register(
    "src_truth",
    f"SELECT {_T} FROM truth",
    lambda s, f: _spans(labelled(s, f).select("id", F.explode("truth").alias("t")).select("id", "t.*")),
)
@query("src_labelled", with_tables("SELECT id::VARCHAR AS id, value, CAST(s AS INTEGER) AS span_start, CAST(e AS INTEGER) AS span_end, label FROM truth", **_TABLES))
def src_labelled(spark: SparkSession, sf: str) -> DataFrame:
    """The truth as labelled JSON files, written and read back; values of digits alone are numbers there."""
    folder = new_folder(spark, "labelled")
    item = F.struct(F.col("id").cast("string").alias("id"), F.lit("text").alias("text"), F.lit("en").alias("locale"), F.lit("x").alias("domain"), F.col("truth").alias("pii"))
    samples = labelled(spark, sf).select(F.regexp_replace(F.to_json(item), '"value":"([1-9][0-9]{0,17})"', '"value":$1').alias("json"), F.pmod(F.xxhash64("id"), F.lit(16)).alias("file"))
    files = samples.groupBy("file").agg(F.concat(F.lit("["), F.array_join(F.collect_list("json"), ","), F.lit("]")).alias("value"))
    files.select("value").write.option("maxRecordsPerFile", 1).text(folder)  # a file is one array
    return _spans(V.read_labelled(spark, folder).select("id", F.explode("truth").alias("t")).select("id", "t.*"))


_register(
    "eval_matches",
    f"SELECT {_T}, CAST(pos AS INTEGER) AS pos FROM pairs",
    lambda s, f: _spans(V.matches(labelled(s, f))),
)
_register(
    "eval_credit", f"SELECT {_T}, by_layer, by_label FROM credited", lambda s, f: _spans(_credited(s, f))
)
_register(
    "eval_caught",
    f"SELECT {_T}, by_layer, by_label FROM credited WHERE by_layer IS NOT NULL",
    lambda s, f: _spans(V.caught(_credited(s, f))),
)
_register(
    "eval_missed", f"SELECT {_T} FROM credited WHERE by_layer IS NULL", lambda s, f: _spans(V.missed(_credited(s, f)))
)
_register(
    "eval_false_pos",
    "SELECT id, value, s AS span_start, e AS span_end, label, layer, CAST(pos AS INTEGER) AS pos FROM wrong",
    lambda s, f: _spans(_wrong(s, f)).withColumnRenamed("ord", "pos"),
)
_register(
    "eval_summary",
    """SELECT c AS caught, m AS missed, w AS false_pos, round(CASE WHEN c + w > 0 THEN c * 100.0 / (c + w) ELSE 0 END, 6) AS precision_pct,
         round(CASE WHEN c + m > 0 THEN c * 100.0 / (c + m) ELSE 0 END, 6) AS recall_pct,
         round(CASE WHEN 2 * c + w + m > 0 THEN CAST(200 * c AS DOUBLE) / (2 * c + w + m) ELSE 0 END, 6) AS f1
       FROM (SELECT (SELECT count(by_layer) FROM credited) AS c, (SELECT count(*) - count(by_layer) FROM credited) AS m, (SELECT count(*) FROM wrong) AS w)""",
    lambda s, f: V.summary(_scored(s, f)),
)
_register(
    "eval_by_layer",
    """SELECT layer, coalesce(c, 0) AS caught, coalesce(w, 0) AS false_pos,
         round(coalesce(c, 0) * 100.0 / (coalesce(c, 0) + coalesce(w, 0)), 6) AS precision_pct
       FROM (SELECT by_layer AS layer, count(*) AS c FROM credited WHERE by_layer IS NOT NULL GROUP BY 1)
       FULL JOIN (SELECT layer, count(*) AS w FROM wrong GROUP BY 1) USING (layer)""",
    lambda s, f: V.by_layer(_scored(s, f)),
)
_register(
    "eval_layer_label",
    "SELECT by_layer AS layer, label, count(*) AS caught FROM credited WHERE by_layer IS NOT NULL GROUP BY 1, 2",
    lambda s, f: V.layer_label(_credited(s, f)),
)
_register(
    "eval_by_label",
    f"""SELECT label, count(*) AS total, count(by_layer) AS caught, count(*) - count(by_layer) AS missed,
         round(count(by_layer) * 100.0 / count(*), 6) AS rate, label IN ({', '.join(O.lit(x) for x in DETECTABLE)}) AS detectable FROM credited GROUP BY label""",
    lambda s, f: V.by_label(_credited(s, f), DETECTABLE),
)
_register(
    "eval_fp_labels",
    "SELECT label, count(*) AS n, min(layer) AS layer FROM wrong GROUP BY 1",
    lambda s, f: V.wrong_labels(_wrong(s, f)),
)
_register(
    "eval_detectable",
    f"""SELECT count(*) FILTER (WHERE d AND by_layer IS NOT NULL) AS detectable_caught, count(*) FILTER (WHERE d) AS detectable_total,
         count(*) FILTER (WHERE NOT d) AS model_only,
         round(count(*) FILTER (WHERE d AND by_layer IS NOT NULL) * 100.0 / count(*) FILTER (WHERE d), 6) AS recall_pct
       FROM (SELECT *, label IN ({', '.join(O.lit(x) for x in DETECTABLE)}) AS d FROM credited)""",
    lambda s, f: V.detectable_recall(_credited(s, f), DETECTABLE),
)
_register(
    "fp_samples",
    "SELECT id, layer, label, CASE WHEN length(value) > 40 THEN substr(value, 1, 40) || '...' ELSE value END AS value FROM (SELECT * FROM wrong ORDER BY id, pos LIMIT 15)",
    lambda s, f: V.wrong_samples(_wrong(s, f)),
)
_register(
    "label_check",
    """SELECT c.id, coalesce(array_to_string(list_sort(list_filter(coalesce(t.l, []), lambda x: NOT list_contains(coalesce(p.l, []), x))), ','), '') AS missing,
         t.l IS NULL AND p.l IS NOT NULL AS unexpected
       FROM corpus c LEFT JOIN (SELECT id, list(DISTINCT label) AS l FROM truth GROUP BY id) t USING (id)
       LEFT JOIN (SELECT id, list(DISTINCT label) AS l FROM pred GROUP BY id) p USING (id)""",
    lambda s, f: V.label_check(
        detect_sets(corpus(s, f), {"a": profile("simple"), "b": profile("compat")}).select(
            "id",
            F.array_distinct(F.transform("a", lambda x: x.label)).alias("expected"),
            F.array_distinct(F.transform("b", lambda x: x.label)).alias("found"),
        )
    ),
)

# --- model spans -------------------------------------------------------------------------------------

NAME = r"[A-Z][a-z]+(?: [a-z]+)?"
_ONE = Pattern(0, "", "", NAME, 1.0)
_LABELS = list(M.MODEL_LABELS)
_SECOND = [*M.LABEL_MAP, "other"]
_ENTITIES = f"""SELECT id, value AS text, s, e, ({O.words(_LABELS)})[CAST((s + id) % {len(_LABELS)} AS INTEGER) + 1] AS label,
    ({O.words(_SECOND)})[CAST((s + id) % {len(_SECOND)} AS INTEGER) + 1] AS label2, round(((s * 37 + id) % 100) / 100.0, 4) AS score
    FROM ({O.matches([_ONE], 'corpus')})"""


def entities(spark: SparkSession, sf: str) -> DataFrame:
    texts = read_texts(spark, sf, "documents", "doc_id", "text")
    found = texts.withColumn("m", F.regexp_extract_all("text", F.lit(NAME), 0))
    labels, second = F.array(*[F.lit(x) for x in _LABELS]), F.array(*[F.lit(x) for x in _SECOND])

    def entity(v, s):
        k = s + F.col("id")
        return F.struct(
            v.alias("text"),
            F.element_at(labels, (k % len(_LABELS) + 1).cast("int")).alias("label"),
            F.element_at(second, (k % len(_SECOND) + 1).cast("int")).alias("label2"),
            s.alias("start"),
            (s + F.length(v)).alias("end"),
            F.round(((s * 37 + F.col("id")) % 100) / 100.0, 4).alias("score"),
        )

    spans = let(match_starts(F.col("text"), F.lit(NAME), F.col("m")), lambda st: F.zip_with("m", F.slice(st, F.lit(1), F.size("m")), entity))
    return found.select("id", F.explode(spans).alias("e"))


_ML = {"corpus": "SELECT doc_id AS id, text FROM documents", "entities": _ENTITIES}
_SUPPRESSED = M.suppressed_labels()
_FIRST = f"""score >= coalesce(CASE label {' '.join(f"WHEN {O.lit(k)} THEN {v}" for k, v in M.LABEL_MIN.items())} END, 0.5)
    AND strlen(text) >= 2 AND label NOT IN ({', '.join(O.lit(x) for x in _SUPPRESSED)})
    AND NOT (label = 'PERSON' AND list_contains({O.words(M.GENERIC_ROLES)}, lower(trim(text))))
    AND NOT list_contains({O.words(M.DESCRIPTIVE)}, lower(text)) AND NOT starts_with(lower(text), 'your ')
    AND NOT regexp_matches(lower(text), ' (name|address|number)$')
    AND NOT (label IN ('MEDICAL_RECORD', 'NATIONAL_ID', 'IBAN') AND NOT regexp_matches(text, '[0-9]'))
    AND NOT (label = 'PASSWORD' AND (strlen(text) < 8 OR list_contains({O.words(M.COMMON_WORDS)}, lower(text))))
    AND label <> 'IP_ADDRESS' AND NOT (label = 'EMAIL' AND NOT contains(text, '@'))"""


@query(
    "ml_spans_filtered",
    with_tables(f"SELECT id, text, label, s AS span_start, e AS span_end, score FROM entities WHERE {_FIRST}", **_ML),
)
def ml_spans_filtered(spark: SparkSession, sf: str) -> DataFrame:
    kept = entities(spark, sf).where(M.keep_first(F.col("e"), _SUPPRESSED))
    return kept.select("id", "e.text", "e.label", F.col("e.start").alias("span_start"), F.col("e.end").alias("span_end"), "e.score")


_VOWELS = "length(regexp_replace(text, '[^aeiouAEIOU]', '', 'g'))"
_LETTERS = r"length(regexp_replace(text, '[^\p{L}]', '', 'g'))"


_SECOND_KEPT = f"""strlen(text) >= 4 AND NOT ({_LETTERS} > 3 AND {_VOWELS} = 0) AND NOT ({_LETTERS} > 5 AND {_VOWELS} / {_LETTERS} < 0.1)
    AND NOT contains(text, 'REDACTED')
    AND NOT (label2 IN ('SECRET', 'PRIVATE_ADDRESS') AND strlen(text) < 8) AND NOT (label2 = 'PRIVATE_DATE' AND strlen(text) < 6)
    AND NOT (label2 = 'ACCOUNT_NUMBER' AND strlen(text) < 5)"""


@query(
    "ml2_spans_filtered",
    with_tables(
        f"""SELECT id, text, coalesce(CASE label2 {' '.join(f"WHEN {O.lit(k)} THEN {O.lit(v)}" for k, v in M.LABEL_MAP.items())} END, label2) AS label,
              s AS span_start, e AS span_end FROM entities
            WHERE {_SECOND_KEPT}""",
        **_ML,
    ),
)
def ml2_spans_filtered(spark: SparkSession, sf: str) -> DataFrame:
    rows = entities(spark, sf).select(
        "id", F.struct("e.text", F.col("e.label2").alias("label"), "e.start", "e.end", "e.score").alias("e")
    )
    return rows.where(M.keep_second(F.col("e"))).select(
        "id", "e.text", M.second_label(F.col("e.label")).alias("label"),
        F.col("e.start").alias("span_start"), F.col("e.end").alias("span_end"),
    )


@query(
    "ml_label_state",
    with_tables(
        f"""SELECT c_custkey AS user_id, l.label, coalesce(t.enabled, l.d) AS enabled FROM customer
            CROSS JOIN (VALUES {', '.join(f"({O.lit(r)}, {O.lit(x)}, {str(r not in ('ip_gliner', 'gliner_national_id_dup')).lower()})" for r, x in M.LABEL_RULES.items())}) l(rule_id, label, d)
            LEFT JOIN toggles t ON t.user_id = c_custkey AND t.rule_id = l.rule_id""",
        **RULE_TABLES,
    ),
)
def ml_label_state(spark: SparkSession, sf: str) -> DataFrame:
    maps = users(spark, sf).join(rulesets.toggle_maps(toggles(spark, sf)), "user_id", "left")
    return M.label_states(maps)
