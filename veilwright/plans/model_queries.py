"""Checked queries over the path of a model layer, with a stand-in for the model.

The stand-in marks capitalised words, with label and score by their place, and fails on every text
whose length leaves a remainder of 5 by 13.
"""

from __future__ import annotations

import re
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwright.functions.spans import settled
from veilwright.operators import evaluate as V
from veilwright.operators import ml as M
from veilwright.operators.detect import finding_rows
from veilwright.oracle import detection as O
from veilwright.plans.cascade import Settings, cascade, entropy_layer, layer_report, pattern_layer
from veilwright.plans.eval_queries import _FIRST, _LABELS, _ONE, _SECOND, _SECOND_KEPT, IGNORED, NAME
from veilwright.plans.eval_queries import _TABLES as TRUTH_TABLES
from veilwright.plans.registry import query, with_tables
from veilwright.sources.catalog import everything_on
from veilwright.sources.derived import corpus
from veilwright.sources.patterns import profile
from veilwright.sources.tables import read_texts

_FAILS = "length(text) % 13 = 5"


def stand_in():
    """Loader of the stand-in."""
    find = re.compile(NAME)

    def spans(text: str) -> list[dict]:
        if len(text) % 13 == 5:
            raise ValueError("a text of an unlucky length")
        return [
            {"text": m[0], "label": _LABELS[m.start() % len(_LABELS)], "start": m.start(), "end": m.end(), "score": m.start() * 37 % 100 / 100}
            for m in find.finditer(text)
        ]

    return lambda texts: [spans(t) for t in texts]


_TABLES = {
    "corpus": "SELECT doc_id AS id, text FROM documents",
    "entities": f"""SELECT id, value AS text, s, e, ({O.words(_LABELS)})[CAST(s % {len(_LABELS)} AS INTEGER) + 1] AS label, s * 37 % 100 / 100.0 AS score
        FROM ({O.matches([_ONE], f"(SELECT * FROM corpus WHERE NOT {_FAILS})")})""",
}


def scanned(spark: SparkSession, sf: str) -> DataFrame:
    texts = read_texts(spark, sf, "documents", "doc_id", "text")
    return cascade(texts, [M.model_layer(stand_in)])


@query(
    "detect_ml",
    with_tables(f"SELECT id, label, s AS start, e AS \"end\", text AS value, round(score, 4) AS confidence, 'gliner' AS layer FROM entities WHERE {_FIRST}", **_TABLES),
)
def detect_ml(spark: SparkSession, sf: str) -> DataFrame:
    """Texts the model fails on have no findings; their neighbours in the batch keep theirs."""
    return finding_rows(scanned(spark, sf), ["id"]).select("id", "label", "start", "end", "value", "confidence", "layer")


@query(
    "layer_report",
    with_tables(
        f"""SELECT 'gliner' AS layer, count(*) AS texts, (SELECT count(*) FROM entities WHERE {_FIRST}) AS findings, count(*) FILTER (WHERE {_FAILS}) AS skipped,
              count(*) AS timed, true AS plausible FROM corpus""",
        **_TABLES,
    ),
)
def layer_report_query(spark: SparkSession, sf: str) -> DataFrame:
    """Findings, failures and times of a layer; the times themselves differ from run to run."""
    report = layer_report(scanned(spark, sf))
    plausible = (F.col("avg_ms") > 0) & (F.col("avg_ms") <= F.col("max_ms"))
    return report.select("layer", "texts", "findings", "skipped", "timed", plausible.alias("plausible"))


#: Texts that the slow stand-in never answers, and how long it gets.
_HANGS, LIMIT_MS = "length(text) % 211 = 7", 2000


def slow_stand_in():
    """Loader of a stand-in that also hangs on some texts."""
    predict = stand_in()

    def spans(texts: list[str]) -> list[list[dict]]:
        if any(len(t) % 211 == 7 for t in texts):
            time.sleep(3600)
        return predict(texts)

    return spans


def timed(spark: SparkSession, sf: str) -> DataFrame:
    texts = read_texts(spark, sf, "documents", "doc_id", "text")
    return cascade(texts, [M.model_layer(slow_stand_in, timeout_ms=LIMIT_MS, forks=8)])


@query(
    "layer_skipped",
    f"""SELECT doc_id AS id, 'gliner' AS layer, {_HANGS} OR {_FAILS} AS skipped,
          CASE WHEN {_HANGS} THEN 'timeout after {LIMIT_MS}ms' WHEN {_FAILS} THEN 'scan failed' ELSE '' END AS reason FROM documents""",
)
def layer_skipped(spark: SparkSession, sf: str) -> DataFrame:
    """Texts that the model fails on, and texts that it does not answer in time."""
    layer = F.element_at("layers", 1)
    return timed(spark, sf).select("id", layer["name"].alias("layer"), layer.skipped.alias("skipped"), layer.skip_reason.alias("reason"))


@query(
    "detect_ml_timed",
    with_tables(
        f"""SELECT id, label, s AS start, e AS "end", entities.text AS value, round(score, 4) AS confidence, 'gliner' AS layer
            FROM entities JOIN (SELECT * FROM corpus WHERE NOT {_HANGS}) c USING (id) WHERE {_FIRST.replace("text", "entities.text")}""",
        **_TABLES,
    ),
)
def detect_ml_timed(spark: SparkSession, sf: str) -> DataFrame:
    """Texts that come after one that hangs are answered by a new process."""
    return finding_rows(timed(spark, sf), ["id"]).select("id", "label", "start", "end", "value", "confidence", "layer")


# --- several layers, the models in other places ------------------------------------------------------

_SETTINGS = Settings(toggles=everything_on(), entropy_threshold=3.5, entropy_length=16)


def second_stand_in():
    """Loader of a stand-in with the labels of the second model."""
    predict = stand_in()
    return lambda texts: [[x | {"label": _SECOND[x["start"] % len(_SECOND)]} for x in spans] for spans in predict(texts)]


def model_sql(source: str, position: int, second: bool = False) -> str:
    """Findings of a stand-in over (id, text), as SELECT of the columns of O.findings."""
    labels = _SECOND if second else _LABELS
    found = f"""SELECT id, value AS text, s, e, ({O.words(labels)})[CAST(s % {len(labels)} AS INTEGER) + 1] AS {"label2" if second else "label"}, s * 37 % 100 / 100.0 AS score
        FROM ({O.matches([_ONE], f"(SELECT * FROM {source} WHERE NOT {_FAILS})")})"""
    label = f"coalesce(CASE label2 {' '.join(f'WHEN {O.lit(k)} THEN {O.lit(v)}' for k, v in M.LABEL_MAP.items())} END, label2)" if second else "label"
    return f"""SELECT id, '' AS rule_id, CAST(s AS INTEGER) AS ord, {label} AS label, text AS value, CAST(s AS INTEGER) AS s, CAST(e AS INTEGER) AS e,
        round(score, 4) AS confidence, '{"opf" if second else "gliner"}' AS layer, {position} AS layer_ord FROM ({found}) WHERE {_SECOND_KEPT if second else _FIRST}"""


_COLUMNS = "id, rule_id, ord, label, value, s, e, confidence, layer, layer_ord"


def _stack(*layers, texts: str = "SELECT doc_id AS id, text FROM documents") -> dict[str, str]:
    """Tables of a cascade: each layer is a function from a table of (id, text) and its position to SQL, or ``entropy``."""
    tables = {"corpus": texts}
    for k, layer in enumerate(layers, start=1):
        seen, marks = ("corpus", None) if k == 1 else (f"t{k}", f"k{k}")
        if marks:
            tables[marks] = O.folded("SELECT * FROM corpus", " UNION ALL ".join(f"SELECT {_COLUMNS} FROM l{j}" for j in range(1, k)), contained=False)
            tables[seen] = f"SELECT id, masked AS text FROM {marks}"
        tables[f"l{k}"] = O.entropy(marks, 3.5, 16, unconditional=True, layer_ord=k) if layer == "entropy" else O.moved(layer(seen, k), marks) if marks else layer(seen, k)
    tables["f"] = " UNION ALL ".join(f"SELECT {_COLUMNS} FROM l{j}" for j in range(1, len(layers) + 1))
    return tables


def _patterns_sql(source: str, position: int) -> str:
    return O.findings(profile("compat"), source, layer_ord=position)


_FOUND = "SELECT id, label, value, s AS span_start, e AS span_end, confidence, layer FROM f"


def _found(df: DataFrame) -> DataFrame:
    rows = finding_rows(df, ["id"]).withColumnRenamed("start", "span_start").withColumnRenamed("end", "span_end")
    return rows.select("id", "label", "value", "span_start", "span_end", "confidence", "layer")


def stacked(spark: SparkSession, sf: str, kinds: str) -> DataFrame:
    """The cascade of ``p`` (patterns), ``e`` (entropy), ``m`` and ``s`` (first and second model), in that order."""
    make = {
        "p": lambda: pattern_layer(_SETTINGS), "e": lambda: entropy_layer(_SETTINGS),
        "m": lambda: M.model_layer(stand_in), "s": lambda: M.model_layer(second_stand_in, second=True),
    }
    return cascade(read_texts(spark, sf, "documents", "doc_id", "text"), [make[k]() for k in kinds])


_MODEL_FIRST = _stack(model_sql, _patterns_sql, "entropy")


@query("cascade_ml_first", with_tables(_FOUND, **_MODEL_FIRST))
def cascade_ml_first(spark: SparkSession, sf: str) -> DataFrame:
    """The model, then patterns and entropy on what it has masked."""
    return _found(stacked(spark, sf, "mpe"))


@query("cascade_two_models", with_tables(_FOUND, **_stack(lambda t, k: model_sql(t, k, second=True), model_sql, _patterns_sql, "entropy")))
def cascade_two_models(spark: SparkSession, sf: str) -> DataFrame:
    """The second model, the first on what it has masked, then patterns and entropy."""
    return _found(stacked(spark, sf, "smpe"))


@query("cascade_ml_instead", with_tables(_FOUND, **_stack(_patterns_sql, "entropy", lambda t, k: model_sql(t, k, second=True))))
def cascade_ml_instead(spark: SparkSession, sf: str) -> DataFrame:
    """The second model in the first one's place, after patterns and entropy."""
    return _found(stacked(spark, sf, "pes"))


# --- evaluation of several layers --------------------------------------------------------------------

_LAYERED = _stack(_patterns_sql, "entropy", model_sql, texts=O.corpus()) | {
    "truth": TRUTH_TABLES["truth"],
    "pred": f"SELECT id, value, s, e, label, layer, row_number() OVER (PARTITION BY id ORDER BY {O.FINDING_ORDER}) - 1 AS pos FROM f",
} | {k: TRUTH_TABLES[k] for k in ("pairs", "credited", "wrong")}


def layered(spark: SparkSession, sf: str) -> DataFrame:
    """Truth of the corpus, and the findings of patterns, entropy and the model in one cascade."""
    patterns = pattern_layer(_SETTINGS, also={"old": profile("simple")})
    found = cascade(corpus(spark, sf), [patterns, entropy_layer(_SETTINGS), M.model_layer(stand_in)])
    spans = F.transform("old", lambda f: F.struct(f.value.alias("value"), f.start.alias("start"), f.end.alias("end"), f.label.alias("label")))
    return found.select("id", settled(F.array_distinct(spans)).alias("truth"), "findings")


@query(
    "eval_layers",
    with_tables("SELECT id, value, s AS span_start, e AS span_end, label, by_layer, by_label FROM credited", **_LAYERED),
)
def eval_layers(spark: SparkSession, sf: str) -> DataFrame:
    """Truth spans with the layer that caught them, where three layers compete."""
    credited = V.credit_rows(V.score(layered(spark, sf), IGNORED))
    return credited.withColumnRenamed("start", "span_start").withColumnRenamed("end", "span_end")


@query(
    "eval_breakdown",
    with_tables(
        """SELECT level, layer, label, total, caught, total - caught AS missed, false_pos,
             round(CASE WHEN caught + false_pos > 0 THEN caught * 100.0 / (caught + false_pos) ELSE 0 END, 6) AS precision_pct,
             round(CASE WHEN total > 0 THEN caught * 100.0 / total ELSE 0 END, 6) AS recall_pct,
             round(CASE WHEN total + caught + false_pos > 0 THEN CAST(200 * caught AS DOUBLE) / (total + caught + false_pos) ELSE 0 END, 6) AS f1
           FROM (SELECT CASE g WHEN 3 THEN 'all' WHEN 1 THEN 'layer' WHEN 0 THEN 'layer_label' ELSE 'label' END AS level, layer, label, total, caught, false_pos
             FROM (SELECT GROUPING_ID(layer, label) AS g, layer, label, count(*) FILTER (WHERE truth) AS total,
                     count(*) FILTER (WHERE truth AND layer IS NOT NULL) AS caught, count(*) FILTER (WHERE NOT truth) AS false_pos
                   FROM (SELECT by_layer AS layer, label, true AS truth FROM credited UNION ALL SELECT layer, label, false FROM wrong)
                   GROUP BY GROUPING SETS ((), (layer), (layer, label), (label)))
             WHERE layer IS NOT NULL OR g IN (2, 3))""",
        **_LAYERED,
    ),
)
def eval_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    """Totals, layers, what each layer caught, and labels, from one scan."""
    return V.breakdown(V.score(layered(spark, sf), IGNORED))
