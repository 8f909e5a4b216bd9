"""Checked queries over texts: detection, entropy, masking, the cascade and the whole scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwright.functions.spans import applied, settled
from veilwright.operators.blocking import block_texts, content_is_blocked, file_is_blocked
from veilwright.operators.detect import detect, finding_rows
from veilwright.operators.entropy import candidate, detect_entropy, shannon
from veilwright.operators.kept import scan_kept
from veilwright.operators.redact import highlight, mask_layer, maximal_spans, redact
from veilwright.operators.reuse import cache_stats, hot_texts
from veilwright.oracle import detection as O
from veilwright.plans.cascade import Settings, cascade, default_layers
from veilwright.plans.registry import query, with_tables
from veilwright.plans.scan import scan_and_redact, without_allowed
from veilwright.sources.catalog import active_patterns, everything_on
from veilwright.sources.derived import corpus
from veilwright.sources.patterns import PATTERNS, URL_SKIP, Pattern, profile, word_patterns
from veilwright.sources.scratch import new_folder
from veilwright.sources.tables import read_table, read_texts

CORPUS = O.corpus()
BENCH = Settings(toggles=everything_on(), entropy_threshold=3.5, entropy_length=16)
CUSTOM = [("TICKET", r"[A-Z]{3,6}-\d{3,6}"), ("HANDLE", r"@[a-z]+\b")]
BLOCKED_WORDS = ["staging", "Müller", "a.b", "corp.io", "the"]
ALLOWED = ["a.b@corp.io", "555) 123-4567", "(555) 123-4567", "10.20.30.40", "ABCDEFGH"]

FINDING_COLUMNS = (
    "id, rule_id, ord AS pattern_ord, label, value, s AS span_start, e AS span_end, confidence, layer"
)


def span_rows(df: DataFrame, findings: str = "findings") -> DataFrame:
    """Findings as rows, with column names that need no quoting."""
    return (
        finding_rows(df, ["id"], findings)
        .withColumnRenamed("start", "span_start")
        .withColumnRenamed("end", "span_end")
    )


def marks_text(column: str) -> F.Column:
    return F.array_join(
        F.transform(column, lambda m: F.concat_ws(":", m.start.cast("string"), m.end.cast("string"), m.label)), ";"
    )


def _detect_query(name: str, patterns: list[Pattern]) -> None:
    sql = with_tables(
        f"SELECT {FINDING_COLUMNS} FROM f", corpus=CORPUS, f=O.findings(patterns, "corpus")
    )

    @query(name, sql)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return span_rows(detect(corpus(spark, sf), patterns))


EXTENDED = profile("extended")
for _rule in dict.fromkeys(p.rule_id for p in PATTERNS):
    _detect_query(f"detect_{_rule}", [p for p in EXTENDED if p.rule_id == _rule])
_detect_query("detect_all", profile("compat"))
_detect_query("detect_extended", EXTENDED)
_detect_query("detect_default_rules", active_patterns())
_detect_query("detect_validated", [p for p in EXTENDED if p.validator])
_detect_query("detect_context", [p for p in EXTENDED if p.context and not p.required])
_detect_query("detect_ctx_required", [p for p in EXTENDED if p.required])
_detect_query("detect_simple", profile("simple"))
_detect_query("detect_simple_extended", profile("simple_extended"))
_detect_query("detect_custom", profile("simple", CUSTOM)[-2:])
_detect_query("detect_words", word_patterns(BLOCKED_WORDS))


@query("src_texts", "SELECT doc_id AS id, text FROM documents")
def src_texts(spark: SparkSession, sf: str) -> DataFrame:
    return read_texts(spark, sf, "documents", "doc_id", "text")


@query(
    "urls_kept",
    f"SELECT page_id, url FROM pages WHERE len(list_filter({O.words(URL_SKIP)}, lambda w: contains(lower(url), w))) = 0",
)
def urls_kept(spark: SparkSession, sf: str) -> DataFrame:
    skip = F.array(*[F.lit(s) for s in URL_SKIP])
    lower = F.lower("url")
    return (
        read_table(spark, sf, "pages").select("page_id", "url").where(~F.exists(skip, lambda s: lower.contains(s)))
    )


@query(
    "findings_not_allowed",
    with_tables(
        f"SELECT {FINDING_COLUMNS} FROM f WHERE lower(value) NOT IN ({', '.join(O.lit(a.lower()) for a in ALLOWED)})",
        corpus=CORPUS,
        f=O.findings(profile("compat"), "corpus"),
    ),
)
def findings_not_allowed(spark: SparkSession, sf: str) -> DataFrame:
    return span_rows(without_allowed(detect(corpus(spark, sf), profile("compat")), ALLOWED))


@query(
    "masked_preview",
    with_tables(
        "SELECT id, label, s AS span_start, substr(value, 1, 3) || '•••' AS preview FROM f",
        corpus=CORPUS,
        f=O.findings(profile("compat"), "corpus"),
    ),
)
def masked_preview(spark: SparkSession, sf: str) -> DataFrame:
    return span_rows(detect(corpus(spark, sf), profile("compat"))).select(
        "id", "label", "span_start", F.concat(F.substring("value", 1, 3), F.lit("•••")).alias("preview")
    )


# --- entropy -------------------------------------------------------------------------------------

_PLAIN = "SELECT id, text, text AS masked, CAST([] AS STRUCT(s INTEGER, e INTEGER, ms BIGINT, me BIGINT, shift BIGINT)[]) AS marks FROM corpus"


@query(
    "detect_entropy",
    with_tables(
        f"SELECT {FINDING_COLUMNS} FROM f", corpus=CORPUS, plain=_PLAIN, f=O.entropy("plain", 3.5, 16, layer_ord=2)
    ),
)
def entropy_bench(spark: SparkSession, sf: str) -> DataFrame:
    return span_rows(detect_entropy(corpus(spark, sf), 3.5, 16))


@query(
    "detect_entropy_default",
    with_tables(f"SELECT {FINDING_COLUMNS} FROM f", corpus=CORPUS, plain=_PLAIN, f=O.entropy("plain", 4.5, 20)),
)
def entropy_default(spark: SparkSession, sf: str) -> DataFrame:
    return span_rows(detect_entropy(corpus(spark, sf)))


@query(
    "detect_entropy_unconditional",
    with_tables(
        f"SELECT {FINDING_COLUMNS} FROM f",
        corpus=CORPUS,
        plain=_PLAIN,
        f=O.entropy("plain", 4.5, 20, gated=False, unconditional=True),
    ),
)
def entropy_unconditional(spark: SparkSession, sf: str) -> DataFrame:
    return span_rows(detect_entropy(corpus(spark, sf), keyword_gated=False, unconditional=True))


@query(
    "entropy_candidates",
    with_tables(
        "SELECT id, value AS token, round(-list_sum(list_transform(list_distinct(string_split(value, '')), "
        "lambda x: (len(list_filter(string_split(value, ''), lambda y: y = x)) / CAST(length(value) AS DOUBLE)) "
        "* log2(len(list_filter(string_split(value, ''), lambda y: y = x)) / CAST(length(value) AS DOUBLE)))), 6) AS bits "
        "FROM t",
        corpus=CORPUS,
        plain=_PLAIN,
        t=O.tokens("plain", 16),
    ),
)
def entropy_candidates(spark: SparkSession, sf: str) -> DataFrame:
    found = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{Nd}+/=_-]{4,}"), 0)
    return (
        corpus(spark, sf)
        .select("id", F.explode_outer(F.filter(found, lambda v: candidate(v, 16))).alias("token"))
        .where("token is not null")
        .select("id", "token", F.round(shannon(F.col("token")), 6).alias("bits"))
    )


# --- masking and the cascade -----------------------------------------------------------------------

_L1 = O.findings(profile("compat"), "corpus")
_MASKED = O.folded("SELECT * FROM corpus", "SELECT * FROM l1", contained=False)
_CASCADE = {
    "corpus": CORPUS,
    "l1": _L1,
    "k": _MASKED,
    "l2": O.entropy("k", 3.5, 16, unconditional=True),
    "f": "SELECT * FROM l1 UNION ALL SELECT * FROM l2",
}
_DEFAULT = {
    "corpus": CORPUS,
    "l1": O.findings(active_patterns(), "corpus"),
    "k": _MASKED,
    "l2": O.entropy("k", 4.5, 20),
    "f": "SELECT * FROM l1 UNION ALL SELECT * FROM l2",
}
_CLEAN = O.folded("SELECT * FROM corpus", "SELECT * FROM f", contained=True)
_MARKS = "coalesce(array_to_string(list_transform(marks, lambda m: m.s || ':' || m.e || ':' || m.label), ';'), '') AS applied"


@query(
    "spans_maximal",
    with_tables(
        """SELECT id, label, s AS span_start, e AS span_end FROM (
             SELECT *, max(e) OVER (PARTITION BY id ORDER BY s, e DESC, layer_ord, ord
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM f)
           WHERE reach IS NULL OR e > reach""",
        corpus=CORPUS,
        f=_L1,
    ),
)
def spans_maximal(spark: SparkSession, sf: str) -> DataFrame:
    found = maximal_spans(detect(corpus(spark, sf), profile("compat")))
    return span_rows(found, "maximal").select("id", "label", "span_start", "span_end")


@query(
    "spans_applied",
    with_tables(
        "SELECT id, m.label AS label, m.s AS span_start, m.e AS span_end FROM (SELECT id, unnest(marks) AS m FROM k)",
        corpus=CORPUS,
        f=_L1,
        k=_CLEAN,
    ),
)
def spans_applied(spark: SparkSession, sf: str) -> DataFrame:
    found = detect(corpus(spark, sf), profile("compat")).select("id", settled(applied(F.col("findings"))).alias("marks"))
    return (
        found.select("id", F.explode("marks").alias("m"))
        .select(
            "id", F.col("m.label").alias("label"), F.col("m.start").alias("span_start"), F.col("m.end").alias("span_end")
        )
    )


@query(
    "mask_layer1",
    with_tables(
        f"SELECT id, masked, {_MARKS} FROM k",
        corpus=CORPUS,
        l1=_L1,
        k=_MASKED,
    ),
)
def mask_layer1(spark: SparkSession, sf: str) -> DataFrame:
    return mask_layer(detect(corpus(spark, sf), profile("compat"))).select(
        "id", "masked", marks_text("marks").alias("applied")
    )


@query("cascade_default", with_tables(f"SELECT {FINDING_COLUMNS} FROM f", **_CASCADE))
def cascade_default(spark: SparkSession, sf: str) -> DataFrame:
    return span_rows(cascade(corpus(spark, sf), default_layers(BENCH)))


@query(
    "layer_counts",
    with_tables(
        """SELECT c.id, n.layer, CAST(count(f.id) AS INTEGER) AS findings_count FROM corpus c
           CROSS JOIN (VALUES ('presidio'), ('entropy'), ('contextgate')) n(layer)
           LEFT JOIN f ON f.id = c.id AND f.layer = n.layer GROUP BY c.id, n.layer""",
        **_CASCADE,
    ),
)
def layer_counts(spark: SparkSession, sf: str) -> DataFrame:
    return cascade(corpus(spark, sf), default_layers(BENCH)).select("id", F.explode("layers").alias("l")).select(
        "id", F.col("l.name").alias("layer"), F.col("l.findings_count").alias("findings_count")
    )


def _scan_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "id",
        "redacted_text",
        F.size("findings").alias("findings_count"),
        F.size("applied").alias("applied_count"),
        F.array_join(
            F.transform(
                "applied",
                lambda a: F.concat_ws(":", a.start.cast("string"), a.end.cast("string"), a.label),
            ),
            ";",
        ).alias("applied"),
    )


_SCAN_SELECT = """SELECT k2.id, k2.masked AS redacted_text, CAST(coalesce(n.n, 0) AS INTEGER) AS findings_count,
    CAST(len(marks) AS INTEGER) AS applied_count,
    coalesce(array_to_string(list_transform(marks, lambda m: m.s || ':' || m.e || ':[REDACTED-' || m.label || ']'), ';'), '') AS applied
    FROM k2 LEFT JOIN (SELECT id, count(*) AS n FROM f GROUP BY id) n ON n.id = k2.id"""


@query("scan_and_redact", with_tables(_SCAN_SELECT, **_CASCADE, k2=_CLEAN))
def scan(spark: SparkSession, sf: str) -> DataFrame:
    return _scan_columns(scan_and_redact(corpus(spark, sf), settings=BENCH))


@query("scan_default", with_tables(_SCAN_SELECT, **_DEFAULT, k2=_CLEAN))
def scan_default(spark: SparkSession, sf: str) -> DataFrame:
    return _scan_columns(scan_and_redact(corpus(spark, sf)))


@query("dedup_scan_back", with_tables(_SCAN_SELECT, **_CASCADE, k2=_CLEAN))
def dedup_scan_back(spark: SparkSession, sf: str) -> DataFrame:
    return _scan_columns(scan_and_redact(corpus(spark, sf), settings=BENCH, reuse=True))


@query(
    "scan_allowed_words",
    with_tables(
        _SCAN_SELECT,
        **{**_CASCADE, "f": f"SELECT * FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2) WHERE lower(value) NOT IN ({', '.join(O.lit(a.lower()) for a in ALLOWED)})"},
        k2=_CLEAN,
    ),
)
def scan_allowed_words(spark: SparkSession, sf: str) -> DataFrame:
    return _scan_columns(scan_and_redact(corpus(spark, sf), settings=BENCH, allowed=ALLOWED))


_DOCUMENTS = "SELECT doc_id AS id, text FROM documents"
_TURNS = "SELECT conv_id * 1000 + turn AS id, text FROM conversations"


@query(
    "redact_documents",
    with_tables(
        f"SELECT id, masked AS redacted_text, {_MARKS} FROM k",
        corpus=_DOCUMENTS,
        f=_L1,
        k=_CLEAN,
    ),
)
def redact_documents(spark: SparkSession, sf: str) -> DataFrame:
    found = detect(read_texts(spark, sf, "documents", "doc_id", "text"), profile("compat"))
    return _bare(redact(found))


@query(
    "redact_conversations",
    with_tables(
        f"SELECT id, masked AS redacted_text, {_MARKS} FROM k",
        corpus=_TURNS,
        f=O.findings(profile("compat", CUSTOM) + word_patterns(BLOCKED_WORDS), "corpus"),
        k=_CLEAN,
    ),
)
def redact_conversations(spark: SparkSession, sf: str) -> DataFrame:
    texts = read_texts(spark, sf, "conversations", "conv_id * 1000 + turn", "text")
    return _bare(redact(detect(texts, profile("compat", CUSTOM) + word_patterns(BLOCKED_WORDS))))


def _bare(df: DataFrame) -> DataFrame:
    """Applied spans with the label alone, as the masking step knows it."""
    return df.select(
        "id",
        "redacted_text",
        F.array_join(
            F.transform(
                "applied",
                lambda a: F.concat_ws(
                    ":", a.start.cast("string"), a.end.cast("string"), F.regexp_extract(a.label, r"^\[REDACTED-(.*)\]$", 1)
                ),
            ),
            ";",
        ).alias("applied"),
    )


@query(
    "highlight",
    with_tables("SELECT id, html AS highlighted FROM k", corpus=CORPUS, l1=_L1, k=_MASKED),
)
def highlight_query(spark: SparkSession, sf: str) -> DataFrame:
    return highlight(detect(corpus(spark, sf), profile("compat"))).select("id", "highlighted")


# --- reuse ---------------------------------------------------------------------------------------


@query(
    "cache_stats",
    """SELECT CAST(sum(n) - count(*) AS BIGINT) AS hits, count(*) AS misses, count(*) AS size,
              CAST(floor(100 * (sum(n) - count(*)) / sum(n) + 0.5) AS BIGINT) AS hit_rate
       FROM (SELECT sha256(text) AS h, count(*) AS n FROM documents GROUP BY 1)""",
)
def cache_stats_query(spark: SparkSession, sf: str) -> DataFrame:
    return cache_stats(read_table(spark, sf, "documents").select("text"))


@query(
    "hot_texts",
    """SELECT sha256(text) AS hash, max(doc_id) AS last_seen, count(*) AS uses FROM documents
       GROUP BY 1 ORDER BY last_seen DESC, hash LIMIT 100""",
)
def hot_texts_query(spark: SparkSession, sf: str) -> DataFrame:
    return hot_texts(read_table(spark, sf, "documents").select("doc_id", "text"), "doc_id", 100)


# --- blocking ------------------------------------------------------------------------------------

EXTENSIONS = [".env", ".pem", ".html", ".key", "825", ".Com"]
_BASE = "regexp_extract(regexp_replace(path, '/+$', ''), '[^/]*$')"
_PATHS = "SELECT page_id AS id, regexp_replace(url, '[?#].*$', '') AS path, html AS text FROM pages"
_BLOCKED_FILE = f"""(regexp_extract(lower({_BASE}), '\\.[^.]*$') IN ({', '.join(O.lit(e.lower()) for e in EXTENSIONS)})
    OR '.' || lower({_BASE}) IN ({', '.join(O.lit(e.lower()) for e in EXTENSIONS)})
    OR lower({_BASE}) IN ({', '.join(O.lit(e.lower()) for e in EXTENSIONS)}))"""
_BLOCKED_CONTENT = "len(regexp_extract_all(text, '(?m)^[A-Z_]+=.+$')) >= 3"


def _paths(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "pages").select(
        F.col("page_id").alias("id"),
        F.regexp_replace("url", "[?#].*$", "").alias("path"),
        F.col("html").alias("text"),
    )


@query(
    "files_blocked",
    with_tables(f"SELECT id, path, {_BLOCKED_FILE} AS blocked FROM paths", paths=_PATHS),
)
def files_blocked(spark: SparkSession, sf: str) -> DataFrame:
    return _paths(spark, sf).select("id", "path", file_is_blocked(F.col("path"), EXTENSIONS).alias("blocked"))


@query(
    "content_blocked",
    with_tables(f"SELECT id, {_BLOCKED_CONTENT} AS blocked FROM corpus", corpus=CORPUS),
)
def content_blocked(spark: SparkSession, sf: str) -> DataFrame:
    return corpus(spark, sf).select("id", content_is_blocked(F.col("text")).alias("blocked"))


@query(
    "block_files",
    with_tables(
        f"""SELECT id, CASE WHEN {_BLOCKED_FILE} THEN '[REDACTED-FILE-' || regexp_extract({_BASE}, '\\.[^.]*$') || ': ' || {_BASE} || ']'
                   WHEN {_BLOCKED_CONTENT} THEN '[REDACTED-FILE-' || regexp_extract({_BASE}, '\\.[^.]*$') || ': ' || {_BASE} || ']'
                   ELSE text END AS text,
              {_BLOCKED_FILE} OR {_BLOCKED_CONTENT} AS blocked,
              CASE WHEN {_BLOCKED_FILE} THEN 'blocked file' WHEN {_BLOCKED_CONTENT} THEN 'blocked content' ELSE '' END AS reason
            FROM paths""",
        paths=_PATHS,
    ),
)
def block_files(spark: SparkSession, sf: str) -> DataFrame:
    return block_texts(_paths(spark, sf), EXTENSIONS).select("id", "text", "blocked", "reason")


@query(
    "block_content",
    with_tables(
        f"""SELECT id, CASE WHEN {_BLOCKED_CONTENT} THEN '[REDACTED-FILE-.txt: note' || id || '.txt]' ELSE text END AS text,
              {_BLOCKED_CONTENT} AS blocked,
              CASE WHEN {_BLOCKED_CONTENT} THEN 'blocked content' ELSE '' END AS reason
            FROM corpus""",
        corpus=CORPUS,
    ),
)
def block_content(spark: SparkSession, sf: str) -> DataFrame:
    notes = corpus(spark, sf).withColumn("path", F.concat(F.lit("/tmp/note"), F.col("id").cast("string"), F.lit(".txt")))
    return block_texts(notes, EXTENSIONS).select("id", "text", "blocked", "reason")


# --- results kept between runs -----------------------------------------------------------------------

_RULES_OFF = {"email_regex": False}
_CHANGED = O.findings(active_patterns(_RULES_OFF), "corpus")


@query(
    "kept_results",
    with_tables(
        """SELECT 'more texts' AS run, id, masked AS redacted_text, text NOT IN (SELECT text FROM documents) AS scanned FROM k2
           UNION ALL SELECT 'the same' AS run, id, masked, false FROM k2
           UNION ALL SELECT 'a rule off' AS run, id, masked, true FROM k3""",
        **_DEFAULT,
        k2=_CLEAN,
        m1=_CHANGED,
        mk=O.folded("SELECT * FROM corpus", "SELECT * FROM m1", contained=False),
        m2=O.entropy("mk", 4.5, 20),
        k3=O.folded("SELECT * FROM corpus", "SELECT * FROM m1 UNION ALL SELECT * FROM m2", contained=True),
    ),
)
def kept_results(spark: SparkSession, sf: str) -> DataFrame:
    """After a run over the documents: one over more texts, the same again, and one with a rule switched off."""
    store = new_folder(spark, "kept")
    scan_kept(read_texts(spark, sf, "documents", "doc_id", "text"), store)
    runs = {name: scan_kept(corpus(spark, sf), store, settings) for name, settings in (("more texts", Settings()), ("the same", Settings()), ("a rule off", Settings(toggles=_RULES_OFF)))}
    rows = [df.select(F.lit(name).alias("run"), "id", "redacted_text", "scanned") for name, df in runs.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])
