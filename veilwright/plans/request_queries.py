"""Checked queries over rules, hosts, chat requests and tool messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwright.operators import extract, hosts, rulesets
from veilwright.operators.detect import detect
from veilwright.operators.redact import redact
from veilwright.oracle import detection as O
from veilwright.plans.registry import query, with_tables
from veilwright.sources.catalog import FILE_EXTENSION_RULES, RULES
from veilwright.sources.patterns import word_patterns
from veilwright.sources.tables import read_table, spread

# --- rules: every customer is a user with three toggles, some of which name no rule ------------------

IDS = [r[1] for r in RULES] + ["no_such_rule", "old_rule", "typo_rule", "x", "y"]
_RULES = "SELECT * FROM (VALUES " + ", ".join(
    f"({O.lit(r[1])}, {O.lit(r[2])}, {O.lit(r[3])}, {O.lit(r[4])}, {r[5]}, {O.lit(r[6])})" for r in RULES
) + ") AS v(rule_id, label, note, group_id, tier, layer)"
_TOGGLES = f"""SELECT c_custkey AS user_id, ({O.words(IDS)})[CAST((c_custkey * 7 + k * 31) % {len(IDS)} AS INTEGER) + 1] AS rule_id,
    (c_custkey + k) % 2 = 0 AS enabled FROM customer, (VALUES (0), (1), (2)) AS n(k)"""
_STATE = """SELECT c_custkey AS user_id, r.*, coalesce(t.enabled, r.tier IN (1, 2)) AS enabled
    FROM customer CROSS JOIN rules r LEFT JOIN toggles t ON t.user_id = c_custkey AND t.rule_id = r.rule_id"""
_TIER = "CASE tier WHEN 1 THEN 'always_on' WHEN 2 THEN 'good_to_have' ELSE 'to_be_safer' END"
RULE_TABLES = {"rules": _RULES, "toggles": _TOGGLES}
STATE_TABLES = {**RULE_TABLES, "state": _STATE}


def users(spark: SparkSession, sf: str) -> DataFrame:
    return spread(read_table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id")))


def toggles(spark: SparkSession, sf: str) -> DataFrame:
    ids = F.array(*[F.lit(i) for i in IDS])
    return (
        users(spark, sf)
        .select("user_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"))
        .select(
            "user_id",
            F.element_at(ids, ((F.col("user_id") * 7 + F.col("k") * 31) % len(IDS) + 1).cast("int")).alias("rule_id"),
            ((F.col("user_id") + F.col("k")) % 2 == 0).alias("enabled"),
        )
    )


def states(spark: SparkSession, sf: str) -> DataFrame:
    return rulesets.rule_states(users(spark, sf), toggles(spark, sf))


def state(spark: SparkSession, sf: str) -> DataFrame:
    return rulesets.effective(users(spark, sf), toggles(spark, sf))


@query("rules_effective", with_tables("SELECT user_id, rule_id, enabled FROM state", **STATE_TABLES))
def rules_effective(spark: SparkSession, sf: str) -> DataFrame:
    return state(spark, sf).select("user_id", "rule_id", "enabled")


@query(
    "rules_normalised",
    with_tables(
        "SELECT t.user_id, t.rule_id, t.enabled FROM toggles t JOIN rules r USING (rule_id) WHERE t.enabled <> (r.tier IN (1, 2))",
        **RULE_TABLES,
    ),
)
def rules_normalised(spark: SparkSession, sf: str) -> DataFrame:
    return rulesets.normalise(toggles(spark, sf))


@query(
    "rules_unknown",
    with_tables("SELECT * FROM toggles WHERE rule_id NOT IN (SELECT rule_id FROM rules)", **RULE_TABLES),
)
def rules_unknown(spark: SparkSession, sf: str) -> DataFrame:
    return rulesets.unknown(toggles(spark, sf))


@query(
    "rules_rollup",
    with_tables(
        f"SELECT user_id, {_TIER} AS tier, count(*) FILTER (WHERE enabled) AS enabled_rules, count(*) AS total_rules FROM state GROUP BY 1, 2",
        **STATE_TABLES,
    ),
)
def rules_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return rulesets.roll_up(states(spark, sf))


@query(
    "rules_groups",
    with_tables(
        "SELECT user_id, group_id, CASE WHEN bool_and(enabled) THEN 'on' WHEN bool_or(enabled) THEN 'indeterminate' ELSE 'off' END AS state FROM state GROUP BY 1, 2",
        **STATE_TABLES,
    ),
)
def rules_groups(spark: SparkSession, sf: str) -> DataFrame:
    return rulesets.group_states(states(spark, sf))


@query(
    "rules_all_groups",
    with_tables(
        "SELECT user_id, count(DISTINCT group_id) AS groups, count(DISTINCT group_id) = (SELECT count(DISTINCT group_id) FROM rules) AS complete FROM state GROUP BY 1",
        **STATE_TABLES,
    ),
)
def rules_all_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Groups that each user sees, against the number of groups there are."""
    groups = rulesets.group_states(states(spark, sf)).groupBy("user_id").agg(F.count("*").alias("groups"))
    return groups.withColumn("complete", F.col("groups") == rulesets.group_count())


@query(
    "rules_tier1_off",
    with_tables(
        "SELECT user_id, count(*) AS n_off, string_agg(label, ', ' ORDER BY label) AS labels FROM state WHERE tier = 1 AND NOT enabled GROUP BY 1",
        **STATE_TABLES,
    ),
)
def rules_tier1_off(spark: SparkSession, sf: str) -> DataFrame:
    return rulesets.disabled_always_on(state(spark, sf))


@query(
    "layers_on",
    with_tables(
        "SELECT user_id, count(DISTINCT layer) FILTER (WHERE enabled AND layer <> 'fileblock') AS layers_on FROM state GROUP BY 1",
        **STATE_TABLES,
    ),
)
def layers_on(spark: SparkSession, sf: str) -> DataFrame:
    return rulesets.layers_on(states(spark, sf))


@query(
    "rules_search",
    with_tables(
        """SELECT c_custkey AS user_id, term, rule_id, group_id, tier FROM (SELECT c_custkey, lower(substr(c_mktsegment, 3, 2)) AS term FROM customer)
           JOIN rules ON contains(lower(rule_id || chr(10) || label || chr(10) || note), term)""",
        rules=_RULES,
    ),
)
def rules_search(spark: SparkSession, sf: str) -> DataFrame:
    terms = read_table(spark, sf, "customer").select(
        F.col("c_custkey").alias("user_id"), F.lower(F.substring("c_mktsegment", 3, 2)).alias("term")
    )
    return rulesets.search(terms)


_FLAGS = """SELECT c_custkey AS user_id, layer, CASE (c_custkey + k) % 3 WHEN 0 THEN false WHEN 1 THEN true ELSE NULL END AS enabled
    FROM customer, (VALUES ('presidio', 0), ('entropy', 1), ('gliner', 3)) AS n(layer, k)"""


@query(
    "toggles_migrated",
    with_tables(
        """SELECT user_id, rule_id, bool_and(enabled) AS enabled FROM (
             SELECT t.user_id, t.rule_id, t.enabled FROM toggles t SEMI JOIN rules USING (rule_id)
             UNION ALL SELECT f.user_id, r.rule_id, false FROM flags f JOIN rules r USING (layer) WHERE NOT f.enabled)
           GROUP BY 1, 2""",
        **RULE_TABLES,
        flags=_FLAGS,
    ),
)
def toggles_migrated(spark: SparkSession, sf: str) -> DataFrame:
    layers = F.array(
        *[F.struct(F.lit(n).alias("layer"), F.lit(k).alias("k")) for n, k in (("presidio", 0), ("entropy", 1), ("gliner", 3))]
    )
    pick = (F.col("user_id") + F.col("l.k")) % 3
    flags = users(spark, sf).select("user_id", F.explode(layers).alias("l")).select(
        "user_id", F.col("l.layer").alias("layer"), F.when(pick == 0, False).when(pick == 1, True).alias("enabled")
    )
    return rulesets.migrate(flags, toggles(spark, sf))


_OWN = "SELECT c_custkey AS user_id, ([ '.PEM', '.yaml', '.Env', '.secret'])[CAST(c_custkey % 4 AS INTEGER) + 1] AS extension FROM customer"


@query(
    "blocked_extensions",
    with_tables(
        f"""SELECT user_id, e.extension FROM state JOIN (VALUES {', '.join(f"('{r}', '{x}')" for x, r in FILE_EXTENSION_RULES.items())}) e(rule_id, extension) USING (rule_id)
            WHERE enabled UNION ALL
            SELECT user_id, extension FROM own WHERE lower(extension) NOT IN ({', '.join(O.lit(x) for x in FILE_EXTENSION_RULES)})""",
        **STATE_TABLES,
        own=_OWN,
    ),
)
def blocked_extensions(spark: SparkSession, sf: str) -> DataFrame:
    exts = F.array(*[F.lit(x) for x in (".PEM", ".yaml", ".Env", ".secret")])
    own = users(spark, sf).select("user_id", F.element_at(exts, (F.col("user_id") % 4 + 1).cast("int")).alias("extension"))
    return rulesets.block_lists(state(spark, sf), own)


# --- hosts and paths of pages ----------------------------------------------------------------------

INTERCEPT = ["Reti.example.com", "api.openai.com", "ththre.example.com", "eauaux.example.com"]
BLOCKED = ["ththre.example.com", "m.ththth.example.net"]
RULES_FOR_PATHS = ({"path": "/en/25"}, {"prefix": "/fr/"}, {"method": "options"}, {"prefix": "/de"})
_HTTP = r"""SELECT page_id AS id, regexp_extract(url, '^https?://([^/?#]*)', 1) || CASE WHEN page_id % 3 = 0 THEN ':443' ELSE '' END AS host,
    regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path, CASE WHEN page_id % 10 = 0 THEN 'OPTIONS' ELSE 'POST' END AS method FROM pages"""
_HOST = "lower(regexp_replace(host, ':[0-9]+$', ''))"


def http_requests(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "pages").select(
        F.col("page_id").alias("id"),
        F.concat(
            F.regexp_extract("url", "^https?://([^/?#]*)", 1),
            F.when(F.col("page_id") % 3 == 0, ":443").otherwise(""),
        ).alias("host"),
        F.regexp_extract("url", "^https?://[^/?#]*([^?#]*)", 1).alias("path"),
        F.when(F.col("page_id") % 10 == 0, "OPTIONS").otherwise("POST").alias("method"),
    )


@query(
    "host_intercept",
    with_tables(
        f"SELECT id, host FROM http WHERE {_HOST} IN ({', '.join(O.lit(h.lower()) for h in INTERCEPT)})", http=_HTTP
    ),
)
def host_intercept(spark: SparkSession, sf: str) -> DataFrame:
    return hosts.intercepted(http_requests(spark, sf), INTERCEPT).select("id", "host")


@query(
    "host_decision",
    with_tables(
        f"""SELECT id, CASE WHEN {_HOST} IN ({', '.join(O.lit(h.lower()) for h in BLOCKED)}) THEN 'reject'
            WHEN {_HOST} IN ({', '.join(O.lit(h.lower()) for h in INTERCEPT)}) THEN 'scan' ELSE 'pass' END AS decision FROM http""",
        http=_HTTP,
    ),
)
def host_decision(spark: SparkSession, sf: str) -> DataFrame:
    return http_requests(spark, sf).select("id", hosts.decision(F.col("host"), INTERCEPT, BLOCKED).alias("decision"))


@query(
    "bypass_match",
    with_tables(
        """SELECT id, method, path, CASE WHEN path = '/en/25' THEN 'exact_match' WHEN starts_with(path, '/fr/') THEN 'prefix_match'
             WHEN lower(method) = 'options' THEN 'method_match' WHEN starts_with(path, '/de') THEN 'prefix_match' ELSE '' END AS reason FROM http""",
        http=_HTTP,
    ),
)
def bypass_match(spark: SparkSession, sf: str) -> DataFrame:
    reason = hosts.bypass_reason(F.col("method"), F.col("path"), RULES_FOR_PATHS)
    return http_requests(spark, sf).select("id", "method", "path", reason.alias("reason"))


@query(
    "domain_board",
    with_tables(
        f"""SELECT domain, coalesce(name, domain) AS name, CASE WHEN domain IN ({', '.join(O.lit(h.lower()) for h in BLOCKED)}) THEN 'Blocked'
            WHEN domain IN ({', '.join(O.lit(h.lower()) for h in INTERCEPT)}) THEN 'Scanning' ELSE 'Idle' END AS state
            FROM (SELECT DISTINCT {_HOST} AS domain FROM http UNION SELECT domain FROM known
                  UNION SELECT lower(d) FROM (VALUES {', '.join(f"({O.lit(h)})" for h in INTERCEPT + BLOCKED)}) v(d)) LEFT JOIN known USING (domain)""",
        http=_HTTP,
        known=f"SELECT * FROM (VALUES {', '.join(f'({O.lit(d)}, {O.lit(n)})' for d, n in hosts.KNOWN_DOMAINS.items())}) v(domain, name)",
    ),
)
def domain_board(spark: SparkSession, sf: str) -> DataFrame:
    return hosts.domain_board(http_requests(spark, sf), INTERCEPT, BLOCKED)


# --- chat requests: one body per turn, in each of the shapes a body can take -------------------------

_TURN = "conv_id * 1000 + turn"


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """Odd turns hold plain text, turns 0, 4, .. two parts, turns 2, 6, .. an earlier user message first."""
    t = read_table(spark, sf, "conversations")
    plain = F.to_json(F.struct(F.col("role"), F.col("text").alias("content")))
    parts = F.to_json(
        F.struct(
            F.col("role"),
            F.array(
                F.struct(F.lit("text").alias("type"), F.col("text").alias("text"), F.lit(None).cast("string").alias("content")),
                F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("content")),
                F.struct(F.lit("tool_result").alias("type"), F.lit(None).cast("string").alias("text"), F.concat(F.lit("of the "), F.col("role")).alias("content")),
            ).alias("content"),
        )
    )
    first = F.lit('{"role":"user","content":"the first \\"question\\""},')
    message = F.when(F.col("turn") % 2 == 1, plain).when(F.col("turn") % 4 == 0, parts).otherwise(F.concat(first, plain))
    return t.select(
        F.expr(_TURN).alias("id"),
        F.concat(F.lit('{"model":"m-1","messages":['), message, F.lit('],"max_tokens":16}')).alias("body"),
    )


_PART_TEXT = "CASE WHEN turn % 4 = 0 THEN text || chr(10) || 'of the ' || role ELSE text END"


@query(
    "src_messages",
    f"""SELECT {_TURN} AS id, CAST(CASE WHEN turn % 4 = 2 THEN 1 ELSE 0 END AS INTEGER) AS idx, role, {_PART_TEXT} AS text FROM conversations
        UNION ALL SELECT {_TURN}, 0, 'user', 'the first "question"' FROM conversations WHERE turn % 4 = 2""",
)
def src_messages(spark: SparkSession, sf: str) -> DataFrame:
    return extract.message_rows(requests(spark, sf))


@query(
    "last_user_message",
    f"""SELECT {_TURN} AS id,
          CAST(CASE WHEN role = 'user' THEN CASE WHEN turn % 4 = 2 THEN 1 ELSE 0 END WHEN turn % 4 = 2 THEN 0 END AS INTEGER) AS idx,
          CASE WHEN role = 'user' THEN {_PART_TEXT} WHEN turn % 4 = 2 THEN 'the first "question"' END AS text,
          role = 'user' AND turn % 4 = 0 AS is_array,
          CASE WHEN role = 'user' OR turn % 4 = 2 THEN '' ELSE 'no user message found' END AS error FROM conversations""",
)
def last_user_message(spark: SparkSession, sf: str) -> DataFrame:
    return extract.last_user_message(requests(spark, sf))


@query(
    "last_user_turn",
    "SELECT conv_id, max(turn) AS turn, max_by(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id",
)
def last_user_turn(spark: SparkSession, sf: str) -> DataFrame:
    return (
        read_table(spark, sf, "conversations")
        .where("role = 'user'")
        .groupBy("conv_id")
        .agg(F.max("turn").alias("turn"), F.max_by("text", "turn").alias("text"))
    )


WORDS = ["the", "question", "de", "und", "of"]
WORD_PATTERNS = word_patterns(WORDS)


def clean_words(texts: DataFrame) -> DataFrame:
    return redact(detect(texts, WORD_PATTERNS)).select("id", "redacted_text")


def full_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Requests with names, image parts, nested tool results and fields of all kinds; ids repeat, some are null.

    Keys repeat in some objects; every thirteenth conversation has bodies that are no JSON.
    """
    t = read_table(spark, sf, "conversations")
    image = F.struct(F.lit("image").alias("type"), F.struct(F.lit("the data").alias("data")).alias("source"))
    text_part = F.struct(F.lit("text").alias("type"), F.col("text").alias("text"), F.struct(F.lit("the cache").alias("type")).alias("cache_control"))
    result = F.struct(F.lit("tool_result").alias("type"), F.concat(F.lit("of the "), F.col("role")).alias("content"), F.lit("the tool").alias("tool_use_id"))
    inner = F.concat(F.lit('[{"type":"text","text":"the start","text":"the end","n":1},'), F.to_json(image), F.lit("]"))
    nested = F.concat(F.lit('{"type":"tool_result","is_error":false,"content":'), inner, F.lit("}"))
    parts = F.concat(F.lit("["), F.concat_ws(",", F.to_json(text_part), F.to_json(image), F.to_json(result), nested), F.lit("]"))
    plain = F.to_json(F.struct(F.col("role"), F.col("text").alias("content"), F.lit("the name").alias("name")))
    many = F.concat(F.lit('{"role":"'), F.col("role"), F.lit('","name":"the name","content":'), parts, F.lit("}"))
    first = F.lit('{"role":"user","content":"the first \\"question\\""},')
    message = F.when(F.col("turn") % 2 == 1, plain).when(F.col("turn") % 4 == 0, many).otherwise(F.concat(first, plain))
    model = F.when(F.col("conv_id") % 11 == 3, '{"model":"of the past","messages":[],"model":"the model","messages":[').otherwise('{"model":"the model","messages":[')
    broken = F.concat(F.lit("{the broken "), F.col("text"), F.lit(" of the end"))
    return t.select(
        F.when(F.col("conv_id") % 7 != 0, F.expr("conv_id div 2")).alias("id"),
        F.when(F.col("conv_id") % 13 == 5, broken).otherwise(F.concat(model, message, F.lit('],"stream":true,"max_tokens":16}'))).alias("body"),
    )


_KEY = "(conv_id * 1000 + turn) * 4"
_UNITS = f"""SELECT {_KEY} AS id, CASE WHEN role = 'user' THEN text ELSE 'the first "question"' END AS text FROM conversations WHERE role = 'user' OR turn % 4 = 2
    UNION ALL SELECT {_KEY} + 1, 'of the user' FROM conversations WHERE role = 'user' AND turn % 4 = 0
    UNION ALL SELECT {_KEY} + 2, 'the end' FROM conversations WHERE role = 'user' AND turn % 4 = 0
    UNION ALL SELECT {_KEY} + 3, '{{the broken ' || text || ' of the end' FROM conversations WHERE conv_id % 13 = 5"""


def _clean_units(units: str) -> dict[str, str]:
    return {
        "corpus": units,
        "f": O.findings(WORD_PATTERNS, "corpus"),
        "k": f"SELECT id, masked FROM ({O.folded('SELECT * FROM corpus', 'SELECT * FROM f', contained=True)})",
    }


_IMAGE = "json_object('source', json_object('data', 'the data'), 'type', 'image')"
_PARTS = f"""json_array(json_object('cache_control', json_object('type', 'the cache'), 'text', t0, 'type', 'text'), {_IMAGE},
    json_object('content', t1, 'tool_use_id', 'the tool', 'type', 'tool_result'),
    json_object('content', json_array(json_object('n', 1, 'text', t2, 'type', 'text'), {_IMAGE}), 'is_error', false, 'type', 'tool_result'))"""


@query(
    "requests_rewritten",
    with_tables(
        f"""SELECT CASE WHEN conv_id % 7 <> 0 THEN conv_id // 2 END AS id,
              CASE WHEN conv_id % 13 = 5 THEN 'parse request body' WHEN role = 'user' OR turn % 4 = 2 THEN '' ELSE 'no user message found' END AS error,
              CASE WHEN conv_id % 13 = 5 THEN raw ELSE CAST(json_object('max_tokens', 16, 'messages', CASE
                WHEN turn % 4 = 0 THEN json_array(json_object('content', {_PARTS}, 'name', 'the name', 'role', role))
                WHEN turn % 4 = 2 THEN json_array(json_object('content', f0, 'role', 'user'), json_object('content', t0, 'name', 'the name', 'role', role))
                ELSE json_array(json_object('content', t0, 'name', 'the name', 'role', role)) END, 'model', 'the model', 'stream', true) AS VARCHAR) END AS body
            FROM (SELECT c.*, r.masked AS raw, CASE WHEN role = 'user' THEN a.masked ELSE text END AS t0, coalesce(b.masked, 'of the ' || role) AS t1, coalesce(d.masked, 'the end') AS t2,
                    CASE WHEN role = 'user' THEN 'the first "question"' ELSE a.masked END AS f0
                  FROM conversations c LEFT JOIN k a ON a.id = {_KEY} LEFT JOIN k b ON b.id = {_KEY} + 1 LEFT JOIN k d ON d.id = {_KEY} + 2
                    LEFT JOIN k r ON r.id = {_KEY} + 3)""",
        **_clean_units(_UNITS),
    ),
)
def requests_rewritten(spark: SparkSession, sf: str) -> DataFrame:
    """Whole bodies, with the fields of every object in alphabetical order."""
    out = extract.rewrite_requests(full_requests(spark, sf), clean_words)
    return out.select("id", "error", F.coalesce(F.to_json(F.try_parse_json("body")), "body").alias("body"))


# --- tool messages -----------------------------------------------------------------------------------


def rpc_messages(spark: SparkSession, sf: str) -> DataFrame:
    t = read_table(spark, sf, "conversations")
    part = F.to_json(F.struct(F.lit("text").alias("type"), F.col("text")))
    return t.select(
        F.expr(_TURN).alias("id"),
        F.when(
            F.col("turn") % 4 == 0,
            F.concat(F.lit('{"jsonrpc":"2.0","id":7,"result":{"content":['), part, F.lit(',{"type":"image"},{"type":"text","text":"the end"}]}}')),
        )
        .when(F.col("turn") % 4 == 1, F.to_json(F.struct(F.lit("2.0").alias("jsonrpc"), F.col("text").alias("result"))))
        .when(
            F.col("turn") % 4 == 2,
            F.to_json(F.struct(F.lit("2.0").alias("jsonrpc"), F.struct(F.col("text").alias("content"), F.lit(1).alias("n")).alias("params"))),
        )
        .otherwise(F.concat(F.lit("not json: "), F.col("text")))
        .alias("message"),
    )


_PLACE = "CASE turn % 4 WHEN 0 THEN 'parts' WHEN 1 THEN 'result' WHEN 2 THEN 'params' ELSE '' END"


@query(
    "src_rpc_text",
    f"""SELECT {_TURN} AS id, {_PLACE} AS place,
          CASE turn % 4 WHEN 0 THEN text || chr(10) || 'the end' WHEN 3 THEN '' ELSE text END AS text FROM conversations""",
)
def src_rpc_text(spark: SparkSession, sf: str) -> DataFrame:
    return extract.rpc_text(rpc_messages(spark, sf))


def full_rpc(spark: SparkSession, sf: str) -> DataFrame:
    """Tool messages with more fields in every object; ids and some keys repeat, some ids are null."""
    t = read_table(spark, sf, "conversations")
    part = F.to_json(F.struct(F.lit("text").alias("type"), F.col("text"), F.struct(F.lit(0.5).alias("priority")).alias("annotations")))
    image = F.lit('{"type":"image","data":"the data"}')
    parts = F.concat(F.lit('{"jsonrpc":"2.0","id":6,"id":7,"result":"the past","result":{"isError":false,"content":['), F.concat_ws(",", part, image, F.lit('{"type":"text","text":"the end"}')), F.lit("]}}"))
    return t.select(
        F.when(F.col("conv_id") % 7 != 0, F.expr("conv_id div 2")).alias("id"),
        F.when(F.col("turn") % 4 == 0, parts)
        .when(F.col("turn") % 4 == 1, F.to_json(F.struct(F.lit("2.0").alias("jsonrpc"), F.col("text").alias("result"))))
        .when(F.col("turn") % 4 == 2, F.to_json(F.struct(F.lit("2.0").alias("jsonrpc"), F.struct(F.col("text").alias("content"), F.lit(1).alias("n")).alias("params"))))
        .otherwise(F.concat(F.lit("not json: "), F.col("text")))
        .alias("message"),
    )


@query(
    "rpc_rewritten",
    with_tables(
        f"""SELECT CASE WHEN conv_id % 7 <> 0 THEN conv_id // 2 END AS id, CASE turn % 4
              WHEN 0 THEN CAST(json_object('id', 7, 'jsonrpc', '2.0', 'result', json_object('content', json_array(
                json_object('annotations', json_object('priority', 0.5), 'text', a.masked, 'type', 'text'), json_object('data', 'the data', 'type', 'image'),
                json_object('text', b.masked, 'type', 'text')), 'isError', false)) AS VARCHAR)
              WHEN 1 THEN CAST(json_object('jsonrpc', '2.0', 'result', a.masked) AS VARCHAR)
              WHEN 2 THEN CAST(json_object('jsonrpc', '2.0', 'params', json_object('content', a.masked, 'n', 1)) AS VARCHAR)
              ELSE r.masked END AS message, CASE WHEN turn % 4 = 3 THEN 'parse message' ELSE '' END AS error
            FROM conversations LEFT JOIN k a ON a.id = {_KEY} LEFT JOIN k b ON b.id = {_KEY} + 1 LEFT JOIN k r ON r.id = {_KEY} + 2""",
        **_clean_units(f"SELECT {_KEY} AS id, text FROM conversations WHERE turn % 4 <> 3 UNION ALL SELECT {_KEY} + 1, 'the end' FROM conversations WHERE turn % 4 = 0 UNION ALL SELECT {_KEY} + 2, 'not json: ' || text FROM conversations WHERE turn % 4 = 3"),
    ),
)
def rpc_rewritten(spark: SparkSession, sf: str) -> DataFrame:
    """Whole messages, with the fields of every object in alphabetical order."""
    out = extract.clean_rpc(full_rpc(spark, sf), clean_words)
    return out.select("id", "error", F.coalesce(F.to_json(F.try_parse_json("message")), "message").alias("message"))
