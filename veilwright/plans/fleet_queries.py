"""Checked queries over the fleet: events, devices, tokens, policies, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwright.operators import changes as C
from veilwright.operators import fleet as L
from veilwright.operators import sessions as S
from veilwright.oracle import detection as O
from veilwright.plans.registry import query, with_tables
from veilwright.sources.tables import read_table, spread

NOW = "2024-01-31 00:00:00"
SINCE = "TIMESTAMP '2024-01-30 00:00:00'"

_EVENTS = """SELECT event_id AS id, 'org' || user_id % 5 AS org_id, 'dev' || user_id AS device_id,
    CASE WHEN event_type IN ('click', 'view') THEN 'Claude Code' ELSE 'OpenAI Codex' END AS tool,
    CASE event_type WHEN 'error' THEN 'runaway' WHEN 'view' THEN 'unknown' ELSE 'protected' END AS verdict,
    CAST(CASE WHEN event_type = 'error' THEN 1 + event_id % 3 ELSE 0 END AS INTEGER) AS direct_conn_count,
    ts AS observed_at, ts + (event_id % 120) * INTERVAL 1 SECOND AS received_at, CASE WHEN event_id % 4 = 0 THEN event_id // 400 ELSE -1 END AS batch_id FROM events"""
_DEVICES = """SELECT 'dev' || c_custkey AS id, 'org' || c_custkey % 5 AS org_id, c_name AS name, c_custkey % 7 = 0 AS revoked FROM customer"""
_ORGS = "SELECT 'org' || r_regionkey AS org_id FROM region WHERE r_regionkey <> 3 UNION ALL SELECT 'org9'"
_TOKENS = """SELECT sha256('token-' || c_custkey) AS token_hash, 'org' || c_custkey % 5 AS org_id, TIMESTAMP '1997-01-01 00:00:00' AS expires_at,
    c_custkey % 4 AS max_uses, c_custkey % 11 = 0 AS revoked FROM customer"""
_ATTEMPTS = "SELECT o_orderkey AS attempt_id, sha256('token-' || o_custkey) AS token_hash, o_orderdate AS attempted_at FROM orders"
_WRITES = """SELECT o_orderkey AS write_id, 'org' || o_custkey % 5 AS org_id, o_orderdate AS written_at,
    '{"image":"img:' || o_orderkey || '","mountMode":""}' AS bundle FROM orders"""
TABLES = {"ev": _EVENTS, "devices": _DEVICES, "orgs": _ORGS}
EV = "id, org_id, device_id, tool, verdict, direct_conn_count, observed_at, received_at"


def events(spark: SparkSession, sf: str) -> DataFrame:
    return events_of(read_table(spark, sf, "events"))


def events_of(e: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return e.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("org"), (F.col("user_id") % 5).cast("string")).alias("org_id"),
        F.concat(F.lit("dev"), F.col("user_id").cast("string")).alias("device_id"),
        F.when(kind.isin("click", "view"), "Claude Code").otherwise("OpenAI Codex").alias("tool"),
        F.when(kind == "error", "runaway").when(kind == "view", "unknown").otherwise("protected").alias("verdict"),
        F.when(kind == "error", 1 + F.col("event_id") % 3).otherwise(0).cast("int").alias("direct_conn_count"),
        F.col("ts").alias("observed_at"),
        (F.col("ts") + F.make_dt_interval(secs=(F.col("event_id") % 120).cast("decimal(18,6)"))).alias("received_at"),
        # One batch far above the limit, the others far below it, whatever the scale.
        F.when(F.col("event_id") % 4 == 0, F.expr("event_id div 400")).otherwise(-1).alias("batch_id"),
    )


def devices(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    return read_table(spark, sf, "customer").select(
        F.concat(F.lit("dev"), key.cast("string")).alias("id"),
        F.concat(F.lit("org"), (key % 5).cast("string")).alias("org_id"),
        F.col("c_name").alias("name"),
        (key % 7 == 0).alias("revoked"),
    )


def orgs(spark: SparkSession, sf: str) -> DataFrame:
    listed = read_table(spark, sf, "region").where("r_regionkey <> 3")
    return listed.select(F.concat(F.lit("org"), F.col("r_regionkey").cast("string")).alias("org_id")).unionByName(
        spark.range(1).select(F.lit("org9").alias("org_id"))
    )


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    return read_table(spark, sf, "customer").select(
        L.token_hash(F.concat(F.lit("token-"), key.cast("string"))).alias("token_hash"),
        F.concat(F.lit("org"), (key % 5).cast("string")).alias("org_id"),
        F.lit("1997-01-01 00:00:00").cast("timestamp_ntz").alias("expires_at"),
        (key % 4).alias("max_uses"),
        (key % 11 == 0).alias("revoked"),
    )


def attempts(spark: SparkSession, sf: str) -> DataFrame:
    return attempts_of(read_table(spark, sf, "orders"))


def attempts_of(orders: DataFrame) -> DataFrame:
    return orders.select(
        F.col("o_orderkey").alias("attempt_id"),
        L.token_hash(F.concat(F.lit("token-"), F.col("o_custkey").cast("string"))).alias("token_hash"),
        F.col("o_orderdate").alias("attempted_at"),
    )


def writes(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("write_id"),
        F.concat(F.lit("org"), (F.col("o_custkey") % 5).cast("string")).alias("org_id"),
        F.col("o_orderdate").alias("written_at"),
        F.concat(F.lit('{"image":"img:'), F.col("o_orderkey").cast("string"), F.lit('","mountMode":""}')).alias("bundle"),
    )


def since() -> F.Column:
    return F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")


def ev(df: DataFrame) -> DataFrame:
    return df.select(*EV.split(", "))


_OK = "EXISTS (SELECT 1 FROM devices d WHERE d.id = ev.device_id AND d.org_id = ev.org_id AND NOT d.revoked)"
_ADMITTED = "batch_id IN (SELECT batch_id FROM ev GROUP BY 1 HAVING count(*) <= 500)"


@query(
    "ingest_events",
    with_tables(
        f"SELECT {EV} FROM ev WHERE {_OK} AND {_ADMITTED}",
        **TABLES,
    ),
)
def ingest_events(spark: SparkSession, sf: str) -> DataFrame:
    return ev(L.ingest(events(spark, sf), devices(spark, sf)))


@query("events_authorised", with_tables(f"SELECT {EV} FROM ev WHERE {_OK}", **TABLES))
def events_authorised(spark: SparkSession, sf: str) -> DataFrame:
    return ev(L.authorised(events(spark, sf), devices(spark, sf)))


@query("events_rejected", with_tables(f"SELECT {EV} FROM ev WHERE NOT {_OK}", **TABLES))
def events_rejected(spark: SparkSession, sf: str) -> DataFrame:
    return ev(L.rejected(events(spark, sf), devices(spark, sf)))


@query("org_scope", with_tables(f"SELECT {EV} FROM ev WHERE org_id IN (SELECT org_id FROM orgs)", **TABLES))
def org_scope(spark: SparkSession, sf: str) -> DataFrame:
    return ev(L.org_scope(events(spark, sf), orgs(spark, sf)))


@query(
    "events_latest",
    with_tables(f"SELECT {EV} FROM ev WHERE org_id = 'org2' ORDER BY received_at DESC, id LIMIT 100", **TABLES),
)
def events_latest(spark: SparkSession, sf: str) -> DataFrame:
    return ev(L.latest(events(spark, sf), "org2", 0))


@query(
    "events_by_verdict",
    with_tables(f"SELECT org_id, verdict, count(*) AS n FROM ev WHERE received_at >= {SINCE} GROUP BY 1, 2", **TABLES),
)
def events_by_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return L.verdict_counts(events(spark, sf), since())


@query(
    "verdict_board",
    with_tables(
        f"""SELECT org_id, count(*) FILTER (WHERE verdict = 'protected') AS protected, count(*) FILTER (WHERE verdict = 'runaway') AS runaway,
              count(*) FILTER (WHERE verdict = 'unknown') AS unknown FROM ev WHERE received_at >= {SINCE} GROUP BY 1""",
        **TABLES,
    ),
)
def verdict_board(spark: SparkSession, sf: str) -> DataFrame:
    return L.verdict_board(events(spark, sf), since())


@query(
    "events_windowed",
    with_tables(
        """SELECT w AS window_start, verdict, count(*) AS n FROM (
             SELECT verdict, unnest(generate_series(date_trunc('hour', received_at) - INTERVAL 23 HOUR, date_trunc('hour', received_at), INTERVAL 1 HOUR)) AS w FROM ev)
           GROUP BY 1, 2""",
        **TABLES,
    ),
)
def events_windowed(spark: SparkSession, sf: str) -> DataFrame:
    return L.sliding(L.panes(events(spark, sf), "received_at", ["verdict"]), ["verdict"])


@query(
    "device_last_seen",
    with_tables(
        f"""SELECT d.id, d.org_id, d.name, d.revoked, max(e.received_at) AS last_seen_at FROM devices d
            LEFT JOIN (SELECT * FROM ev WHERE {_OK}) e ON e.device_id = d.id GROUP BY 1, 2, 3, 4""",
        **TABLES,
    ),
)
def device_last_seen(spark: SparkSession, sf: str) -> DataFrame:
    return L.device_last_seen(devices(spark, sf), events(spark, sf))


@query(
    "device_state",
    with_tables(
        "SELECT device_id, arg_max(verdict, (received_at, id)) AS verdict, arg_max(tool, (received_at, id)) AS tool FROM ev GROUP BY 1",
        **TABLES,
    ),
)
def device_state(spark: SparkSession, sf: str) -> DataFrame:
    return L.current_state(events(spark, sf), "device_id", ["received_at", "id"], ["verdict", "tool"])


# --- change logs: entities made, revoked, seen and finished, folded field by field ----------------------

_ORG_LOG = """SELECT 'org' || r_regionkey AS id, 'create' AS change, TIMESTAMP '2023-01-05 00:00:00' - r_regionkey * INTERVAL 7 HOUR AS at, r_name AS name FROM region"""
_DEVICE_LOG = """SELECT 'dev' || c_custkey AS id, 'create' AS change, TIMESTAMP '2023-06-01 00:00:00' + (c_custkey * 37 % 9000) * INTERVAL 1 MINUTE AS at,
    'org' || c_custkey % 5 AS org_id, c_name AS name, false AS revoked, CAST(NULL AS TIMESTAMP) AS last_seen_at FROM customer
  UNION ALL SELECT 'dev' || c_custkey, 'revoke', TIMESTAMP '2024-01-15 00:00:00' + (c_custkey % 40) * INTERVAL 1 DAY, NULL, NULL, true, NULL FROM customer WHERE c_custkey % 7 = 0
  UNION ALL SELECT device_id, 'touch', received_at, NULL, NULL, NULL, received_at FROM ev"""
_TOKEN_LOG = """SELECT token_hash AS id, 'create' AS change, TIMESTAMP '1992-01-01 00:00:00' AS at, org_id, max_uses, false AS revoked FROM tokens
  UNION ALL SELECT token_hash, 'revoke', TIMESTAMP '1995-06-01 00:00:00', NULL, NULL, true FROM tokens WHERE revoked
  UNION ALL SELECT token_hash, 'use', attempted_at, NULL, NULL, NULL FROM attempts"""
_IMAGE_LOG = """SELECT 'img' || o_orderkey AS id, 'create' AS change, o_orderdate + (o_orderkey % 5) * INTERVAL 1 HOUR AS at, 'org' || o_custkey % 5 AS org_id, 'tag' || o_orderkey % 9 AS tag, '' AS ref, 'building' AS status FROM orders
  UNION ALL SELECT 'img' || o_orderkey, 'result', o_orderdate + (6 + o_orderkey % 3) * INTERVAL 1 HOUR, NULL, NULL, CASE WHEN o_orderkey % 4 = 1 THEN '' ELSE 'ref:' || o_orderkey END,
    CASE WHEN o_orderkey % 4 = 1 THEN 'failed' ELSE 'ready' END FROM orders WHERE o_orderkey % 4 <> 0
  UNION ALL SELECT 'img' || o_orderkey, 'result', o_orderdate - INTERVAL 1 DAY, NULL, NULL, 'too early', 'lost' FROM orders WHERE o_orderkey % 6 = 0"""


def _folded(log: str, fields: list[str], as_of: str | None = None, counts: dict[str, str] | None = None) -> str:
    """The fold of a log once more, as SQL."""
    when = f'AND "at" <= {as_of}' if as_of else ""
    last = ", ".join(f"arg_max({f}, ((change <> 'create'), \"at\", change)) FILTER (WHERE {f} IS NOT NULL) AS {f}" for f in fields)
    counted = "".join(f", count(*) FILTER (WHERE change = '{kind}') AS {name}" for name, kind in (counts or {}).items())
    return f"""SELECT id, created_at, {last}{counted} FROM {log} JOIN (SELECT id, min("at") AS created_at FROM {log} WHERE change = 'create' {when} GROUP BY 1) USING (id)
        WHERE "at" >= created_at {when} GROUP BY ALL"""


_NOW = f"TIMESTAMP '{NOW}'"
_LOGS = {**TABLES, "tokens": _TOKENS, "attempts": _ATTEMPTS, "org_log": _ORG_LOG, "device_log": _DEVICE_LOG, "token_log": _TOKEN_LOG, "image_log": _IMAGE_LOG}
DEVICE_FIELDS, TOKEN_FIELDS, IMAGE_FIELDS = ["org_id", "name", "revoked", "last_seen_at"], ["org_id", "max_uses", "revoked"], ["org_id", "tag", "ref", "status"]


def _after(base: str, number: F.Column, unit: str) -> F.Column:
    return F.lit(base).cast("timestamp_ntz") + F.make_interval(**{unit: number.cast("int")})


def org_log(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("r_regionkey")
    rows = read_table(spark, sf, "region").withColumn("id", F.concat(F.lit("org"), key.cast("string")))
    return C.change(rows, C.CREATE, "id", _after("2023-01-05 00:00:00", -7 * key, "hours"), {"name": F.col("r_name")})


def device_log(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    rows = read_table(spark, sf, "customer").withColumn("id", F.concat(F.lit("dev"), key.cast("string")))
    made = C.change(rows, C.CREATE, "id", _after("2023-06-01 00:00:00", key * 37 % 9000, "mins"), {"org_id": F.concat(F.lit("org"), (key % 5).cast("string")), "name": F.col("c_name"), "revoked": F.lit(False)})
    revoked = C.change(rows.where(key % 7 == 0), "revoke", "id", _after("2024-01-15 00:00:00", key % 40, "days"), {"revoked": F.lit(True)})
    return C.log(made, revoked, C.change(events(spark, sf), "touch", "device_id", F.col("received_at"), {"last_seen_at": F.col("received_at")}))


def token_log(spark: SparkSession, sf: str) -> DataFrame:
    rows = tokens(spark, sf)
    at = lambda text: F.lit(text).cast("timestamp_ntz")
    made = C.change(rows, C.CREATE, "token_hash", at("1992-01-01 00:00:00"), {"org_id": F.col("org_id"), "max_uses": F.col("max_uses"), "revoked": F.lit(False)})
    revoked = C.change(rows.where("revoked"), "revoke", "token_hash", at("1995-06-01 00:00:00"), {"revoked": F.lit(True)})
    return C.log(made, revoked, C.change(attempts(spark, sf), "use", "token_hash", F.col("attempted_at").cast("timestamp_ntz"), {}))


def image_log(spark: SparkSession, sf: str) -> DataFrame:
    key, at = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp_ntz")
    rows = read_table(spark, sf, "orders").withColumn("id", F.concat(F.lit("img"), key.cast("string")))
    hours = lambda n: at + F.make_interval(hours=n.cast("int"))
    made = C.change(rows, C.CREATE, "id", hours(key % 5), {"org_id": F.concat(F.lit("org"), (F.col("o_custkey") % 5).cast("string")), "tag": F.concat(F.lit("tag"), (key % 9).cast("string")), "ref": F.lit(""), "status": F.lit("building")})
    failed = key % 4 == 1
    result = C.change(rows.where(key % 4 != 0), "result", "id", hours(6 + key % 3), {"ref": F.when(failed, "").otherwise(F.concat(F.lit("ref:"), key.cast("string"))), "status": F.when(failed, "failed").otherwise("ready")})
    early = C.change(rows.where(key % 6 == 0), "result", "id", at - F.make_interval(days=F.lit(1)), {"ref": F.lit("too early"), "status": F.lit("lost")})
    return C.log(made, result, early)


@query("device_states", with_tables(f"SELECT * FROM ({_folded('device_log', DEVICE_FIELDS, _NOW)})", **_LOGS))
def device_states(spark: SparkSession, sf: str) -> DataFrame:
    """Devices as they stood at a time: enrolled, seen, revoked."""
    return C.fold(device_log(spark, sf), DEVICE_FIELDS, F.lit(NOW).cast("timestamp_ntz"))


@query("token_states", with_tables(f"SELECT * FROM ({_folded('token_log', TOKEN_FIELDS, counts={'used_count': 'use'})})", **_LOGS))
def token_states(spark: SparkSession, sf: str) -> DataFrame:
    return C.fold(token_log(spark, sf), TOKEN_FIELDS, counts={"used_count": "use"})


@query("image_states", with_tables(f"SELECT * FROM ({_folded('image_log', IMAGE_FIELDS)})", **_LOGS))
def image_states(spark: SparkSession, sf: str) -> DataFrame:
    return C.fold(image_log(spark, sf), IMAGE_FIELDS)


@query(
    "fleet_lists",
    with_tables(
        f"""SELECT 'orgs' AS list, '' AS org_id, id, row_number() OVER (ORDER BY created_at, id) AS place FROM ({_folded('org_log', ['name'])})
            UNION ALL SELECT 'devices', org_id, id, row_number() OVER (PARTITION BY org_id ORDER BY created_at, id) FROM ({_folded('device_log', DEVICE_FIELDS)})
            UNION ALL SELECT 'images', org_id, id, row_number() OVER (PARTITION BY org_id ORDER BY created_at DESC, id) FROM ({_folded('image_log', IMAGE_FIELDS)})""",
        **_LOGS,
    ),
)
def fleet_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Organisations as they were made, devices as they enrolled, images newest first, with their places."""
    orgs = C.fold(org_log(spark, sf), ["name"]).withColumn("org_id", F.lit(""))
    lists = {
        "orgs": C.listed(orgs, "org_id", ["created_at", "id"]),
        "devices": C.listed(C.fold(device_log(spark, sf), DEVICE_FIELDS), "org_id", ["created_at", "id"]),
        "images": C.listed(C.fold(image_log(spark, sf), IMAGE_FIELDS), "org_id", [F.desc("created_at"), "id"]),
    }
    rows = [df.select(F.lit(name).alias("list"), "org_id", "id", "place") for name, df in lists.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


_ENROL = {"tokens": _TOKENS, "attempts": _ATTEMPTS}


@query(
    "enroll_join",
    with_tables(
        "SELECT a.attempt_id, t.org_id, t.max_uses FROM attempts a JOIN tokens t USING (token_hash)", **_ENROL
    ),
)
def enroll_join(spark: SparkSession, sf: str) -> DataFrame:
    return attempts(spark, sf).join(tokens(spark, sf), "token_hash").select("attempt_id", "org_id", "max_uses")


@query(
    "enroll_admission",
    with_tables(
        """SELECT attempt_id, org_id, ok AND (max_uses = 0 OR row_number() OVER (PARTITION BY token_hash, ok ORDER BY attempted_at, attempt_id) <= max_uses) AS accepted
           FROM (SELECT a.*, t.org_id, t.max_uses, coalesce(NOT t.revoked AND a.attempted_at <= t.expires_at, false) AS ok FROM attempts a LEFT JOIN tokens t USING (token_hash))""",
        **_ENROL,
    ),
)
def enroll_admission(spark: SparkSession, sf: str) -> DataFrame:
    return L.admit(attempts(spark, sf), tokens(spark, sf)).select("attempt_id", "org_id", "accepted")


_POLICY = {"w": _WRITES, "orgs": _ORGS}


@query(
    "policy_versions",
    with_tables(
        "SELECT write_id, org_id, row_number() OVER (PARTITION BY org_id ORDER BY written_at, write_id) AS version FROM w", **_POLICY
    ),
)
def policy_versions(spark: SparkSession, sf: str) -> DataFrame:
    return L.policy_versions(writes(spark, sf)).select("write_id", "org_id", "version")


@query(
    "policy_effective",
    with_tables(
        f"""SELECT o.org_id, coalesce(c.bundle, {O.lit(L.SEED_POLICY)}) AS bundle, coalesce(c.version, 0) AS version
            FROM orgs o LEFT JOIN (SELECT org_id, arg_max(bundle, (written_at, write_id)) AS bundle, count(*) AS version FROM w GROUP BY 1) c USING (org_id)""",
        **_POLICY,
    ),
)
def policy_effective(spark: SparkSession, sf: str) -> DataFrame:
    return L.policy_effective(orgs(spark, sf), writes(spark, sf))


@query(
    "policy_canonical",
    with_tables(
        """SELECT write_id, '{"image":"img:' || write_id || '","mountMode":"bind","denylist":[],"version":' || row_number() OVER (PARTITION BY org_id ORDER BY written_at, write_id) || '}' AS bundle FROM w""",
        **_POLICY,
    ),
)
def policy_canonical(spark: SparkSession, sf: str) -> DataFrame:
    return L.policy_versions(writes(spark, sf)).select(
        "write_id", L.canonical_bundle(F.col("bundle"), F.col("version")).alias("bundle")
    )


# --- sessions: one process per event, written as the listing lines a host would give -------------------

COMMANDS = [
    "/usr/local/bin/claude --resume", "codex run fast", "/opt/Cursor/cursor", "bash -l", "aider --model x",
    "/bin/ls -la", "copilot-agent " + "x" * 250, "git status --short",
]
_IP = "'10.9.' || user_id % 5 || '.' || user_id % 3"
_SNAP = f"""SELECT event_id AS pid, user_id AS ppid, 'u' || user_id AS user_name, date_trunc('second', ts) AS started_at,
    ({O.words(COMMANDS)})[CAST(event_id % 8 AS INTEGER) + 1] AS command,
    user_id % 7 = 0 AS bound, CASE WHEN user_id % 3 = 0 THEN 'http://127.0.0.1:8080' ELSE '' END AS proxy_env,
    event_id % 5 IN (1, 2) AS direct, event_id % 5 IN (2, 3) AS via, {_IP} AS ip, user_id % 5 < 3 AS listed FROM events"""
_TOOL = """CASE WHEN starts_with(base, 'claude') THEN 'Claude Code' WHEN starts_with(base, 'codex') THEN 'OpenAI Codex' WHEN starts_with(base, 'cursor') THEN 'Cursor'
    WHEN starts_with(base, 'aider') THEN 'Aider' WHEN starts_with(base, 'copilot') THEN 'GitHub Copilot CLI' END"""
_SESS = f"""SELECT *, CASE WHEN bound THEN 'protected' WHEN proxy_env <> '' AND n = 0 THEN 'protected' WHEN via AND n = 0 THEN 'protected'
      WHEN n > 0 THEN 'runaway' ELSE 'unknown' END AS status,
    CASE WHEN bound THEN {O.lit(S.REASONS['bound'])} WHEN proxy_env <> '' AND n = 0 THEN {O.lit(S.REASONS['env'])} WHEN via AND n = 0 THEN {O.lit(S.REASONS['proxy'])}
      WHEN n > 0 THEN {O.lit(S.REASONS['direct'])} ELSE {O.lit(S.REASONS['none'])} END AS reason
    FROM (SELECT *, {_TOOL} AS tool, CAST(CASE WHEN direct AND listed THEN 1 ELSE 0 END AS INTEGER) AS n
          FROM (SELECT *, lower(regexp_extract(split_part(command, ' ', 1), '[^/]*$')) AS base FROM snap)) WHERE tool IS NOT NULL"""
SESSION_TABLES = {"snap": _SNAP, "sess": _SESS}


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    e = spread(read_table(spark, sf, "events").select("event_id", "user_id", "ts"))
    uid, eid = F.col("user_id"), F.col("event_id")
    ip = F.concat(F.lit("10.9."), (uid % 5).cast("string"), F.lit("."), (uid % 3).cast("string"))
    line = F.concat_ws(
        "  ",
        eid.cast("string"),
        uid.cast("string"),
        F.concat(F.lit("u"), uid.cast("string")),
        F.date_format("ts", "EEE MMM d HH:mm:ss yyyy"),
        F.element_at(F.array(*[F.lit(c) for c in COMMANDS]), (eid % 8 + 1).cast("int")),
    )
    env = F.concat(
        F.lit("PATH=/bin 9x=1 "),
        F.when(uid % 3 == 0, "http_proxy=http://127.0.0.1:8080 ").otherwise("HTTPS_PROXY= "),
        F.when(uid % 7 == 0, f"{S.BOUND_VARIABLE}=1").otherwise(""),
    )
    conns = F.concat(
        F.lit("COMMAND PID\n"),
        F.when((eid % 5).isin(1, 2), F.concat(F.lit("x 1 TCP 10.0.0.1:5000->"), ip, F.lit(":443 (ESTABLISHED)\n"))).otherwise(""),
        F.when((eid % 5).isin(2, 3), F.lit("x 1 TCP 10.0.0.1:5001->127.0.0.1:8080 (ESTABLISHED)\n")).otherwise(""),
    )
    return e.select(line.alias("line"), env.alias("env_text"), conns.alias("conn_text"))


def ip_table(spark: SparkSession, sf: str) -> DataFrame:
    regions = read_table(spark, sf, "region").where("r_regionkey < 3")
    return regions.select(F.explode(F.array(*[F.concat(F.lit("10.9."), F.col("r_regionkey").cast("string"), F.lit(f".{k}")) for k in range(3)])).alias("ip"))


def classified(spark: SparkSession, sf: str) -> DataFrame:
    return S.classify(S.process_lines(snapshots(spark, sf)), ip_table(spark, sf), "127.0.0.1:8080")


@query(
    "src_process_lines",
    with_tables("SELECT pid, ppid, user_name, started_at, command FROM snap", **SESSION_TABLES),
)
def src_process_lines(spark: SparkSession, sf: str) -> DataFrame:
    return S.process_lines(snapshots(spark, sf)).select(
        "pid", "ppid", F.col("user").alias("user_name"), F.col("started_at").cast("timestamp_ntz").alias("started_at"), "command"
    )


@query("session_tool", with_tables("SELECT pid, tool FROM sess", **SESSION_TABLES))
def session_tool(spark: SparkSession, sf: str) -> DataFrame:
    return classified(spark, sf).select("pid", "tool")


@query(
    "session_connections",
    with_tables("SELECT pid, via AS via_proxy, n AS direct_count, CASE WHEN n = 1 THEN ip || ':443' ELSE '' END AS direct FROM sess", **SESSION_TABLES),
)
def session_connections(spark: SparkSession, sf: str) -> DataFrame:
    return classified(spark, sf).select(
        "pid", "via_proxy", F.size("direct_ai_conn").alias("direct_count"), F.array_join("direct_ai_conn", ",").alias("direct")
    )


@query(
    "sessions_classified",
    with_tables(
        "SELECT pid, tool, status, reason, bound AS bound_flag, proxy_env, CASE WHEN length(command) > 240 THEN substr(command, 1, 240) || '…' ELSE command END AS command FROM sess",
        **SESSION_TABLES,
    ),
)
def sessions_classified(spark: SparkSession, sf: str) -> DataFrame:
    return classified(spark, sf).select("pid", "tool", "status", "reason", "bound_flag", "proxy_env", "command")


@query(
    "session_verdict",
    with_tables("SELECT status, reason, count(*) AS n FROM sess GROUP BY 1, 2", **SESSION_TABLES),
)
def session_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return classified(spark, sf).groupBy("status", "reason").agg(F.count("*").alias("n"))


@query(
    "sessions_ranked",
    with_tables(
        "SELECT pid, status, started_at FROM sess",
        **SESSION_TABLES,
    ),
)
def sessions_ranked(spark: SparkSession, sf: str) -> DataFrame:
    """All of them, with what they are ordered by; the order itself is checked in the tests."""
    return S.ranked(classified(spark, sf)).select("pid", "status", "started_at")


@query(
    "monitor_projection",
    with_tables(
        f"SELECT tool, status AS verdict, reason, n AS direct_conn_count, TIMESTAMP '{NOW}' AS observed_at FROM sess",
        **SESSION_TABLES,
    ),
)
def monitor_projection(spark: SparkSession, sf: str) -> DataFrame:
    return S.to_events(classified(spark, sf), F.lit(NOW).cast("timestamp_ntz"))


@query(
    "command_audit",
    with_tables("SELECT pid, split_part(command, ' ', 1) IN ('git', 'bash') AS allowed FROM snap", **SESSION_TABLES),
)
def command_audit(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.process_lines(snapshots(spark, sf)).select("pid", "command")
    return S.audit_commands(rows, ["bash"], ["git log"]).select("pid", "allowed")


_LOOK = """SELECT user_id AS snapshot, CASE WHEN event_id % 4 = 0 OR user_id % 10 = 0 THEN NULL ELSE '10.0.' || event_id % 6 || '.1' END AS ip FROM events"""


def lookups(spark: SparkSession, sf: str) -> DataFrame:
    eid = F.col("event_id")
    return read_table(spark, sf, "events").select(
        F.col("user_id").alias("snapshot"),
        F.when(~((eid % 4 == 0) | (F.col("user_id") % 10 == 0)), F.concat(F.lit("10.0."), (eid % 6).cast("string"), F.lit(".1"))).alias("ip"),
    )


@query("provider_ips", with_tables("SELECT DISTINCT snapshot, ip FROM look WHERE ip IS NOT NULL", look=_LOOK))
def provider_ips(spark: SparkSession, sf: str) -> DataFrame:
    return S.provider_ips(lookups(spark, sf))


@query("provider_lookups_failed", with_tables("SELECT snapshot, bool_and(ip IS NULL) AS failed FROM look GROUP BY 1", look=_LOOK))
def provider_lookups_failed(spark: SparkSession, sf: str) -> DataFrame:
    return S.all_failed(lookups(spark, sf))


@query(
    "ip_snapshot_changed",
    """WITH p AS (SELECT user_id AS pair, CASE WHEN event_id % 2 = 0 THEN 'old' ELSE 'new' END AS side, event_id % 3 AS ip FROM events)
       SELECT pair, list_sort(list(ip) FILTER (WHERE side = 'old')) IS DISTINCT FROM list_sort(list(ip) FILTER (WHERE side = 'new')) AS changed FROM p GROUP BY 1""",
)
def ip_snapshot_changed(spark: SparkSession, sf: str) -> DataFrame:
    eid = F.col("event_id")
    pairs = read_table(spark, sf, "events").select(
        F.col("user_id").alias("pair"), F.when(eid % 2 == 0, "old").otherwise("new").alias("side"), (eid % 3).alias("ip")
    )
    return S.snapshot_changed(pairs)


@query(
    "posture",
    """SELECT c_custkey AS user_id, k AS "check", CASE k WHEN 'proxy-on' THEN c_custkey % 2 = 0 WHEN 'all-layers' THEN c_custkey % 4 = 3
         WHEN 'sensitive-files' THEN c_custkey % 3 = 0 WHEN 'telemetry' THEN c_custkey % 5 = 0 WHEN 'safecmd' THEN c_custkey % 7 = 0 ELSE false END AS ok
       FROM customer, (VALUES ('proxy-on'), ('all-layers'), ('sensitive-files'), ('telemetry'), ('safecmd'), ('firewall')) v(k)""",
)
def posture(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    configs = read_table(spark, sf, "customer").select(
        key.alias("user_id"),
        (key % 2 == 0).alias("proxy_enabled"),
        (key % 4).cast("int").alias("layers_on"),
        F.when(key % 3 == 0, F.array(F.lit(".env"), F.lit(".pem"))).otherwise(F.array(F.lit(".env"))).alias("blocked_extensions"),
        F.when(key % 5 == 0, F.array(F.lit("Telemetry.Anthropic.com"))).otherwise(F.array(F.lit("x.y"))).alias("blocked_domains"),
        (key % 7 == 0).alias("hooks_enabled"),
    )
    return S.posture(configs)


@query(
    "posture_passing",
    """SELECT c_custkey AS user_id, CAST((c_custkey % 2 = 0)::INT + (c_custkey % 4 = 3)::INT + (c_custkey % 3 = 0)::INT + (c_custkey % 5 = 0)::INT + (c_custkey % 7 = 0)::INT AS BIGINT) AS passing,
         CAST(6 AS BIGINT) AS total FROM customer""",
)
def posture_passing(spark: SparkSession, sf: str) -> DataFrame:
    return S.passing(posture(spark, sf))
