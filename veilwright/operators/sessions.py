"""Snapshots of processes and their connections -> sessions with a verdict -> monitoring events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwright.functions.spans import settled
from veilwright.sources.scratch import written

# ---------------------------------------------------------------------------
# Tools by the start of their command, provider hosts, safe commands, check domains.
# ---------------------------------------------------------------------------
TOOLS = (
    ("claude", "Claude Code"), ("codex", "OpenAI Codex"), ("cursor", "Cursor"), ("windsurf", "Windsurf"),
    ("continue", "Continue"), ("aider", "Aider"), ("gemini", "Gemini CLI"), ("copilot", "GitHub Copilot CLI"),
)
PROVIDER_HOSTS = (
    "api.anthropic.com", "api.openai.com", "api.githubcopilot.com", "copilot-proxy.githubusercontent.com",
    "generativelanguage.googleapis.com", "api.mistral.ai", "api.cohere.ai",
)
PROXY_VARIABLES = ("HTTPS_PROXY", "https_proxy", "HTTP_PROXY", "http_proxy")
SAFE_COMMANDS = (
    "cat", "head", "tail", "less", "more", "bat", "ls", "tree", "locate", "grep", "rg", "ag", "ack", "fgrep",
    "egrep", "cut", "sort", "uniq", "wc", "tr", "column", "file", "stat", "du", "df", "which", "whereis", "type",
    "diff", "cmp", "comm", "date", "cal", "uptime", "whoami", "hostname", "uname", "printenv", "echo", "printf",
    "basename", "dirname", "realpath", "git blame", "git branch", "git diff", "git log", "git ls-files",
    "git remote", "git rev-parse", "git show", "git stash list", "git status", "git tag", "pwd", "find", "env",
)
TELEMETRY = (
    "telemetry.anthropic.com", "dc.services.visualstudio.com", "copilot-telemetry.githubusercontent.com",
    "browser-intake-datadoghq.com",
)
BOUND_VARIABLE = "SHIELD_BOUND"
REASONS = {
    "bound": "tagged as bound",
    "env": "HTTPS_PROXY points at the proxy",
    "proxy": "TCP connection to the proxy",
    "direct": "direct connection to AI provider — bypassing the proxy",
    "none": "no AI traffic observed yet",
}
EVENT_COLUMNS = ("tool", "verdict", "reason", "direct_conn_count", "observed_at")
# ---------------------------------------------------------------------------


def process_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """``pid ppid user, five words of start time, command`` -> columns; shorter lines are dropped."""
    words = F.split(F.regexp_replace(line, r"^\s+|\s+$", ""), r"\s+")
    start = F.array_join(F.slice("w", F.lit(5), F.lit(4)), " ")
    return (
        lines.withColumn("w", settled(words))
        .where((F.size("w") >= 9) & F.col("w")[0].rlike("^-?[0-9]+$"))
        .select(
            *[c for c in lines.columns if c != line],
            F.col("w")[0].cast("bigint").alias("pid"),
            F.col("w")[1].try_cast("bigint").alias("ppid"),
            F.col("w")[2].alias("user"),
            F.try_to_timestamp(start, F.lit("MMM d HH:mm:ss yyyy")).alias("started_at"),
            F.array_join(F.slice("w", F.lit(9), F.size("w")), " ").alias("command"),
        )
    )


def env_map(text: Column) -> Column:
    """``NAME=value`` words of an environment listing; a repeated name keeps its last value."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w.rlike("^[A-Za-z_][A-Za-z0-9_]*="))
    return F.transform(
        words, lambda w: F.struct(F.substring_index(w, "=", 1).alias("k"), F.regexp_replace(w, "^[^=]*=", "").alias("v"))
    )


def env_value(env: Column, name: str) -> Column:
    return F.try_element_at(F.filter(env, lambda e: e.k == name), F.lit(-1)).v


def connections(text: Column) -> Column:
    """Remote ends in a connection listing: what follows ``->`` in each line."""
    remote = F.regexp_extract_all(text, F.lit(r"->([^ \t\n]*)"), 1)
    return F.coalesce(remote, F.array().cast("array<string>"))


def host_of(address: Column) -> Column:
    """Part before the last colon, without brackets."""
    return F.when(address.rlike("^.+:"), F.regexp_replace(F.regexp_replace(address, ":[^:]*$", ""), r"^[\[\]]+|[\[\]]+$", "")).otherwise(address)


def port_of(address: Column) -> Column:
    return F.when(address.rlike("^.+:"), F.regexp_extract(address, "([^:]*)$", 1)).otherwise("")


def tool_of(command: Column) -> Column:
    """Tool by the base name of the first word; null when it is none."""
    name = F.lower(F.substring_index(F.substring_index(command, " ", 1), "/", -1))
    out = None
    for prefix, label in TOOLS:
        test = name.startswith(prefix)
        out = F.when(test, label) if out is None else out.when(test, label)
    return out


def shortened(command: Column, n: int = 240) -> Column:
    return F.when(F.length(command) > n, F.concat(F.substring(command, 1, n), F.lit("…"))).otherwise(command)


def verdict(bound: Column, env: Column, via: Column, direct: Column) -> Column:
    """Status and reason; the first case that holds decides."""
    def pair(status: str, reason: str) -> Column:
        return F.struct(F.lit(status).alias("status"), F.lit(REASONS[reason]).alias("reason"))

    return (
        F.when(bound, pair("protected", "bound"))
        .when(env & (direct == 0), pair("protected", "env"))
        .when(via & (direct == 0), pair("protected", "proxy"))
        .when(direct > 0, pair("runaway", "direct"))
        .otherwise(pair("unknown", "none"))
    )


def classify(snapshots: DataFrame, provider_ips: DataFrame, proxy: str, own_pid: int = -1) -> DataFrame:
    """Processes (pid, .., command, env_text, conn_text) -> sessions of known tools.

    ``provider_ips`` (ip) may be of any size: connections that could be direct become rows, are joined
    with the addresses, and come together again by a key of their process, in the order they had.
    """
    proxy_host, _, proxy_port = proxy.rpartition(":")
    local = ["127.0.0.1", "::1", "localhost", proxy_host.strip("[]")]
    known = (
        snapshots.withColumn("tool", tool_of(F.col("command")))
        .where(F.col("tool").isNotNull() & (F.col("pid") != own_pid))
        .withColumn("env", settled(env_map(F.col("env_text"))))
        .withColumn("connections", settled(connections(F.col("conn_text"))))
    )
    proxy_env = F.coalesce(*[F.nullif(env_value(F.col("env"), n), F.lit("")) for n in PROXY_VARIABLES])

    def to_proxy(c: Column) -> Column:
        return host_of(c).isin(*local) & (port_of(c) == proxy_port) & F.lit(bool(proxy_port))

    known = written(known.withColumn("row_key", F.monotonically_increasing_id()), "sessions-known")  # keys stay what they are
    open_ends = F.filter("connections", lambda c: ~to_proxy(c) & port_of(c).isin("443", "80"))
    ends = known.select("row_key", F.posexplode(open_ends).alias("at", "c")).withColumn("ip", host_of(F.col("c")))
    direct = (
        ends.join(provider_ips.select("ip").distinct(), "ip", "left_semi")
        .groupBy("row_key")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "c"))), lambda x: x.c).alias("direct"))
    )
    return (
        known.join(direct, "row_key", "left")
        .withColumn("proxy_env", settled(F.coalesce(proxy_env, F.lit(""))))
        .withColumn("has_proxy_env", F.col("proxy_env") != "")
        .withColumn("bound_flag", F.coalesce(env_value(F.col("env"), BOUND_VARIABLE) == "1", F.lit(False)))
        .withColumn("via_proxy", F.exists("connections", to_proxy))
        .withColumn("direct_ai_conn", settled(F.coalesce("direct", F.array().cast("array<string>"))))
        .withColumn(
            "v",
            verdict(F.col("bound_flag"), F.col("has_proxy_env"), F.col("via_proxy"), F.size("direct_ai_conn")),
        )
        .withColumn("status", F.col("v.status"))
        .withColumn("reason", F.col("v.reason"))
        .withColumn("command", shortened(F.col("command")))
        .drop("v", "row_key", "direct", "env", "env_text", "conn_text")
    )


def ranked(sessions: DataFrame) -> DataFrame:
    """Runaway first, then unknown, then protected; newest first."""
    rank = F.when(F.col("status") == "runaway", 0).when(F.col("status") == "unknown", 1).otherwise(2)
    return sessions.orderBy(rank, F.desc("started_at"), "pid")


def to_events(sessions: DataFrame, observed_at: Column) -> DataFrame:
    """All that may leave the machine: no command, address or environment value."""
    out = sessions.select(
        "tool",
        F.col("status").alias("verdict"),
        "reason",
        F.size("direct_ai_conn").alias("direct_conn_count"),
        observed_at.alias("observed_at"),
    )
    if tuple(out.columns) != EVENT_COLUMNS:
        raise AssertionError("a monitoring event holds exactly " + ", ".join(EVENT_COLUMNS))
    return out


# --- address sets and command lists --------------------------------------------------------------------


def provider_ips(lookups: DataFrame) -> DataFrame:
    """(snapshot, host, ip; ip null when the look-up failed) -> the set of addresses per snapshot."""
    return lookups.where("ip is not null").select("snapshot", "ip").distinct()


def all_failed(lookups: DataFrame) -> DataFrame:
    return lookups.groupBy("snapshot").agg(F.bool_and(F.col("ip").isNull()).alias("failed"))


def snapshot_changed(pairs: DataFrame) -> DataFrame:
    """(pair, side, ip): whether the two sides of a pair hold different addresses (with repeats)."""
    sign = F.when(F.col("side") == "old", 1).otherwise(-1)
    return (
        pairs.groupBy("pair", "ip")
        .agg(F.sum(sign).alias("d"))
        .groupBy("pair")
        .agg(F.bool_or(F.col("d") != 0).alias("changed"))
    )


def audit_commands(commands: DataFrame, added: list[str], removed: list[str], command: str = "command") -> DataFrame:
    """Add ``allowed``: the command, or its first words, is on the list of safe commands."""
    safe = sorted(({*SAFE_COMMANDS, *added}) - set(removed))
    words = F.split(command, " ")
    starts = [F.array_join(F.slice(words, F.lit(1), F.lit(k)), " ") for k in (1, 2, 3)]
    allowed = F.lit(False)
    for s in starts:
        allowed = allowed | s.isin(*safe)
    return commands.withColumn("allowed", allowed)


def posture(configs: DataFrame) -> DataFrame:
    """Six checks per configuration row, as rows (user_id, check, ok)."""
    blocked = F.transform("blocked_domains", lambda d: F.lower(d))
    checks = {
        "proxy-on": F.col("proxy_enabled"),
        "all-layers": F.col("layers_on") == 3,
        "sensitive-files": F.array_contains("blocked_extensions", ".env") & F.array_contains("blocked_extensions", ".pem"),
        "telemetry": F.arrays_overlap(blocked, F.array(*[F.lit(t) for t in TELEMETRY])),
        "safecmd": F.col("hooks_enabled"),
        "firewall": F.lit(False),
    }
    rows = F.array(*[F.struct(F.lit(n).alias("check"), c.alias("ok")) for n, c in checks.items()])
    return configs.select("user_id", F.explode(rows).alias("c")).select("user_id", "c.check", "c.ok")


def passing(checks: DataFrame) -> DataFrame:
    """How many of its checks each configuration passes, of how many."""
    return checks.groupBy("user_id").agg(F.count_if("ok").alias("passing"), F.count("*").alias("total"))
