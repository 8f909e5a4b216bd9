"""Decisions on hosts and paths of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Defaults of the configuration.
INTERCEPTED = (
    "api.anthropic.com", "api.openai.com", "api.githubcopilot.com", "copilot-proxy.githubusercontent.com",
)
BYPASS_RULES = ({"path": "/v1/models"}, {"prefix": "/.well-known/"}, {"method": "OPTIONS"})
KNOWN_DOMAINS = {
    "api.anthropic.com": "Claude / Claude Code",
    "api.openai.com": "OpenAI / ChatGPT",
    "api.githubcopilot.com": "GitHub Copilot",
    "copilot-proxy.githubusercontent.com": "GitHub Copilot Proxy",
    "generativelanguage.googleapis.com": "Google Gemini",
    "api.mistral.ai": "Mistral",
    "api.cohere.ai": "Cohere",
}


def bare_host(host: Column) -> Column:
    """Lower case, without port and brackets."""
    return F.regexp_replace(F.regexp_replace(F.lower(host), r":\d+$", ""), r"^\[|\]$", "")


def intercepted(requests: DataFrame, hosts: list[str]) -> DataFrame:
    return requests.where(bare_host(F.col("host")).isin(*[h.lower() for h in hosts]))


def decision(host: Column, intercept: list[str], blocked: list[str]) -> Column:
    """Blocked wins over intercepted."""
    name = bare_host(host)
    return (
        F.when(name.isin(*[h.lower() for h in blocked]), "reject")
        .when(name.isin(*[h.lower() for h in intercept]), "scan")
        .otherwise("pass")
    )


def bypass_reason(method: Column, path: Column, rules=BYPASS_RULES) -> Column:
    """Reason of the first rule in the list that matches, else empty."""
    out = None
    for rule in rules:
        tests = []
        if rule.get("method"):
            tests.append((F.upper(method) == rule["method"].upper(), "method_match"))
        if rule.get("path"):
            tests.append((path == rule["path"], "exact_match"))
        if rule.get("prefix"):
            tests.append((path.startswith(rule["prefix"]), "prefix_match"))
        for test, reason in tests:
            out = F.when(test, reason) if out is None else out.when(test, reason)
    return F.lit("") if out is None else out.otherwise("")


def domain_board(requests: DataFrame, intercept: list[str], blocked: list[str]) -> DataFrame:
    """Every known, configured or seen domain with its name and state."""
    seen = requests.select(bare_host(F.col("host")).alias("domain")).distinct()
    listed = sorted({*KNOWN_DOMAINS, *(h.lower() for h in intercept), *(h.lower() for h in blocked)})
    fixed = requests.sparkSession.createDataFrame([(d,) for d in listed], "domain string")
    names = F.create_map(*[F.lit(x) for pair in KNOWN_DOMAINS.items() for x in pair])
    state = (
        F.when(F.col("domain").isin(*[h.lower() for h in blocked]), "Blocked")
        .when(F.col("domain").isin(*[h.lower() for h in intercept]), "Scanning")
        .otherwise("Idle")
    )
    return (
        seen.unionByName(fixed)
        .distinct()
        .select("domain", F.coalesce(F.try_element_at(names, F.col("domain")), "domain").alias("name"), state.alias("state"))
    )
