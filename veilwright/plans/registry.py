"""Names of the checked queries: a Spark job each and, where SQL can say it, the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


def with_tables(select: str, **relations: str) -> str:
    """``WITH`` clause from named relations, in the order given; each is computed once."""
    parts = ", ".join(f"{name} AS MATERIALIZED ({sql})" for name, sql in relations.items())
    return f"WITH {parts} {select}"
