"""Every checked query against the other engine, on the smallest tables."""

import pytest
from conftest import SMALL
from oracle import compare, connect
from veilwright.plans.all_queries import ORACLES, QUERIES
from veilwright.sources.patterns import PATTERNS

# The queries of single rules are parts of detect_extended.
PARTS = {f"detect_{p.rule_id}" for p in PATTERNS}


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in PARTS])
def test_query(spark, con, name):
    difference, _, _ = compare(QUERIES[name](spark, SMALL), con, ORACLES[name])
    assert difference == ""
