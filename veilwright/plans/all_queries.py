"""Importing this module registers every query."""

from veilwright.plans import eval_queries, fleet_queries, model_queries, report_queries, request_queries, stream_queries, text_queries  # noqa: F401
from veilwright.plans.registry import ORACLES, QUERIES  # noqa: F401
