"""Importing this module registers every query of the corpus operators."""

from veilwright.llm import archive_queries, conversation_queries, dedup_queries, filter_queries, language_queries, license_queries, shard_queries, token_queries  # noqa: F401
from veilwright.llm.registry import ORACLES, QUERIES  # noqa: F401
