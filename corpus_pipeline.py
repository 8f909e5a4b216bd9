"""Corpus pipeline: quality rules, near duplicates, decontamination, secrets, packing."""

from __future__ import annotations

from veilwright.llm import decontaminate, neardup, packing, quality, secrets
from veilwright.sources.scratch import written
from veilwright.sources.tables import read_table


def quality_stage(spark, docs, sf_dir):
    """Documents that no quality rule rejects."""
    return quality.keep_good(docs)


def neardup_stage(spark, docs, sf_dir):
    """One document of each group of near duplicates."""
    return neardup.keep_one(docs)


def decontaminate_stage(spark, docs, sf_dir):
    """Documents that hold no benchmark passage of weight."""
    return decontaminate.annotate(docs, read_table(spark, sf_dir, "benchmark"), docs.columns, drop=True)


def secrets_stage(spark, docs, sf_dir):
    """The documents with their secrets masked."""
    return secrets.masked(docs)


def packing_stage(spark, docs, sf_dir):
    """Where each piece of each document lies in the packed sequences."""
    return packing.pack(docs, ["doc_id"])


STAGES = [
    ("quality_rules", quality_stage),
    ("minhash_near_dedup", neardup_stage),
    ("benchmark_decontamination", decontaminate_stage),
    ("secret_scans", secrets_stage),
    ("best_fit_packing", packing_stage),
]

#: Near-duplicate classes and tokens are beyond SQL; tests/llm has the brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``, each one's rows written and read by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
