"""Query of the near duplicates."""

from __future__ import annotations

from veilwright.llm import neardup
from veilwright.llm.registry import documents, query


@query("op7_minhash_near_dedup")
def minhash_near_dedup(spark, sf_dir):
    return neardup.near_duplicate_classes(documents(spark, sf_dir))[0].select("id", "class_id").withColumnRenamed("id", "doc_id")
