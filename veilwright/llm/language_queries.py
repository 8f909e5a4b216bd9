"""Query of the language identification."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilwright.llm import langid
from veilwright.llm.registry import documents, query


@query("op2_language_id")
def language_id(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = langid.learn(docs.where(~langid.held_out(F.col("doc_id"))).select("lang", "text"))
    held = docs.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "text")
    return langid.predict(held, model, ["doc_id", "held_out"])
