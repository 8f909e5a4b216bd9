"""Queries of the token operators."""

from __future__ import annotations

from veilwright.llm import attribution, packing, wavelet
from veilwright.llm.registry import documents, query
from veilwright.sources.scratch import new_folder


@query("op4_token_id_output")
def token_id_output(spark, sf_dir):
    folder = new_folder(spark, "wavelet-shards")
    wavelet.write(documents(spark, sf_dir), folder)
    return wavelet.read(spark, folder)


@query("op5_token_counts")
def token_counts(spark, sf_dir):
    return attribution.attribute(documents(spark, sf_dir), ["doc_id"])


@query("op6_best_fit_packing")
def best_fit_packing(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir), ["doc_id"])
