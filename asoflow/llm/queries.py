"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: query name -> module that holds a function of that name, and for some an SQL text
_MODULES = {
    "op1_embedding_near_dedup": "vectors",
    "op2_quality": "quality",
    "op3_sentencepiece": "sentencepiece_bpe",
    "op4_language_id": "langid",
    "op5_warc_derivatives": "warc",
    "op6_ngram_jaccard_join": "jaccard",
    "op7_nearest_neighbours": "vectors",
    "op8_sharding": "sharding",
    "op9_mixing": "mixing",
    "op10_url_filter": "urls",
    "op11_substring_dedup": "substrings",
    "op12_tokenizer_alignment": "alignment",
    "op13_source_divergence": "divergence",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f"asoflow.llm.{module}"), name) for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {}
    for name, module in _MODULES.items():
        text = getattr(import_module(f"asoflow.llm.{module}"), "SQL", {}).get(name)
        if text:
            found[name] = text
    return found
