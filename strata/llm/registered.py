"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from strata.llm import (decontaminate, jaccard_join, line_dedup, line_frequency, minhash_tensor, mixing, phrase_graph, quality_model, secrets,
                        spelling_variants, substring_dedup, token_files, toxicity)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_frequency": line_frequency.op1_line_frequency,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_repair_tokens": token_files.op4_repair_tokens,
    "op5_secrets": secrets.op5_secrets,
    "op6_mixing": mixing.op6_mixing,
    "op7_quality": quality_model.op7_quality,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_jaccard_join": jaccard_join.op10_jaccard_join,
    "op11_minhash_tensor": minhash_tensor.op11_minhash_tensor,
    "op12_spelling_variants": spelling_variants.op12_spelling_variants,
    "op13_phrase_graph": phrase_graph.op13_phrase_graph,
    "pipeline": corpus_pipeline.run,
}

SQL: dict[str, str] = {
    "op1_line_frequency": line_frequency.SQL,
    "op2_substring_dedup": substring_dedup.SQL,
    "op3_line_dedup": line_dedup.SQL,
    "op5_secrets": secrets.SQL,
    "op6_mixing": mixing.SQL,
    "op9_decontaminate": decontaminate.SQL,
    "op12_spelling_variants": spelling_variants.SQL,
    "op13_phrase_graph": phrase_graph.SQL,
}


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    return dict(SQL) | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
