"""Registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from dutyweave.llm import collision_search, exact_dedup, hard_negatives, language_id, mixing, ngram_join, packing, personal_data, piece_sampling, suffix_dedup, token_alignment
from dutyweave.llm import toxicity, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_collision_search": collision_search.op3_collision_search,
        "op4_mix_sources": mixing.op4_mix_sources,
        "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
        "op6_url_filter": url_filter.op6_url_filter,
        "op7_personal_data": personal_data.op7_personal_data,
        "op8_language_id": language_id.op8_language_id,
        "op9_ngram_join": ngram_join.op9_ngram_join,
        "op10_piece_sampling": piece_sampling.op10_piece_sampling,
        "op11_token_alignment": token_alignment.op11_token_alignment,
        "op12_packing": packing.op12_packing,
        "op13_hard_negatives": hard_negatives.op13_hard_negatives,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": exact_dedup.ORACLE,
        "op4_mix_sources": mixing.ORACLE,
        "op6_url_filter": url_filter.ORACLE,
        "op9_ngram_join": ngram_join.ORACLE,
        "op13_hard_negatives": hard_negatives.ORACLE,
    }
