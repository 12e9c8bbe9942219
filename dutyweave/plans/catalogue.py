"""Registered queries of the library and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dutyweave.plans import alternative_queries, binding_queries, classify_queries, condition_queries, containment_queries, context_queries, evidence_queries, fact_queries, guidance_queries, hierarchy_queries, layer_queries, level_queries, line_queries, paper_queries, requirement_queries, rule_queries, stream_queries, table_queries, text_queries

Query = Callable[[SparkSession, str], DataFrame]
GROUPS = (requirement_queries, text_queries, hierarchy_queries, classify_queries, fact_queries, table_queries, rule_queries, binding_queries, layer_queries, paper_queries, level_queries, stream_queries, containment_queries, alternative_queries, evidence_queries, line_queries, context_queries, condition_queries, guidance_queries)


def queries() -> dict[str, Query]:
    return {name: q for g in GROUPS for name, (q, _) in g.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for g in GROUPS for name, (_, sql) in g.QUERIES.items() if sql}
