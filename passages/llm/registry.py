"""Queries of the training-data operators, by name, with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from passages.llm import (
    op1_url_filter,
    op2_quality_rules,
    op3_byte_bpe,
    op4_toxicity,
    op5_html_extraction,
    op6_token_counts,
    op7_embedding_dedup,
    op8_jaccard_join,
    op9_lm_scoring,
    op10_packing,
    op11_secret_scans,
    op12_alignment,
    op13_spelling_groups,
)

MODULES = (op1_url_filter, op2_quality_rules, op3_byte_bpe, op4_toxicity, op5_html_extraction, op6_token_counts, op7_embedding_dedup, op8_jaccard_join, op9_lm_scoring, op10_packing, op11_secret_scans, op12_alignment, op13_spelling_groups)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {m.NAME: m.query for m in MODULES}


def oracle_sql() -> dict[str, str]:
    return {m.NAME: m.ORACLE_SQL for m in MODULES if m.ORACLE_SQL is not None}
