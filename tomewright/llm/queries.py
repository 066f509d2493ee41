"""Queries of the numbered operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tomewright.llm import decontaminate, exact, language, lines, mixing, near, passages, secrets, spelling, tokens, toxicity, urls, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": lines.query,
    "op2_language_id": language.query,
    "op3_secret_scan": secrets.query,
    "op4_token_counts": tokens.query,
    "op5_near_dedup": near.query,
    "op6_source_mixing": mixing.query,
    "op7_url_filter": urls.query,
    "op8_decontamination": decontaminate.query,
    "op9_substring_dedup": passages.query,
    "op10_exact_dedup": exact.query,
    "op11_spelling_variants": spelling.query,
    "op12_embedding_whitening": whitening.query,
    "op13_toxicity": toxicity.query,
}
SQL: dict[str, str] = {
    "op1_line_dedup": lines.SQL,
    "op8_decontamination": decontaminate.SQL,
    "op9_substring_dedup": passages.SQL,
    "op10_exact_dedup": exact.SQL,
}
