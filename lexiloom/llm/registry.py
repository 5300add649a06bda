"""The opN_ queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexiloom.llm import html_layout, importance_resampling, language_id, license_scan, mixing, near_dedup, passage_dedup, quality_rules, sentencepiece_codec, substring_dedup, topk_search


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_importance_resampling": importance_resampling.query,
        "op2_topk_search": topk_search.query,
        "op3_quality_rules": quality_rules.query,
        "op4_near_dedup": near_dedup.query,
        "op5_sentencepiece": sentencepiece_codec.query,
        "op6_mixing": mixing.query,
        "op7_passage_dedup": passage_dedup.query,
        "op7_substring_dedup": substring_dedup.query,
        "op8_language_id": language_id.query,
        "op9_html_layout": html_layout.query,
        "op10_license_scan": license_scan.query,
        "op10_license_runs": license_scan.query_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_topk_search": topk_search.oracle(),
        "op3_quality_rules": quality_rules.oracle(),
        "op6_mixing": mixing.oracle(),
        "op7_substring_dedup": substring_dedup.oracle(),
        "op10_license_scan": license_scan.oracle(),
    }
