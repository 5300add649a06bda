"""Names, queries and SQL of the corpus and vector operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexiloom import queries_models, queries_more, queries_study, queries_text, queries_vectors

_PARTS = (queries_text, queries_vectors, queries_study, queries_models, queries_more)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for p in _PARTS for k, v in p.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for p in _PARTS for k, v in p.oracle_sql().items()}
