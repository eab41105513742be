"""All queries of the library by name, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import candidates, catalogs, chunks, documents, extractions, layers, mentions, metrics, pipelines, records, recovery, recursive, relations, results, scores, smart, stores, windows  # noqa: F401
from .registry import QUERIES, SQL

SQL |= {"extract_unified": extractions.UNIFIED_SQL, "extract_chunked": extractions.CHUNKED_SQL} | recursive.SQL


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
