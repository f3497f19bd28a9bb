"""All queries of the library and their DuckDB counterparts, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.plans import aligned_queries, exchange_queries, extension_queries, form_queries, model_queries, page_model_queries, page_queries, reading_queries, record_queries, scalar_queries, table_queries, text_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _area in (text_queries, aligned_queries, page_queries, scalar_queries, record_queries, model_queries, exchange_queries, reading_queries, table_queries, form_queries, page_model_queries, extension_queries):
    QUERIES |= _area.QUERIES
    ORACLE_SQL |= _area.ORACLE_SQL
