"""All queries of the layout engine by name, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliospark.plans import document_queries, font_queries, geometry_queries, page_queries, table_queries, text_queries

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = (document_queries, page_queries, text_queries, font_queries, geometry_queries, table_queries)


def queries() -> dict[str, Query]:
    return {name: q for m in _MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files made from the documents, extracted, judged and counted by language and verdict."""
    return document_queries.verdict_report(spark, sf_dir)
