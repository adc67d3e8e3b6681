"""Queries of the llm operators by name, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from foliospark.llm import op01_quality, op02_language, op03_jaccard, op04_token_output, op05_lm, op06_decontaminate, op07_urls, op08_toxicity, op09_packing, op10_secrets

_MODULES = (op01_quality, op02_language, op03_jaccard, op04_token_output, op05_lm, op06_decontaminate, op07_urls, op08_toxicity, op09_packing, op10_secrets)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for m in _MODULES for name, query in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
