"""All registered queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from burstloom.plans import burst_queries, eval_queries, event_queries, ngram_queries, packed_queries, text_queries, window_queries

_MODULES = (packed_queries, burst_queries, text_queries, ngram_queries, window_queries, event_queries, eval_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in getattr(m, "SQL", {}).items()}
