"""The registered queries of the core, and for each the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rankloom.plans import corpus_queries, evaluation_queries, graph_queries, ingest_queries, more_queries, retrieval_queries, store_queries, strategy_queries, stream_queries, text_queries

MODULES = [retrieval_queries, evaluation_queries, graph_queries, corpus_queries, strategy_queries, stream_queries, more_queries, text_queries, ingest_queries, store_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
