"""Queries that run whole strategies over the source documents, for every question."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rankloom.operators import aggregates as A, graph as G, models as P
from rankloom.plans import strategies as R
from rankloom.plans.corpus_queries import _sources
from rankloom.plans.graph_queries import _entities, _members
from rankloom.plans.retrieval_queries import items
from rankloom.session import cut, table


def _items(spark: SparkSession, folder: str) -> DataFrame:
    return cut(items(spark, folder, None).withColumn("gold", F.lit(None).cast("array<string>")))


def _corpus(spark: SparkSession, folder: str) -> DataFrame:
    return _sources(spark, folder).where("text is not null")


def strategy_baseline(spark: SparkSession, folder: str) -> DataFrame:
    """STR-1: dense search over fixed windows, evaluated."""
    ix = R.index(_corpus(spark, folder), "fixed")
    return R.run(_items(spark, folder), lambda q: R.baseline(q, ix), ix, "baseline")


def strategy_advanced(spark: SparkSession, folder: str) -> DataFrame:
    """STR-2: hybrid search with rewriting and reranking, evaluated."""
    ix = R.index(_corpus(spark, folder), "structural")
    return R.run(_items(spark, folder), lambda q: R.advanced(q, ix), ix, "advanced")


def strategy_advanced_pro(spark: SparkSession, folder: str) -> DataFrame:
    """STR-3, JN-7, SRT-7: routed search over contextual chunks, evaluated."""
    ix = R.index(_corpus(spark, folder), "contextual")
    return R.run(_items(spark, folder), lambda q: R.advanced_pro(q, ix), ix, "advanced-pro")


def strategy_graphrag(spark: SparkSession, folder: str) -> DataFrame:
    """STR-4, GRF-8, GRF-11: graph search fused with dense and BM25, evaluated."""
    ix = R.index(_corpus(spark, folder), "structural")
    names = cut(_entities(spark, folder))
    units = cut(G.mentions(ix.chunks.select(F.col("doc_id").alias("unit"), "text"), names).select("entity", "unit").distinct())
    lead = _members(spark, folder).where("nth = 0").select("community", F.col("entity").alias("source"))
    near = cut(G.adjacency(_members(spark, folder).where("nth > 0").select("community", F.col("entity").alias("target")).join(lead, "community").where("source <> target")))
    return R.run(_items(spark, folder), lambda q: R.graphrag(q, ix, names, near, units), ix, "graphrag")


def strategy_scores(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-1, AGG-3: a strategy's run summarised."""
    return A.summary(strategy_baseline(spark, folder))


def query_plans(spark: SparkSession, folder: str) -> DataFrame:
    """PRJ-12, PRJ-13, MDL-4: the queries asked for each question, those without a position included."""
    q = items(spark, folder, None).select(F.col("item_id").alias("query_id"), F.col("question").alias("text"))
    return R.query_plan(q)


def routes(spark: SparkSession, folder: str) -> DataFrame:
    """PRJ-13: routes as a model may give them, made valid."""
    e = table(spark, folder, "events")
    k = F.when(F.col("event_id") % 4 == 0, F.lit(None)).otherwise(F.col("value") / 20)
    r = P.normal_route(F.when(F.col("event_type") == "view", "broad").when(F.col("event_type") == "click", "multi_hop").otherwise(F.col("event_type")), k)
    return e.select("event_id", r.alias("r")).select("event_id", "r.category", "r.k")


QUERIES = {f.__name__: f for f in (strategy_baseline, strategy_advanced, strategy_advanced_pro, strategy_graphrag, strategy_scores, query_plans, routes)}
SQL = {
    "routes": "select event_id, case event_type when 'view' then 'broad' when 'click' then 'multi_hop' else 'specific' end as category, case when event_id % 4 = 0 or value is null then 5 else least(5, greatest(3, floor(value / 20 + 0.5))) end::int as k from events",
}
