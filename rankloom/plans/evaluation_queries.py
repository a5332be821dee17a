"""Queries on evaluation results: the answers as given, with tokens, cost and scores taken from their rows.

answer_responses has no judged scores; those used here are fixed functions of its keys, so that both sides compute them alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rankloom.functions import vectors as V
from rankloom.functions.text import WS, trim_all
from rankloom.operators import aggregates as A
from rankloom.session import latest, table

ORDER = ["advanced", "baseline", "graphrag", "advanced-pro"]


def results(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each answer, delivered twice or not."""
    said = latest(table(spark, folder, "answer_responses").select("answer_id", "loaded_at", "item_id", "strategy", "question", "answer", "truncated", "latency_ms"), ["answer_id"], ["loaded_at"])
    asked = latest(table(spark, folder, "evaluation_items").select("id", "loaded_at", "question_type", "reference_answer"), ["id"], ["loaded_at"]).select(F.col("id").alias("item_id"), "question_type", "reference_answer")
    i = F.col("answer_id")
    rows = said.join(asked, "item_id", "left").select(
        "strategy", "item_id", i.alias("pos"), F.coalesce("question_type", F.lit("other")).alias("question_type"), F.when(F.coalesce(trim_all(F.col("answer")), F.lit("")) == "", "no answer").alias("error"), "question", "answer", "reference_answer",
        (i % 11 / 10).alias("ndcg"), (i % 7 / 6).alias("recall"), (i % 5 / 4).alias("context_precision"), (i % 13 / 12).alias("faithfulness"), (i % 3 / 2).alias("factual_correctness"), (i % 9 / 8).alias("answer_relevance"),
        F.when(i % 4 == 0, "fail").when(i % 4 == 1, "partial").otherwise("pass").alias("verdict"), F.when(F.col("latency_ms") > 0, F.col("latency_ms")).alias("latency_ms"), F.col("truncated").alias("flag"),
        (F.length("question") * 10).cast("long").alias("input_tokens"), F.length("question").cast("long").alias("cached_tokens"), F.coalesce(F.length("answer"), F.lit(0)).cast("long").alias("output_tokens"),
        F.when(i % 2 == 0, "gpt-5-mini").otherwise("gpt-5-nano-2025-08-07").alias("model"), F.element_at(F.array(*[F.lit(s) for s in A.STAGES]), (i % 7 + 1).cast("int")).alias("stage"),
    )
    return rows.withColumn("cost", V.call_cost(F.col("model"), F.col("input_tokens"), F.col("cached_tokens"), F.col("output_tokens")))


def strategy_summary(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-1, AGG-3, AGG-5: counts, mean metrics, composite score and verdicts by strategy."""
    return A.summary(results(spark, folder))


def question_type_summary(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-2: means by strategy and question type."""
    return A.by_type(results(spark, folder))


def latency_distribution(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-4, MTH-2, MTH-3: latencies by strategy."""
    return A.latency(results(spark, folder), ["latency_ms"])


def usage_by_stage(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-6: usage by strategy, in all and by stage."""
    used = A.usage(results(spark, folder), ["strategy"])
    return used.select(*[c for c in used.columns if not c.endswith("_by_stage")], F.explode("tokens_by_stage").alias("stage", "stage_tokens"))


def usage_per_question(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-7: usage divided by the questions."""
    r = results(spark, folder)
    return A.per_question(A.usage(r, ["strategy"]), r.groupBy("strategy").agg(F.count("*").alias("questions")), "strategy")


def run_totals(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-8: cost and time of all."""
    return results(spark, folder).agg(F.round(F.sum("cost"), 9).alias("cost"), F.sum("latency_ms").alias("ms"), F.count("*").alias("n"))


def counts_by_type(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-9: questions by type."""
    return A.counts(results(spark, folder), "question_type", "pos")


def cost_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-14: cost by stage."""
    return A.cost_breakdown(A.usage(results(spark, folder), ["strategy"]), "strategy")


def _summaries(spark: SparkSession, folder: str) -> DataFrame:
    r = results(spark, folder)
    return A.summary(r).join(r.groupBy("strategy").agg(F.round(F.avg("cost"), 12).alias("cost")), "strategy")


def tradeoff_table(spark: SparkSession, folder: str) -> DataFrame:
    """JN-14: the best and the cheapest strategy."""
    return A.tradeoff(_summaries(spark, folder))


def ndcg_pivot(spark: SparkSession, folder: str) -> DataFrame:
    """JN-15: nDCG by question type with a column a strategy."""
    return A.pivot_by_type(A.by_type(results(spark, folder)), "ndcg", ORDER).select("question_type", *[F.col(f"`{s}`").alias(s.replace("-", "_")) for s in ORDER])


def delta_vs_first(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-17, JN-16, MTH-6: changes against the first strategy of the selection."""
    return A.deltas(_summaries(spark, folder), ORDER)


def chart_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-15: metrics by strategy as rows."""
    return A.unpivoted(_summaries(spark, folder), "strategy")


def explorer(spark: SparkSession, folder: str) -> DataFrame:
    """PRJ-10, SNK-7: passed answers of a strategy that speak of the office."""
    return A.explore(results(spark, folder), "pass", "advanced", "OFFICE").select("pos", "item_id", "question_type")


def latest_eight(spark: SparkSession, folder: str) -> DataFrame:
    """SRT-5: the last eight answers, newest first."""
    return results(spark, folder).orderBy(F.desc("pos")).limit(8).select("pos", "strategy", "item_id")


def collated_titles(spark: SparkSession, folder: str) -> DataFrame:
    """SRT-6: titles in the order of a dictionary, each with its place."""
    from pyspark.sql import Window

    t = table(spark, folder, "source_documents").where("category is not null").select(F.lower(F.col("category")).alias("category")).distinct()
    return t.select("category", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.collate("category", "UNICODE"))).alias("place"))


def provenance(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-16: the best rank of each source, of answers read as hits."""
    r = results(spark, folder).where("item_id is not null").select(F.col("item_id").alias("query_id"), (F.col("pos") % 5).alias("doc_id"), F.col("strategy").alias("source"), (F.col("pos") % 17 + 1).alias("rank"))
    return A.best_source(r)


def judge_replies(spark: SparkSession, folder: str) -> DataFrame:
    """PRJ-14: replies of a judge with scores out of range and verdicts unknown."""
    r = results(spark, folder).select("pos", "answer", (F.col("pos") % 17 / 10 - 0.3).alias("score"), F.when(F.col("pos") % 3 == 0, " PASS").when(F.col("pos") % 3 == 1, "great").alias("verdict"))
    return A.judge_normal(r).select("pos", F.round("score", 6).alias("score"), "verdict")


QUERIES = {
    f.__name__: f
    for f in (
        strategy_summary, question_type_summary, latency_distribution, usage_by_stage, usage_per_question, run_totals, counts_by_type, cost_breakdown, tradeoff_table, ndcg_pivot, delta_vs_first, chart_metrics, explorer, latest_eight,
        collated_titles, provenance, judge_replies,
    )
}

_STAGES = "[" + ", ".join(f"'{s}'" for s in A.STAGES) + "]"
RESULTS = f"""said as (select * from answer_responses qualify row_number() over (partition by answer_id order by loaded_at desc) = 1), asked as (select id, question_type, reference_answer from evaluation_items qualify row_number() over (partition by id order by loaded_at desc) = 1),
    r0 as (select strategy, item_id, answer_id as pos, coalesce(question_type, 'other') as question_type, case when coalesce(regexp_replace(answer, '^[{WS}]+|[{WS}]+$', '', 'g'), '') = '' then 'no answer' end as error, question, answer, reference_answer, answer_id % 11 / 10 as ndcg, answer_id % 7 / 6 as recall, answer_id % 5 / 4 as context_precision,
    answer_id % 13 / 12 as faithfulness, answer_id % 3 / 2 as factual_correctness, answer_id % 9 / 8 as answer_relevance, case answer_id % 4 when 0 then 'fail' when 1 then 'partial' else 'pass' end as verdict, case when latency_ms > 0 then latency_ms end as latency_ms, length(question) * 10 as input_tokens,
    length(question) as cached_tokens, coalesce(length(answer), 0) as output_tokens, answer_id % 2 = 0 as mini, {_STAGES}[answer_id % 7 + 1] as stage from said left join asked on said.item_id = asked.id),
    r as (select *, (greatest(0, input_tokens - cached_tokens) * if(mini, 0.25, 0.05)::double + cached_tokens * if(mini, 0.025, 0.005)::double + output_tokens * if(mini, 2, 0.4)::double) / 1e6 as cost from r0)"""
_MEANS = ", ".join(f"round(coalesce(avg({m}) filter (error is null), 0), 9) as {m}" for m in A.METRICS)
_COMPOSITE = "round((" + " + ".join(f"coalesce(avg({m}) filter (error is null), 0) * {w}::double" for m, w in A.WEIGHTS.items()) + ") * count(*) filter (error is null) / count(*), 9)"
_SUMMARY = f"""sm as (select strategy, count(*) as questions, count(*) filter (error is not null) as failures, {_MEANS}, {_COMPOSITE} as composite, count(*) filter (error is null and verdict = 'pass') as passed, count(*) filter (error is null and verdict = 'partial') as partial,
    count(*) filter (error is not null or verdict = 'fail') as failed, round(avg(cost), 12) as cost from r group by 1)"""
_BY_TYPE = f"""bt as (select strategy, question_type, count(*) as n, {', '.join(f'round(avg({m}), 9) as {m}' for m in A.METRICS)}, round(avg(input_tokens), 6) as input_tokens, round(avg(output_tokens), 6) as output_tokens, round(avg(cost), 12) as cost, round(avg(latency_ms), 6) as latency_ms,
    row_number() over (partition by strategy order by count(*) desc, min(pos), question_type)::int as place from r where error is null group by 1, 2)"""
_VALUES = ", ".join(f"('{s}', {i + 1})" for i, s in enumerate(ORDER))

SQL = {
    "strategy_summary": f"with {RESULTS}, {_SUMMARY} select * exclude (cost) from sm",
    "question_type_summary": f"with {RESULTS}, {_BY_TYPE} select * from bt",
    "latency_distribution": f"""with {RESULTS}, v as (select strategy, case when error is null then latency_ms end::double as ms from r) select strategy, 'latency_ms' as phase, round(coalesce(avg(ms), 0), 6) as mean, round(coalesce(quantile_cont(ms, 0.5), 0), 6) as median, round(coalesce(quantile_cont(ms, 0.95), 0), 6) as p95,
        round(coalesce(min(ms), 0), 6) as min, round(coalesce(max(ms), 0), 6) as max, round(coalesce(stddev_pop(ms), 0), 6) as std_dev, count(ms) as n from v group by 1""",
    "usage_by_stage": f"""with {RESULTS}, t as (select strategy, sum(input_tokens)::bigint as input_tokens, sum(cached_tokens)::bigint as cached_tokens, sum(output_tokens)::bigint as output_tokens, coalesce(sum(input_tokens) filter (stage = 'embedding'), 0)::bigint as embedding_tokens,
        sum(input_tokens + output_tokens)::bigint as total_tokens, round(sum(cost), 9) as cost, count(*) as calls from r group by 1), s as (select unnest({_STAGES}) as stage)
        select t.*, s.stage, coalesce((select sum(input_tokens + output_tokens) from r where r.strategy = t.strategy and r.stage = s.stage), 0)::bigint as stage_tokens from t, s""",
    "usage_per_question": f"with {RESULTS} select strategy, round(sum(input_tokens) / count(*), 9) as input_tokens, round(sum(output_tokens) / count(*), 9) as output_tokens, round(sum(input_tokens + output_tokens) / count(*), 9) as total_tokens, round(round(sum(cost), 9) / count(*), 9) as cost from r group by 1",
    "run_totals": f"with {RESULTS} select round(sum(cost), 9) as cost, sum(latency_ms)::bigint as ms, count(*) as n from r",
    "counts_by_type": f"with {RESULTS} select question_type, count(*) as n, row_number() over (order by count(*) desc, min(pos))::int as place from r group by 1",
    "cost_breakdown": f"with {RESULTS} select strategy, stage, round(sum(cost), 9) as cost, row_number() over (partition by strategy order by round(sum(cost), 9) desc, stage)::int as place from r where stage <> 'dataset-generation' group by 1, 2 having sum(cost) > 0",
    "tradeoff_table": f"with {RESULTS}, {_SUMMARY}, b as (select (select strategy from sm order by composite desc, strategy limit 1) as best, (select strategy from sm order by cost, strategy limit 1) as cheap) select strategy, composite, cost, strategy = best as is_best, strategy = cheap and cheap <> best as is_cheapest from sm, b",
    "ndcg_pivot": f"with {RESULTS}, {_BY_TYPE} select question_type, {', '.join(f'''coalesce(max(ndcg) filter (strategy = '{s}'), 0) as {s.replace('-', '_')}''' for s in ORDER)} from bt group by 1",
    "delta_vs_first": f"with {RESULTS}, {_SUMMARY}, o(strategy, nth) as (values {_VALUES}), f as (select * from sm where strategy = '{ORDER[0]}') select sm.strategy, nth::int as nth, {', '.join(f'round((sm.{m} - f.{m}) / nullif(f.{m}, 0), 6) as {m}' for m in [*A.METRICS, 'composite'])} from sm join o on o.strategy = sm.strategy, f",
    "chart_metrics": f"with {RESULTS}, {_SUMMARY} select strategy, metric, value from (unpivot (select strategy, {', '.join(A.METRICS)} from sm) on {', '.join(A.METRICS)} into name metric value value)",
    "explorer": f"with {RESULTS} select pos, item_id, question_type from r where verdict = 'pass' and strategy = 'advanced' and (contains(lower(question), 'office') or contains(lower(answer), 'office') or contains(lower(reference_answer), 'office'))",
    "latest_eight": f"with {RESULTS} select pos, strategy, item_id from r order by pos desc limit 8",
    "collated_titles": "select category, row_number() over (order by category)::int as place from (select distinct lower(category) as category from source_documents where category is not null)",
    "provenance": f"with {RESULTS} select item_id as query_id, pos % 5 as doc_id, strategy as source, min(pos % 17 + 1) as rank from r where item_id is not null group by 1, 2, 3",
    "judge_replies": f"""with {RESULTS}, j as (select pos, coalesce(regexp_replace(answer, '^[{WS}]+|[{WS}]+$', '', 'g'), '') = '' as blank, least(1, greatest(0, pos % 17 / 10 - 0.3)) as score, pos % 3 as v from r) select pos, round(case when blank then 0 else score end, 6)::double as score,
        case when blank then 'fail' when v = 0 then 'pass' when score >= 0.75 then 'pass' when score >= 0.4 then 'partial' else 'fail' end as verdict from j""",
}
