"""Summaries of evaluated questions: means, composite score, latencies, verdicts, usage and cost.

Results have one row for each strategy and question: strategy, item_id, pos, question_type, error (null: succeeded), the
metrics named in METRICS, verdict, latency columns, input_tokens, cached_tokens, output_tokens, model, stage and cost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

METRICS = ["ndcg", "recall", "context_precision", "faithfulness", "factual_correctness", "answer_relevance"]
# What each metric counts in the composite score.
WEIGHTS = {"ndcg": 0.2, "recall": 0.15, "context_precision": 0.15, "faithfulness": 0.2, "factual_correctness": 0.2, "answer_relevance": 0.1}
# The stages under which usage is kept.
STAGES = ["embedding", "query-transform", "rerank", "graph", "answer", "judge", "dataset-generation"]



def _ok() -> Column:
    return F.col("error").isNull()


def mean_or_zero(c: Column, digits: int = 9) -> Column:
    """The mean over succeeded rows, 0 if there are none."""
    return F.round(F.coalesce(F.avg(F.when(_ok(), c)), F.lit(0.0)), digits)


def composite() -> Column:
    """The weighted metrics times the share of questions that succeeded, as an aggregate."""
    raw = sum((F.coalesce(F.avg(F.when(_ok(), F.col(m))), F.lit(0.0)) * w for m, w in WEIGHTS.items()), F.lit(0.0))
    return F.round(raw * F.count_if(_ok()) / F.count("*"), 9)


def summary(results: DataFrame) -> DataFrame:
    """One row for each strategy: counts, mean metrics, composite score, verdicts."""
    fails = F.count_if(~_ok())
    return results.groupBy("strategy").agg(
        F.count("*").alias("questions"), fails.alias("failures"), *[mean_or_zero(F.col(m)).alias(m) for m in METRICS], composite().alias("composite"), *verdicts()
    )


def verdicts() -> list[Column]:
    """Counts of verdicts; a question that failed counts as fail."""
    say = lambda v: F.count_if(_ok() & (F.col("verdict") == v))
    return [say("pass").alias("passed"), say("partial").alias("partial"), (say("fail") + F.count_if(~_ok())).alias("failed")]


def by_type(results: DataFrame) -> DataFrame:
    """Means by strategy and question type over succeeded rows, the larger types first (``place``), of equal ones the one seen first."""
    per = results.where(_ok()).groupBy("strategy", "question_type").agg(
        F.count("*").alias("n"), F.min("pos").alias("first"), *[F.round(F.avg(m), 9).alias(m) for m in METRICS],
        F.round(F.avg("input_tokens"), 6).alias("input_tokens"), F.round(F.avg("output_tokens"), 6).alias("output_tokens"), F.round(F.avg("cost"), 12).alias("cost"), F.round(F.avg("latency_ms"), 6).alias("latency_ms"),
    )
    w = Window.partitionBy("strategy").orderBy(F.desc("n"), "first", "question_type")
    return per.withColumn("place", F.row_number().over(w)).drop("first")


def distribution(c: str) -> list[Column]:
    """Mean, median, 95th percentile (exact, interpolated), extremes, population deviation and count; zeros without values."""
    v = F.when(_ok(), F.col(c))
    z = lambda x: F.round(F.coalesce(x, F.lit(0.0)), 6)
    return [z(F.avg(v)).alias("mean"), z(F.percentile(v, 0.5)).alias("median"), z(F.percentile(v, 0.95)).alias("p95"), z(F.min(v).cast("double")).alias("min"), z(F.max(v).cast("double")).alias("max"), z(F.stddev_pop(v)).alias("std_dev"), F.count(v).alias("n")]


def latency(results: DataFrame, columns: list[str]) -> DataFrame:
    """The distribution of each latency column by strategy."""
    phases = F.explode(F.array(*[F.struct(F.lit(c).alias("phase"), F.col(c).cast("double").alias("ms")) for c in columns]))
    return results.select("strategy", "error", phases.alias("p")).select("strategy", "error", "p.*").groupBy("strategy", "phase").agg(*distribution("ms"))


def usage(results: DataFrame, keys: list[str]) -> DataFrame:
    """Token and cost totals over all rows, those with errors included, and by stage with every stage present."""
    stage = lambda s, c: F.coalesce(F.sum(F.when(F.col("stage") == s, c)), F.lit(0))
    total = F.col("input_tokens") + F.col("output_tokens")
    cost_map = F.create_map(*[x for s in STAGES for x in (F.lit(s), F.round(stage(s, F.col("cost")).cast("double"), 9))])
    token_map = F.create_map(*[x for s in STAGES for x in (F.lit(s), stage(s, total).cast("long"))])
    return results.groupBy(*keys).agg(
        F.sum("input_tokens").cast("long").alias("input_tokens"), F.sum("cached_tokens").cast("long").alias("cached_tokens"), F.sum("output_tokens").cast("long").alias("output_tokens"),
        stage("embedding", F.col("input_tokens")).cast("long").alias("embedding_tokens"), F.sum(total).cast("long").alias("total_tokens"), F.round(F.sum("cost"), 9).alias("cost"),
        cost_map.alias("cost_by_stage"), token_map.alias("tokens_by_stage"), F.count("*").alias("calls"),
    )


def per_question(used: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """Usage divided by the number of questions; 0 questions count as one."""
    n = F.greatest(F.lit(1), F.coalesce("questions", F.lit(0)))
    return used.join(counts, key, "left").select(key, *[F.round(F.col(c) / n, 9).alias(c) for c in ("input_tokens", "output_tokens", "total_tokens", "cost")])


def cost_breakdown(used: DataFrame, key: str) -> DataFrame:
    """Cost by stage, without stages that cost nothing and without dataset generation, the dearest first (``place``)."""
    rows = used.select(key, F.explode("cost_by_stage").alias("stage", "cost")).where((F.col("cost") > 0) & (F.col("stage") != "dataset-generation"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("cost"), "stage")))


def tradeoff(summaries: DataFrame) -> DataFrame:
    """The best strategy by composite score and the cheapest by cost a question; one that is both is only the best."""
    total = Window.partitionBy(F.lit(1))
    best = F.max_by("strategy", F.struct(F.col("composite"), F.col("tie"))).over(total)
    cheap = F.min_by("strategy", F.struct(F.col("cost"), F.col("strategy"))).over(total)
    rows = summaries.withColumn("tie", -F.rank().over(total.orderBy("strategy")))
    return rows.select("strategy", "composite", "cost", (F.col("strategy") == best).alias("is_best"), ((F.col("strategy") == cheap) & (cheap != best)).alias("is_cheapest"))


def pivot_by_type(types: DataFrame, metric: str, strategies: list[str]) -> DataFrame:
    """A metric by question type with a column for each strategy, 0 where there is none."""
    return types.groupBy("question_type").pivot("strategy", strategies).agg(F.first(metric)).na.fill(0.0)


def deltas(summaries: DataFrame, order: list[str]) -> DataFrame:
    """Relative changes of each strategy's metrics against the first of the selection; null where that is 0."""
    chosen = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("strategy"))
    rows = summaries.withColumn("nth", chosen).where("nth > 0")
    w = Window.partitionBy(F.lit(1)).orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.select("strategy", "nth", *[F.round(F.try_divide(F.col(m) - F.first(m).over(w), F.first(m).over(w)), 6).alias(m) for m in [*METRICS, "composite"]])


def counts(rows: DataFrame, key: str, order: str) -> DataFrame:
    """How many rows of each value, the commonest first (``place``), of equal ones the one seen first."""
    per = rows.groupBy(key).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return per.select(key, "n", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("n"), "first")).alias("place"))


def unpivoted(summaries: DataFrame, key: str) -> DataFrame:
    """Metrics as rows (key, metric, value), for charts."""
    return summaries.unpivot([key], METRICS, "metric", "value")


def explore(results: DataFrame, verdict: str | None = None, strategy: str | None = None, search: str | None = None) -> DataFrame:
    """Rows with a verdict, of a strategy, with a text in question, answer or reference whatever its case."""
    out = results
    if verdict:
        out = out.where(F.col("verdict") == verdict)
    if strategy:
        out = out.where(F.col("strategy") == strategy)
    if search:
        needle = F.lit(search.lower())
        hit = F.lit(False)
        for c in ("question", "answer", "reference_answer"):
            hit = hit | F.coalesce(F.contains(F.lower(c), needle), F.lit(False))
        out = out.where(hit)
    return out


def best_source(sources: DataFrame) -> DataFrame:
    """Of the provenance of each hit (query_id, doc_id, source, rank) one row a source, at its best rank."""
    return sources.groupBy("query_id", "doc_id", "source").agg(F.min("rank").alias("rank"))


def judge_normal(replies: DataFrame) -> DataFrame:
    """A judge's reply with scores between 0 and 1 and a valid verdict, taken from the score where the given one isn't valid."""
    from rankloom.functions.text import trim_all
    from rankloom.functions.vectors import clamp01

    score = clamp01(F.col("score").cast("double"))
    low = F.lower(F.trim("verdict"))
    derived = F.when(score >= 0.75, "pass").when(score >= 0.4, "partial").otherwise("fail")
    valid = F.when(low.isin("pass", "partial", "fail"), low).otherwise(derived)
    blank = trim_all(F.coalesce("answer", F.lit(""))) == ""
    return replies.withColumn("score", F.when(blank, 0.0).otherwise(score)).withColumn("verdict", F.when(blank, "fail").otherwise(valid))
