"""Ranking metrics of hits against graded labels, one row for each question."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from rankloom.functions import vectors as V

RELEVANT = 0.5
K = 5


def graded_hits(hits: DataFrame, labels: DataFrame) -> DataFrame:
    """Hits (query_id, doc_id, rank) with their grade, 0 without a label; labels: query_id, doc_id, grade."""
    return hits.select("query_id", "doc_id", "rank").join(labels.select("query_id", "doc_id", "grade"), ["query_id", "doc_id"], "left").fillna(0.0, ["grade"])


def ideal(labels: DataFrame, k: int = K) -> DataFrame:
    """The best possible gain of each question over its k best labels, and how many labels are relevant, those counted in ``above`` too, if given."""
    w = Window.partitionBy("query_id").orderBy(F.desc("grade"))
    placed = labels.withColumn("place", F.row_number().over(w))
    best = F.sum(F.when(F.col("place") <= k, V.gain(F.col("grade")) * V.discount(F.col("place"))))
    relevant = F.count_if(F.col("grade") >= RELEVANT)
    if "above" in labels.columns:
        relevant = F.greatest(relevant, F.max("above"))
    return placed.groupBy("query_id").agg(best.alias("ideal"), relevant.alias("relevant_total"))


def evaluate(questions: DataFrame, hits: DataFrame, labels: DataFrame, k: int = K) -> DataFrame:
    """All rank metrics of each question (query_id); questions without hits or labels have zeros.

    Reciprocal rank looks at all ranks, the others at the first k; precision is relative to what was returned, context
    precision is the mean precision at the relevant ranks.
    """
    relevant = F.col("grade") >= RELEVANT
    w = Window.partitionBy("query_id").orderBy("rank")
    so_far = F.sum(relevant.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    g = graded_hits(hits, labels).withColumn("found", so_far)
    inside = F.col("rank") <= k
    per = g.groupBy("query_id").agg(
        (1 / F.min(F.when(relevant, F.col("rank")))).alias("rr"),
        F.sum(F.when(inside, V.gain(F.col("grade")) * V.discount(F.col("rank")))).alias("dcg"),
        F.count_if(inside & relevant).alias("hits"),
        F.count_if(inside).alias("returned"),
        F.avg(F.when(inside & relevant, F.col("found") / F.col("rank"))).alias("ap"),
    )
    j = questions.select("query_id").join(per, "query_id", "left").join(ideal(labels, k), "query_id", "left")
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 9)
    hits_ = F.coalesce("hits", F.lit(0))
    ratio = F.try_divide(F.col("dcg"), F.col("ideal"))
    return j.select(
        "query_id",
        zero(F.col("rr")).alias("reciprocal_rank"),
        zero(F.when(ratio.isNotNull(), F.least(F.lit(1.0), ratio))).alias("ndcg"),
        zero(F.try_divide(hits_, F.col("relevant_total"))).alias("recall"),
        zero(F.try_divide(hits_, F.col("returned"))).alias("precision"),
        F.when(hits_ > 0, 1.0).otherwise(0.0).alias("hit_rate"),
        zero(F.col("ap")).alias("context_precision"),
        hits_.cast("long").alias("relevant_retrieved"),
        F.coalesce("relevant_total", F.lit(0)).cast("long").alias("relevant_total"),
    )


METRICS = ["reciprocal_rank", "ndcg", "recall", "precision", "hit_rate", "context_precision"]


def keyword_coverage(items: DataFrame, texts: DataFrame) -> DataFrame:
    """(query_id, hits map, coverage): which keywords of a question occur in a text; 0 without keywords.

    items: query_id, keywords; texts: query_id, text (of the answer, or of the joined context).
    """
    from rankloom.functions import text as T

    j = items.join(texts, "query_id", "left").withColumn("h", T.normalize_for_match(F.coalesce("text", F.lit(""))))
    # A lambda can't hold the exact test's own lambdas over outer columns cheaply; explode, test, gather.
    one = j.select("query_id", "h", F.explode(F.array_distinct("keywords")).alias("keyword"))
    tested = one.withColumn("present", T.keyword_in_normal(T.normalize_for_match(F.col("keyword")), F.col("h")))
    per = tested.groupBy("query_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("keyword", "present")))).alias("hits"), F.avg(F.col("present").cast("double")).alias("coverage"))
    return items.select("query_id").join(per, "query_id", "left").select("query_id", "hits", F.round(F.coalesce("coverage", F.lit(0.0)), 9).alias("coverage"))
