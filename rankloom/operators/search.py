"""Search operators: exact dense top-k, BM25, rank fusion, and what follows a ranked list.

A ranked list is a DataFrame (query_id, doc_id, score, rank); ranks begin at 1, ties go to the smaller doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from rankloom.functions import text as T
from rankloom.session import cut, small_or_join

K1, B = 1.5, 0.75
RRF_K = 60
#: Queries held by each task in one pass over the corpus.
QUERIES_A_PASS = 4096


def ranked(scored: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The k best of each query; the engine keeps the k best of each partition before the shuffle."""
    w = Window.partitionBy("query_id").orderBy(F.desc(score), "doc_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def renumber(hits: DataFrame) -> DataFrame:
    """Ranks without gaps, in the order of the present ranks."""
    w = Window.partitionBy("query_id").orderBy("rank", "doc_id")
    return hits.withColumn("rank", F.row_number().over(w))


def dedupe(hits: DataFrame) -> DataFrame:
    """The earliest occurrence of each document in a query's list, ranks without gaps."""
    return renumber(hits.groupBy("query_id", "doc_id").agg(F.min_by("score", "rank").alias("score"), F.min("rank").alias("rank")))


def score_of(hits: DataFrame, wanted: DataFrame) -> DataFrame:
    """The scores of wanted (query_id, doc_id) pairs, 0 where there is none."""
    return wanted.join(hits.select("query_id", "doc_id", "score"), ["query_id", "doc_id"], "left").fillna(0.0, ["score"])


def _scan(ids: list, matrix: np.ndarray, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best_s = np.full((len(ids), 0), -np.inf)
        best_i = np.zeros((len(ids), 0), np.int64)
        for pdf in batches:
            fits = pdf["embedding"].map(lambda v: v is not None and len(v) == matrix.shape[1]).to_numpy(bool)
            if not fits.any():
                continue
            m = np.stack(pdf["embedding"].to_numpy()[fits]).astype(np.float64)
            s = np.round(matrix @ m.T, 9)
            own = np.broadcast_to(pdf["doc_id"].to_numpy(np.int64)[fits], s.shape)
            best_s, best_i = np.hstack([best_s, s]), np.hstack([best_i, own])
            order = np.lexsort((best_i, -best_s), axis=1)[:, :k]
            best_s, best_i = np.take_along_axis(best_s, order, 1), np.take_along_axis(best_i, order, 1)
        n = best_s.shape[1]
        yield pd.DataFrame({"query_id": np.repeat(np.asarray(ids, np.int64), n), "doc_id": best_i.ravel(), "score": best_s.ravel()})

    return run


def dense_topk(queries: DataFrame, corpus: DataFrame, k: int, exclude_self: bool = True) -> DataFrame:
    """Exact search: every query (query_id, embedding) against every vector (doc_id, embedding) by inner product.

    The corpus is scanned and never shuffled; a task multiplies its batches with a block of queries and passes on its k best.
    Queries are a stated set, held in blocks of QUERIES_A_PASS, one pass for each. Null vectors and those of another length
    than the queries' take no part. Scores are rounded to nine digits, so that ties don't depend on the order of addition.
    """
    passes, held = [], []
    for r in queries.select("query_id", "embedding").where("embedding is not null").toLocalIterator():
        held.append((r.query_id, r.embedding))
        if len(held) == QUERIES_A_PASS:
            passes.append(held)
            held = []
    passes += [held] if held else []
    out = queries.sparkSession.createDataFrame([], "query_id bigint, doc_id bigint, score double")
    for block in passes:
        scan = _scan([i for i, _ in block], np.array([v for _, v in block], np.float64), k + exclude_self)
        out = out.unionByName(corpus.select("doc_id", "embedding").mapInPandas(scan, out.schema))
    return ranked(out.where("query_id <> doc_id") if exclude_self else out, k)


def terms(corpus: DataFrame) -> DataFrame:
    """doc_id, the content words of each text and their number; an empty or null text has none."""
    return corpus.select("doc_id", F.coalesce(T.content_tokens(F.col("text")), F.array().cast("array<string>")).alias("words")).withColumn("length", F.size("words"))


def postings(counted: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(term, doc_id, tf, length); with ``only`` (term), just of those terms, dropped before the shuffle where they are few.

    Words are stemmed after they are exploded, where the engine compiles the expression.
    """
    # Outer, since a plain explode has the array computed twice: once more, before any exchange, to filter out empty ones.
    words = counted.select("doc_id", "length", F.explode_outer("words").alias("word")).where("word is not null").select("doc_id", "length", T.stem(F.col("word")).alias("term"))
    if only is not None:
        words = words.join(small_or_join(only.select("term").distinct()), "term", "left_semi")
    return words.groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


#: A term that no text has.
EVERY = "\u0000"


def bm25_topk(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """BM25 of queries (query_id, text) over a corpus (doc_id, text): the k best with a positive score.

    Only terms of queries are posted. Texts without a term count for the mean length. A term that a third of all texts
    hold is split by the engine's skew join. Scores are rounded to nine digits.
    """
    q = queries.select("query_id", F.explode(F.array_distinct(T.stems(F.col("text")))).alias("term"))
    # Every text has a term of its own kind beside its words, so that one pass over the texts gives the postings and the totals.
    every = terms(corpus).withColumn("words", F.array_append("words", F.lit(EVERY)))
    wanted = q.select("term").unionByName(queries.sparkSession.createDataFrame([(EVERY,)], "term string"))
    held = cut(postings(every, wanted))
    posted = held.where(F.col("term") != EVERY)
    totals = held.where(F.col("term") == EVERY).agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("docs"), (F.sum(F.col("length") * F.col("tf")) / F.sum("tf")).alias("mean"))
    frequency = posted.groupBy("term").agg(F.count("*").alias("df"))
    weight = idf(F.col("docs"), F.col("df")) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    asked = q.join(frequency, "term")
    scored = posted.join(asked, "term").crossJoin(F.broadcast(totals)).select("query_id", "doc_id", weight.alias("w"))
    total = scored.groupBy("query_id", "doc_id").agg(F.round(F.sum("w"), 9).alias("score")).where("score > 0")
    return ranked(total, k)


def fuse(lists: list[tuple[DataFrame, float]], k: int) -> DataFrame:
    """Reciprocal rank fusion of ranked lists with weights; of equal scores the one seen first (by list, then rank).

    ``sources`` holds for each result the lists and ranks it comes from.
    """
    parts = [hits.select("query_id", "doc_id", F.lit(i).alias("list"), F.col("rank").alias("at"), F.lit(float(weight)).alias("weight")) for i, (hits, weight) in enumerate(lists)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return fuse_rows(every, k)


def fuse_rows(every: DataFrame, k: int) -> DataFrame:
    """As fuse, of the rows (query_id, doc_id, list, at, weight) of all lists."""
    terms_ = F.sort_array(F.collect_list(F.struct("list", "at", "weight")))
    grouped = every.repartition("query_id").groupBy("query_id", "doc_id").agg(terms_.alias("t"))  # shuffled once, not by document and again by query
    score = F.aggregate("t", F.lit(0.0), lambda s, x: s + x["weight"] / (RRF_K + x["at"]))
    scored = grouped.select("query_id", "doc_id", F.round(score, 12).alias("score"), F.element_at("t", 1).alias("first"), F.transform("t", lambda x: F.struct(x["list"].alias("list"), x["at"].alias("rank"))).alias("sources"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "first.list", "first.at", "doc_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("first")


def rerank(hits: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """Hits in the order of new scores (query_id, doc_id, model_score of 0..10); without one, 1 / rank; equal ones keep their order.

    A list of one is left as it is.
    """
    n = F.count("*").over(Window.partitionBy("query_id"))
    j = hits.join(scores, ["query_id", "doc_id"], "left").withColumn("n", n)
    fresh = F.when(F.col("model_score").isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("model_score") / 10)))
    j = j.withColumn("score", F.when(F.col("n") <= 1, F.col("score")).otherwise(F.coalesce(fresh, 1 / F.col("rank"))))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("rank"))
    return j.withColumn("new", F.row_number().over(w)).where(F.col("new") <= k).select("query_id", "doc_id", "score", F.col("new").alias("rank"))


def add_neighbours(hits: DataFrame, siblings: DataFrame, first: int = 2, factor: float = 0.5) -> DataFrame:
    """Hits and, after them, the chunks before and after the ``first`` best ones in their document, at half their score.

    siblings: doc_id, parent, ordinal. A chunk that is there already isn't added again.
    """
    w = Window.partitionBy("parent").orderBy("ordinal", "doc_id")
    beside = siblings.select("doc_id", F.lag("doc_id").over(w).alias("before"), F.lead("doc_id").over(w).alias("after"))
    near = hits.where(F.col("rank") <= first).join(beside, "doc_id")
    steps = F.array(F.struct(F.lit(0).alias("step"), F.col("before").alias("id")), F.struct(F.lit(1).alias("step"), F.col("after").alias("id")))
    added = near.select("query_id", F.explode(steps).alias("s"), (F.col("score") * factor).alias("score"), "rank").where("s.id is not null")
    added = added.select("query_id", F.col("s.id").alias("doc_id"), "score", (F.col("rank") * 2 + F.col("s.step")).alias("seen"))
    added = added.groupBy("query_id", "doc_id").agg(F.min_by("score", "seen").alias("score"), F.min("seen").alias("seen")).join(hits.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    both = hits.select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("seen"), F.lit(0).alias("new")).unionByName(added.withColumn("new", F.lit(1)))
    order = Window.partitionBy("query_id").orderBy("new", "seen", "doc_id")
    return both.select("query_id", "doc_id", "score", "new", F.row_number().over(order).alias("rank"))


def compress(hits: DataFrame, texts: DataFrame, limit: int) -> DataFrame:
    """The best ``limit`` hits by score, of texts with the same beginning only the best."""
    keyed = hits.join(texts.select("doc_id", F.coalesce(T.near_duplicate_key(F.col("text")), F.lit("")).alias("key")), "doc_id")
    order = [F.desc("score"), F.col("rank")]
    best = keyed.withColumn("nth", F.row_number().over(Window.partitionBy("query_id", "key").orderBy(*order))).where("nth = 1")
    w = Window.partitionBy("query_id").orderBy(*order)
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("query_id", "doc_id", "score", "rank")
