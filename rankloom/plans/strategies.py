"""The retrieval strategies as plans over all questions at once, and a run that evaluates them.

A corpus is (doc_id, title, category, text); questions are (query_id, text). Every strategy gives
(query_id, doc_id, score, rank), where doc_id is a chunk of that strategy's own index.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from rankloom.functions import text as T
from rankloom.operators import blocks as X, chunking as C, graph as G, labels as L, metrics as M, models as P, search as S
from rankloom.session import cut

K, POOL = 5, 20
#: STR-5: the strategies and the chunk profile of each.
PROFILES = {"baseline": "fixed", "advanced": "structural", "advanced-pro": "contextual", "graphrag": "structural"}
STRATEGIES = list(PROFILES)


@dataclass
class Index:
    """Chunks (doc_id, parent, ordinal, n, text, embed_text) with vectors and terms, written once and read by all searches from their places."""

    chunks: DataFrame
    texts: str
    vectors: str
    alike: bool
    terms: str | None = None
    own_terms: str | None = None

    def hold(self, items: DataFrame) -> str:
        """The place of the terms of the texts, with the keywords of items; search takes the same where a text is embedded as it stands."""
        self.own_terms = X.post(self.chunks.select("doc_id", "text"), items.select(F.explode("keywords").alias("keyword")))
        self.terms = self.own_terms if self.alike else None
        return self.own_terms

    def searched(self) -> str:
        """The place of the terms of what is embedded."""
        self.terms = self.terms or X.post(self.chunks.select("doc_id", F.col("embed_text").alias("text")))
        return self.terms


def numbered(chunks: DataFrame) -> DataFrame:
    """Chunks with a number of their own, which dense search asks for."""
    return chunks.withColumn("n", F.xxhash64("doc_id"))


def index(corpus: DataFrame, profile: str, headers: DataFrame | None = None) -> Index:
    """The index of a corpus by a chunk profile; headers (chunk_id, header) go before what is embedded."""
    if profile == "fixed":
        made = C.fixed(corpus.select(F.col("doc_id").cast("string").alias("doc_id"), "text")).select(F.concat("doc_id", F.lit("#"), F.col("ordinal").cast("string")).alias("chunk_id"), "doc_id", "ordinal", "text", F.col("text").alias("embed_text"))
    elif profile == "structural":
        made = C.structural(corpus).select("chunk_id", "doc_id", "ordinal", "text", F.col("text").alias("embed_text"))
    else:
        made = C.contextual(corpus).select("chunk_id", "doc_id", "ordinal", "text", "embed_text")
        if headers is not None:
            own = F.concat(F.lit("[Context: "), "header", F.lit("]\n"), "text")
            made = made.join(headers, "chunk_id", "left").withColumn("embed_text", F.coalesce(own, "embed_text")).drop("header")
    ends = F.endswith("embed_text", "text")  # what goes before a text is kept, not the text twice
    lead = F.when(ends, F.left("embed_text", F.length("embed_text") - F.length("text"))).alias("lead")
    texts = X.keep(numbered(made.select(F.col("chunk_id").alias("doc_id"), F.col("doc_id").alias("parent"), "ordinal", "text", lead, F.when(~ends, F.col("embed_text")).alias("other"))))
    chunks = corpus.sparkSession.read.parquet(texts).withColumn("embed_text", F.coalesce("other", F.concat("lead", "text"))).drop("lead", "other")
    return Index(chunks, texts, X.keep(P.embed(chunks.select("doc_id", "n", "embed_text"), "embed_text").select("n", "doc_id", "embedding")), profile in ("fixed", "structural"))


def _dense(queries: DataFrame, ix: Index, k: int) -> DataFrame:
    return X.dense(P.embed(X.in_blocks(queries.select("query_id", "text"))), ix.vectors, k)


def _sparse(queries: DataFrame, ix: Index, k: int) -> DataFrame:
    return X.bm25(queries, ix.searched(), k)


def _reranked(questions: DataFrame, hits: DataFrame, ix: Index, k: int) -> DataFrame:
    lists = hits.groupBy("query_id").agg(F.collect_list("doc_id").alias("docs"))
    pairs = X.with_texts(questions.select("query_id", F.col("text").alias("question")).join(lists, "query_id"), ix.texts)
    scores = pairs.select("query_id", "doc_id", P.rerank_score(F.col("question"), F.col("text")).alias("model_score"))
    return S.rerank(hits.select("query_id", "doc_id", "score", "rank"), scores, k)


def baseline(questions: DataFrame, ix: Index, k: int = K) -> DataFrame:
    """Dense search over fixed windows."""
    return _dense(questions, ix, k)


def advanced(questions: DataFrame, ix: Index, k: int = K) -> DataFrame:
    """Question and rewrite, dense and BM25, fused and reranked."""
    other = questions.select("query_id", P.rewrite(F.col("text")).alias("text")).where("text is not null")
    fused = S.fuse([(_dense(questions, ix, POOL), 1.0), (_sparse(questions, ix, POOL), 1.0), (_dense(other, ix, POOL), 1.0), (_sparse(other, ix, POOL), 1.0)], POOL)
    return _reranked(questions, X.held(fused.select("query_id", "doc_id", "score", "rank")), ix, k)


def query_plan(questions: DataFrame) -> DataFrame:
    """(query_id, nth, text, category, k): the queries asked for each question by its route; the question itself is the first."""
    r = questions.select("query_id", "text", P.route(F.col("text")).alias("r"))
    t = F.col("text")
    own = F.when(F.col("r.category") == "broad", P.usable_queries(t, P.variants(t), 4)).when(F.col("r.decompose"), P.usable_queries(t, P.parts(t), 3)).otherwise(P.usable_queries(t, F.array(F.coalesce(P.rewrite(t), F.lit(""))), 1))
    return r.select("query_id", F.posexplode(own).alias("nth", "text"), F.col("r.category").alias("category"), F.col("r.k").alias("k"))


def advanced_pro(questions: DataFrame, ix: Index, limit: int = K) -> DataFrame:
    """Routed queries over contextual chunks, fused with more weight for the question, reranked, widened by neighbours, compressed."""
    plan = cut(query_plan(questions))
    size = F.when(F.col("category") == "broad", POOL).otherwise(15)
    # All queries of all questions are searched at once; a query's place and how many hits it may give stand before its question's ID.
    q = plan.select(F.concat(F.format_string("%02d%02d", F.col("nth").cast("int"), size), "query_id").alias("query_id"), "text")
    own = lambda hits, kind: hits.where(F.col("rank") <= F.substring("query_id", 3, 2).cast("int")).select(
        F.expr("substring(query_id, 5)").alias("query_id"), "doc_id", (F.substring("query_id", 1, 2).cast("int") * 2 + kind).alias("list"), F.col("rank").alias("at"), F.when(F.substring("query_id", 1, 2) == "00", 1.25).otherwise(1.0).alias("weight"))
    fused = X.held(S.fuse_rows(own(_dense(q, ix, POOL), 0).unionByName(own(_sparse(q, ix, POOL), 1)), POOL).select("query_id", "doc_id", "score", "rank"))
    pool = plan.select("query_id", "k").distinct()
    best = _reranked(questions, fused, ix, POOL).join(pool, "query_id").where("rank <= k").select("query_id", "doc_id", "score", "rank")
    wide = S.add_neighbours(best, ix.chunks.select("doc_id", "parent", "ordinal")).select("query_id", "doc_id", "score", "rank")
    return S.compress(wide, ix.chunks.select("doc_id", "text"), limit)


def graphrag(questions: DataFrame, ix: Index, entities: DataFrame, near: DataFrame, units: DataFrame, k: int = K) -> DataFrame:
    """Graph search fused with dense and BM25, the graph's weight by how specific a question's anchors are; those alone where it finds nothing."""
    anchors = cut(G.match_entities(questions, entities))
    hits = G.best_units(anchors, near, units, POOL)
    weight = G.specificity(anchors, units, questions)
    rest = [_dense(questions, ix, POOL), _sparse(questions, ix, POOL)]
    parts_ = [hits.join(weight, "query_id").select("query_id", "doc_id", F.lit(0).alias("list"), "rank", "weight")]
    parts_ += [h.select("query_id", "doc_id", F.lit(i + 1).alias("list"), "rank", F.lit(1.0).alias("weight")) for i, h in enumerate(rest)]
    every = parts_[0].unionByName(parts_[1]).unionByName(parts_[2])
    score = F.aggregate(F.sort_array(F.collect_list(F.struct("list", "rank", "weight"))), F.lit(0.0), lambda s, x: s + x["weight"] / (S.RRF_K + x["rank"]))
    return S.ranked(every.groupBy("query_id", "doc_id").agg(F.round(score, 12).alias("score")), k)


def run(items: DataFrame, search: Callable[[DataFrame], DataFrame], ix: Index, strategy: str, k: int = K) -> DataFrame:
    """One row for each question (item_id, pos, question, answer, keywords, question_type, gold): its hits scored by labels, its answer judged.

    The answer is drawn from question and context alone.
    """
    questions = items.select(F.col("item_id").alias("query_id"), F.col("question").alias("text"))
    terms = ix.hold(items)
    hits = X.held(search(questions))
    labels = L.rescue(X.held(L.needed(items, terms, hits, k))).withColumnRenamed("item_id", "query_id")
    scored = M.evaluate(questions, hits, labels, k)
    lists = hits.where(F.col("rank") <= k).groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("docs"))
    asked = items.select(F.col("item_id").alias("query_id"), "pos", "question", F.coalesce("answer", F.lit("")).alias("reference"), "question_type").join(lists, "query_id", "left")
    told = X.with_context(asked, ix.texts).withColumn("generated", P.answer(F.col("question"), F.when(F.col("context") != "", F.col("context"))))
    j = told.withColumn("j", P.judge(F.col("question"), F.col("generated"), F.col("reference"), F.col("context")))
    rows = j.select("query_id", "pos", "question_type", "generated", "j.*").join(scored, "query_id")
    return rows.withColumn("strategy", F.lit(strategy)).withColumn("error", F.lit(None).cast("string"))


class Trace:
    """STR-7: the steps of a search for all questions at once, each with its candidates and the time since the step before."""

    def __init__(self) -> None:
        self.at = time.monotonic()
        self.steps: list[DataFrame] = []

    def step(self, name: str, detail: str, hits: DataFrame) -> DataFrame:
        """Computes the hits (query_id, ...) of a step once, notes it, and gives them back."""
        hits = cut(hits)
        now = time.monotonic()
        counted = hits.groupBy("query_id").agg(F.count("*").alias("candidates"))
        self.steps.append(counted.select("query_id", F.lit(len(self.steps)).alias("nth"), F.lit(name).alias("name"), F.lit(detail).alias("detail"), "candidates", F.lit(round((now - self.at) * 1000)).cast("long").alias("latency_ms")))
        self.at = time.monotonic()
        return hits

    def rows(self) -> DataFrame:
        """(query_id, nth, name, detail, candidates, latency_ms) of all steps."""
        return reduce(DataFrame.unionByName, self.steps)


# Limits of a request.
LIMITS = {"strategies": 3, "questions": 100, "generated": 40, "text": 200, "dataset": 2_000_000}


def validated(strategies: list[str], questions: int, demo_corpus: bool, demo_questions: bool) -> list[str]:
    """PRJ-16, PRJ-17: the strategies of a run, each once, or an error saying what is wrong with the request."""
    chosen = list(dict.fromkeys(strategies))
    unknown = [s for s in chosen if s not in STRATEGIES]
    if unknown:
        raise ValueError(f"unknown strategies: {', '.join(unknown)}")
    if not 1 <= len(chosen) <= LIMITS["strategies"]:
        raise ValueError("choose one to three strategies")
    if not 1 <= questions <= LIMITS["questions"]:
        raise ValueError("choose 1 to 100 questions")
    if demo_questions != demo_corpus:
        raise ValueError("the demo questions go with the demo corpus alone")
    return chosen


__all__ = ["Index", "T", "Trace", "advanced", "advanced_pro", "baseline", "graphrag", "index", "query_plan", "run", "validated"]
