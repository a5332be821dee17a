"""Queries on search, fusion, labels and ranking metrics.

Dense search: vectors whose id is divisible by 50 against all others, relevant are those with the same label. Text search:
benchmark items against documents. Labels: questions whose position is divisible by 50 against all stored chunks of a strategy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rankloom.functions import text as T
from rankloom.operators import blocks as X, labels as L, metrics as M, search as S
from rankloom.plans.text_queries import CONTENT, STOP, WS, sql_stem
from rankloom.session import cut, latest, newest, table

K = 5
POOL = 20


def _vectors(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    return v.where(F.col("doc_id") % 50 == 0).withColumnRenamed("doc_id", "query_id"), v


def _dense(spark: SparkSession, folder: str, k: int) -> DataFrame:
    q, v = _vectors(spark, folder)
    return S.dense_topk(q, v, k)


def _dense_labels(spark: SparkSession, folder: str) -> DataFrame:
    q, v = _vectors(spark, folder)
    return q.select("query_id", "label").join(v.select("doc_id", "label"), "label").where("query_id <> doc_id").select("query_id", "doc_id", F.lit(1.0).alias("grade"))


def dense_topk(spark: SparkSession, folder: str) -> DataFrame:
    """SCH-1, SRT-1, SRT-2: the five most similar vectors of each query."""
    return _dense(spark, folder, K)


def dense_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """MET-1..6, MET-10, MET-11: ranking metrics of dense search."""
    q, _ = _vectors(spark, folder)
    return M.evaluate(q, _dense(spark, folder, K), _dense_labels(spark, folder))


def dense_metrics_by_label(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-2: mean metrics by label."""
    q, _ = _vectors(spark, folder)
    return dense_metrics(spark, folder).join(q.select("query_id", "label"), "query_id").groupBy("label").agg(F.count("*").alias("n"), *[F.round(F.avg(m), 6).alias(m) for m in M.METRICS])


def metrics_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-1, AGG-2: mean metrics by label and over all in one pass."""
    q, _ = _vectors(spark, folder)
    return dense_metrics(spark, folder).join(q.select("query_id", "label"), "query_id").rollup("label").agg(F.count("*").alias("n"), F.round(F.avg("ndcg"), 6).alias("ndcg"), F.round(F.avg("precision"), 6).alias("precision"))


def _corpus(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "text")


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _bm25(spark: SparkSession, folder: str, k: int = POOL) -> DataFrame:
    return S.bm25_topk(_asked(spark, folder), _corpus(spark, folder), k)


def bm25_postings(spark: SparkSession, folder: str) -> DataFrame:
    """SCH-2: how many documents hold each term, and how often in all."""
    return S.postings(S.terms(_corpus(spark, folder))).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def bm25_totals(spark: SparkSession, folder: str) -> DataFrame:
    """SCH-2: size and mean length of the index, the texts without a term included."""
    return S.terms(_corpus(spark, folder)).agg(F.count("*").alias("docs"), F.round(F.avg("length"), 6).alias("mean_length"))


def bm25_idf(spark: SparkSession, folder: str) -> DataFrame:
    """SCH-3: the weight of every term of the benchmark."""
    q = _asked(spark, folder).select(F.explode(F.array_distinct(T.stems(F.col("text")))).alias("term")).distinct()
    stemmed = S.terms(_corpus(spark, folder))
    n = stemmed.agg(F.count("*").alias("docs"))
    df = S.postings(stemmed, q).groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n)).select("term", "df", F.round(S.idf(F.col("docs"), F.col("df")), 6).alias("idf"))


def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    """SCH-3: the twenty best documents of each benchmark item."""
    return _bm25(spark, folder).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def _two_lists(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """BM25 with whole items and with their first eight words; the corpus is posted once for both."""
    start = F.array_join(F.slice(T.tokenize(F.col("text")), 1, 8), " ")
    asked = _asked(spark, folder)
    tagged = lambda n, text: asked.select(F.struct(F.lit(n).alias("list"), "query_id").alias("query_id"), text.alias("text"))
    hits = cut(S.bm25_topk(tagged(0, F.col("text")).unionByName(tagged(1, start)), _corpus(spark, folder), POOL))
    first, second = (hits.where(F.col("query_id.list") == n).withColumn("query_id", F.col("query_id.query_id")) for n in (0, 1))
    return first, second


def _fused(spark: SparkSession, folder: str, first: float, second: float) -> DataFrame:
    return S.fuse(list(zip(_two_lists(spark, folder), (first, second))), POOL)


def rrf_hybrid(spark: SparkSession, folder: str) -> DataFrame:
    """SCH-4: two ranked lists fused with equal weights."""
    return _fused(spark, folder, 1.0, 1.0).select("query_id", "doc_id", F.round("score", 9).alias("score"), "rank", F.size("sources").alias("lists"))


def rrf_weighted(spark: SparkSession, folder: str) -> DataFrame:
    """SCH-4: two ranked lists fused with weights 1.25 and 1."""
    return _fused(spark, folder, 1.25, 1.0).select("query_id", "doc_id", F.round("score", 9).alias("score"), "rank")


def deduped_hits(spark: SparkSession, folder: str) -> DataFrame:
    """SCH-5: both lists one after the other, each document at its earliest place."""
    first, second = _two_lists(spark, folder)
    return S.dedupe(first.unionByName(second.withColumn("rank", F.col("rank") + POOL))).select("query_id", "doc_id", "rank")


def looked_up_scores(spark: SparkSession, folder: str) -> DataFrame:
    """SCH-6: scores of given pairs, 0 where the pair was no hit."""
    q = _asked(spark, folder).select("query_id")
    wanted = q.select("query_id", F.explode(F.sequence(F.col("query_id") * 3, F.col("query_id") * 3 + 2)).alias("doc_id"))
    return S.score_of(_bm25(spark, folder), wanted).select("query_id", "doc_id", F.round("score", 6).alias("score"))


def context_compression(spark: SparkSession, folder: str) -> DataFrame:
    """SRT-7, TXT-15: the five best hits with different beginnings."""
    return S.compress(_bm25(spark, folder), _corpus(spark, folder), K).select("query_id", "doc_id", "rank")


def page_two(spark: SparkSession, folder: str) -> DataFrame:
    """SRT-4: rows 26 to 50 of all hits, best first."""
    from pyspark.sql import Window

    w = Window.orderBy(F.desc("score"), "query_id", "doc_id")
    best = _bm25(spark, folder).orderBy(F.desc("score"), "query_id", "doc_id").limit(50)
    return best.withColumn("row", F.row_number().over(w)).where(F.col("row").between(26, 50)).select("row", "query_id", "doc_id")


def items(spark: SparkSession, folder: str, every: int | None = 50) -> DataFrame:
    """Questions, each once, whose position is divisible by ``every``: the stated query set of searches. None gives every question."""
    e = table(spark, folder, "evaluation_items")
    e = e if every is None else e.where(F.col("pos") % every == 0)
    last = latest(e.select("id", "loaded_at", "pos", "question", "reference_answer", "expected_keywords", "question_type", "gold_chunk_ids"), ["id"], ["loaded_at"])
    return last.select(F.col("id").alias("item_id"), "pos", "question", F.col("reference_answer").alias("answer"), F.col("expected_keywords").alias("keywords"), F.coalesce("question_type", F.lit("other")).alias("question_type"), F.col("gold_chunk_ids").alias("gold"))


def chunks(spark: SparkSession, folder: str, strategy: str = "advanced") -> DataFrame:
    """The chunks of a strategy, each once."""
    c = table(spark, folder, "stored_chunks").where(F.col("strategy") == strategy)
    return newest(c.select("chunk_id", "created_at", "id", "doc_id", "ordinal", "text", "embed_text"), ["chunk_id"], ["created_at", "id"]).select(F.col("chunk_id").alias("doc_id"), F.col("doc_id").alias("parent"), "ordinal", "text", "embed_text")


def keyword_hits(spark: SparkSession, folder: str) -> DataFrame:
    """JN-4, TXT-6, TXT-7: keywords of the questions found in the chunks."""
    return L.keyword_hits(items(spark, folder), chunks(spark, folder))


def answer_shares(spark: SparkSession, folder: str) -> DataFrame:
    """JN-3: the share of each answer's stems that a chunk holds."""
    return L.answer_share(items(spark, folder), chunks(spark, folder)).select("item_id", "doc_id", F.round("share", 9).alias("share"))


def _plain(spark: SparkSession, folder: str) -> DataFrame:
    return items(spark, folder).withColumn("gold", F.lit(None).cast("array<string>"))


def relevance_labels(spark: SparkSession, folder: str) -> DataFrame:
    """LBL-1: the positive grades of all chunks for each question, gold chunks left aside."""
    return _labels(spark, folder, cut(chunks(spark, folder)))


def _labels(spark: SparkSession, folder: str, held: DataFrame) -> DataFrame:
    return L.grades(cut(_plain(spark, folder)), held)


def relevance_gold(spark: SparkSession, folder: str) -> DataFrame:
    """JN-5: labels of the questions that name their gold chunks."""
    return L.grades(items(spark, folder).where(F.size("gold") > 0), chunks(spark, folder))


def relevance_rescue(spark: SparkSession, folder: str) -> DataFrame:
    """LBL-2, PRJ-9: grades after promotion, and which are relevant."""
    return L.rescue(relevance_labels(spark, folder)).withColumn("relevant", F.col("grade") >= L.THRESHOLD)


def _question_hits(spark: SparkSession, folder: str, held: DataFrame | None = None) -> DataFrame:
    q = items(spark, folder).select(F.col("item_id").alias("query_id"), F.col("question").alias("text"))
    return S.bm25_topk(q, chunks(spark, folder) if held is None else held, POOL)


def retrieval_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """MET-1..6, MET-10, JN-6: BM25 over the chunks scored by the labels."""
    q = items(spark, folder).select(F.col("item_id").alias("query_id"))
    plain = cut(_plain(spark, folder))
    terms = X.post(chunks(spark, folder).select("doc_id", "text"), plain.select(F.explode("keywords").alias("keyword")))  # read by labels and search
    hits = cut(X.bm25(plain.select(F.col("item_id").alias("query_id"), F.col("question").alias("text")), terms, POOL))
    labels = L.rescue(cut(L.needed(plain, terms, hits))).withColumnRenamed("item_id", "query_id")
    return M.evaluate(q, hits, labels)


def context_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """MET-7..9: the share of a question's keywords in the joined text of its five best chunks."""
    best = _question_hits(spark, folder).where(F.col("rank") <= K).join(chunks(spark, folder).select("doc_id", "text"), "doc_id")
    joined = best.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "text"))).alias("t")).select("query_id", F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("text"))
    wanted = items(spark, folder).select(F.col("item_id").alias("query_id"), "keywords")
    return M.keyword_coverage(wanted, joined).select("query_id", F.size(F.map_filter("hits", lambda k, v: v)).alias("found"), "coverage").fillna(-1, ["found"])


def neighbour_expansion(spark: SparkSession, folder: str) -> DataFrame:
    """JN-7, SRT-7: the chunks beside the two best, at half their score."""
    return S.add_neighbours(_question_hits(spark, folder).where(F.col("rank") <= K), chunks(spark, folder)).select("query_id", "doc_id", F.round("score", 6).alias("score"), "new", "rank")


def reranked(spark: SparkSession, folder: str) -> DataFrame:
    """STR-6, PRJ-15: hits in the order of a model's scores, where it gave one."""
    hits = _question_hits(spark, folder).where(F.col("rank") <= 10)
    given = hits.where(F.col("rank") % 3 != 0).select("query_id", "doc_id", (F.col("rank") * 7 % 11).cast("double").alias("model_score"))
    return S.rerank(hits, given, K).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


QUERIES = {
    f.__name__: f
    for f in (
        dense_topk, dense_metrics, dense_metrics_by_label, metrics_rollup, bm25_postings, bm25_totals, bm25_idf, bm25_topk, rrf_hybrid, rrf_weighted, deduped_hits, looked_up_scores, context_compression, page_two,
        keyword_hits, answer_shares, relevance_labels, relevance_gold, relevance_rescue, retrieval_metrics, context_coverage, neighbour_expansion, reranked,
    )
}

# The SQL is put together from common table expressions.
_S = "list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::double * b.embedding[i]::double))"
DENSE = f"s as (select a.vec_id as query_id, b.vec_id as doc_id, a.label = b.label as rel, a.label, round({_S}, 9) as score from embeddings a join embeddings b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id), hits as (select *, row_number() over (partition by query_id order by score desc, doc_id)::int as rank from s qualify rank <= 5)"
DENSE_METRICS = f"""{DENSE}, tot as (select query_id, any_value(label) as label, count(*) filter (rel) as relevant_total from s group by 1),
    per as (select query_id, min(rank) filter (rel) as first, sum(case when rel then 1 / log2(rank + 1) else 0 end) as dcg, count(*) filter (rel) as h, count(*) as n from hits group by 1),
    ap as (select query_id, avg(f / rank) filter (rel) as ap from (select *, sum(rel::int) over (partition by query_id order by rank) as f from hits) group by 1),
    m as (select tot.query_id, label, round(coalesce(1 / first, 0), 9) as reciprocal_rank, round(coalesce(least(1, dcg / (select sum(1 / log2(i + 1)) from range(1, least(5, relevant_total) + 1) t(i))), 0), 9) as ndcg,
    round(coalesce(h / nullif(relevant_total, 0), 0), 9) as recall, round(coalesce(h / nullif(n, 0), 0), 9) as precision, case when h > 0 then 1.0 else 0.0 end::double as hit_rate, round(coalesce(ap, 0), 9) as context_precision, h::bigint as relevant_retrieved, relevant_total::bigint as relevant_total from tot join per using (query_id) join ap using (query_id))"""
_METRIC_NAMES = ", ".join(M.METRICS)
STEMS = f"list_transform({CONTENT}, lambda w: {sql_stem('w')})"


def _bm25_sql(name: str, corpus: str, asked: str, k: int, tag: str) -> str:
    """Common table expressions that end in one called ``name`` (query_id, doc_id, score, rank); the others carry the tag."""
    return f"""d{tag} as (select doc_id, coalesce({STEMS}, []) as stems from {corpus}), tot{tag} as (select count(*) as docs, avg(len(stems)) as mean from d{tag}), q{tag} as (select distinct query_id, unnest({STEMS}) as term from {asked}),
        post{tag} as (select doc_id, any_value(len(stems)) as length, term, count(*) as tf from (select doc_id, stems, unnest(stems) as term from d{tag}) group by doc_id, term), df{tag} as (select term, count(*) as df from post{tag} group by 1),
        {name} as (select *, row_number() over (partition by query_id order by score desc, doc_id)::int as rank from (select query_id, doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))), 9) as score
        from q{tag} join post{tag} using (term) join df{tag} using (term), tot{tag} group by 1, 2 having score > 0) qualify rank <= {k})"""


_ASKED = "(select item_id as query_id, text from benchmark)"
_STARTS = f"(select item_id as query_id, array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}''{WS}-]', ' ', 'g'), '[{WS}]+'), lambda w: w <> '')[1:8], ' ') as text from benchmark)"
_B1 = _bm25_sql("b1", "documents", _ASKED, POOL, "_a")
_B2 = _bm25_sql("b2", "documents", _STARTS, POOL, "_b")
_FUSE = """u as (select query_id, doc_id, 0 as list, rank as pl, {w1} as w from b1 union all select query_id, doc_id, 1, rank, {w2} from b2), g as (select query_id, doc_id, round(sum(w / (60 + pl)), 12) as s, min(list * 1000 + pl) as first, count(*) as lists from u group by 1, 2),
    f as (select query_id, doc_id, round(s, 9) as score, row_number() over (partition by query_id order by s desc, first, doc_id)::int as rank, lists::int as lists from g qualify rank <= 20)"""
ITEMS = """items as (select id as item_id, pos, question, reference_answer as answer, expected_keywords as keywords, coalesce(question_type, 'other') as question_type, gold_chunk_ids as gold from evaluation_items where pos % 50 = 0 qualify row_number() over (partition by id order by loaded_at desc) = 1)"""
CHUNKS = """chunks as (select chunk_id as doc_id, doc_id as parent, ordinal, text, embed_text from stored_chunks where strategy = 'advanced' qualify row_number() over (partition by chunk_id order by created_at desc, id desc) = 1)"""
_NORM = lambda t: f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({t}), '[‘’]', '''', 'g'), '[^\\p{{L}}\\p{{N}}''%$.{WS}-]', ' ', 'g'), '[{WS}]+', ' ', 'g'), '^ +| +$', '', 'g')"
_HAS = f"""(regexp_matches(h, '(^|[^\\p{{L}}\\p{{N}}])' || regexp_escape(k) || '($|[^\\p{{L}}\\p{{N}}])') or (len(kw) = 1 and list_contains(hs, kw[1])) or
    (len(kw) > 1 and len(list_filter(kw, lambda w: not list_contains(hs, w))) = 0 and list_max(list_transform(kw, lambda w: list_position(hs, w))) - list_min(list_transform(kw, lambda w: list_position(hs, w))) <= 4 * len(kw)))"""
_KEYS = f"""keys as (select item_id, nth, k, list_transform(string_split(k, ' '), lambda w: {sql_stem('w')}) as kw from (select item_id, nth, {_NORM('keyword')} as k from (select item_id, unnest(keywords) as keyword, generate_subscripts(keywords, 1) as nth from items)) where k <> ''),
    prep as (select doc_id, h, list_transform(string_split(h, ' '), lambda w: {sql_stem('w')}) as hs from (select doc_id, {_NORM('text')} as h from chunks) where h <> ''), hit as (select item_id, doc_id, count(distinct nth) as hits from keys, prep where {_HAS} group by 1, 2)"""
_ITEM_STEMS = STEMS.replace("lower(text)", "lower(answer)")
_SHARE = f"""ans as (select item_id, list_distinct({_ITEM_STEMS}) as s from items where answer is not null), chs as (select doc_id, list_distinct({STEMS}) as c from chunks), share as (select item_id, doc_id, len(list_intersect(s, c)) / len(s) as share from ans, chs where len(s) > 0 and len(list_intersect(s, c)) > 0)"""
_GRADES = f"""{ITEMS}, {CHUNKS}, {_KEYS}, {_SHARE}, graded as (select item_id, doc_id, round(least(1, 0.6 * coalesce(hits / len(keywords), 0) + 0.4 * coalesce(share, 0)), 9) as grade from (select * from hit full join share using (item_id, doc_id)) join items using (item_id))"""
_RESCUED = f"""{_GRADES}, resc as (select item_id, doc_id, case when max(grade) over (partition by item_id) < 0.5 and grade >= 0.25 and row_number() over (partition by item_id order by grade desc, doc_id) <= 2 then greatest(grade, 0.5) else grade end::double as grade, max(grade) over (partition by item_id) < 0.25 as unsupported from graded)"""
_QHITS = _bm25_sql("qh", "chunks", "(select item_id as query_id, question as text from items)", POOL, "_q")

SQL = {
    "dense_topk": f"with {DENSE} select query_id, doc_id, score, rank from hits",
    "dense_metrics": f"with {DENSE_METRICS} select query_id, {_METRIC_NAMES}, relevant_retrieved, relevant_total from m",
    "dense_metrics_by_label": f"with {DENSE_METRICS} select label, count(*) as n, {', '.join(f'round(avg({m}), 6) as {m}' for m in M.METRICS)} from m group by 1",
    "metrics_rollup": f"with {DENSE_METRICS} select label, count(*) as n, round(avg(ndcg), 6) as ndcg, round(avg(precision), 6) as precision from m group by rollup (label)",
    "bm25_postings": f"with {_B1} select term, count(*) as df, sum(tf)::bigint as cf from post_a group by 1",
    "bm25_totals": f"with {_B1} select docs, round(mean, 6) as mean_length from tot_a",
    "bm25_idf": f"with {_B1} select distinct term, df, round(ln(1 + (docs - df + 0.5) / (df + 0.5)), 6) as idf from q_a join df_a using (term), tot_a",
    "bm25_topk": f"with {_B1} select query_id, doc_id, round(score, 6) as score, rank from b1",
    "rrf_hybrid": f"with {_B1}, {_B2}, {_FUSE.format(w1='1.0::double', w2='1.0::double')} select query_id, doc_id, score, rank, lists from f",
    "rrf_weighted": f"with {_B1}, {_B2}, {_FUSE.format(w1='1.25::double', w2='1.0::double')} select query_id, doc_id, score, rank from f",
    "deduped_hits": f"with {_B1}, {_B2}, u as (select query_id, doc_id, min(rank) as r from (select query_id, doc_id, rank from b1 union all select query_id, doc_id, rank + 20 from b2) group by 1, 2) select query_id, doc_id, row_number() over (partition by query_id order by r, doc_id)::int as rank from u",
    "looked_up_scores": f"with {_B1}, w as (select item_id as query_id, item_id * 3 + i as doc_id from benchmark, range(0, 3) t(i)) select w.query_id, w.doc_id, round(coalesce(score, 0), 6) as score from w left join b1 using (query_id, doc_id)",
    "context_compression": f"""with {_B1}, k as (select b1.*, coalesce(regexp_replace(lower(left(text, 120)), '[{WS}]+', ' ', 'g'), '') as key from b1 join documents using (doc_id)), b as (select * from k qualify row_number() over (partition by query_id, key order by score desc, rank) = 1)
        select query_id, doc_id, row_number() over (partition by query_id order by score desc, rank)::int as rank from b qualify row_number() over (partition by query_id order by score desc, rank) <= 5""",
    "page_two": f"with {_B1} select row, query_id, doc_id from (select query_id, doc_id, row_number() over (order by score desc, query_id, doc_id)::int as row from b1) where row between 26 and 50",
    "keyword_hits": f"with {ITEMS}, {CHUNKS}, {_KEYS} select item_id, doc_id, hits from hit",
    "answer_shares": f"with {ITEMS}, {CHUNKS}, {_SHARE} select item_id, doc_id, round(share, 9) as share from share",
    "relevance_labels": f"with {_GRADES} select item_id, doc_id, grade from graded where grade > 0",
    "relevance_gold": f"with {ITEMS} select item_id, unnest(list_distinct(gold)) as doc_id, 1.0::double as grade from items where len(gold) > 0",
    "relevance_rescue": f"with {_RESCUED} select item_id, doc_id, grade, unsupported, grade >= 0.5 as relevant from resc",
    "retrieval_metrics": f"""with {_RESCUED}, {_QHITS}, g as (select qh.query_id, qh.rank, coalesce(grade, 0) as grade from qh left join resc on resc.item_id = qh.query_id and resc.doc_id = qh.doc_id), f as (select *, sum((grade >= 0.5)::int) over (partition by query_id order by rank) as f from g),
        per as (select query_id, min(rank) filter (grade >= 0.5) as first, sum((pow(2, grade) - 1) / log2(rank + 1)) filter (rank <= 5) as dcg, count(*) filter (rank <= 5 and grade >= 0.5) as h, count(*) filter (rank <= 5) as n, avg(f / rank) filter (rank <= 5 and grade >= 0.5) as ap from f group by 1),
        il as (select item_id as query_id, sum((pow(2, grade) - 1) / log2(place + 1)) filter (place <= 5) as ideal, count(*) filter (grade >= 0.5) as relevant_total from (select *, row_number() over (partition by item_id order by grade desc) as place from resc) group by 1)
        select i.item_id as query_id, round(coalesce(1 / first, 0), 9) as reciprocal_rank, round(case when dcg / nullif(ideal, 0) is null then 0 else least(1, dcg / ideal) end, 9) as ndcg, round(coalesce(h / nullif(relevant_total, 0), 0), 9) as recall, round(coalesce(h / nullif(n, 0), 0), 9) as precision,
        case when h > 0 then 1.0 else 0.0 end::double as hit_rate, round(coalesce(ap, 0), 9) as context_precision, coalesce(h, 0)::bigint as relevant_retrieved, coalesce(relevant_total, 0)::bigint as relevant_total from items i left join per on per.query_id = i.item_id left join il on il.query_id = i.item_id""",
    "context_coverage": f"""with {ITEMS}, {CHUNKS}, {_QHITS}, ctx as (select query_id as doc_id, string_agg(text, chr(10) order by rank) as text from qh join chunks using (doc_id) where rank <= 5 group by 1),
        {_KEYS.replace('from chunks)', 'from ctx)').replace('count(distinct nth) as hits', 'count(distinct keyword) as hits').replace('select item_id, nth, k, list', 'select item_id, keyword, nth, k, list').replace('(select item_id, nth, ' + _NORM('keyword'), '(select item_id, keyword, nth, ' + _NORM('keyword')).replace('from keys, prep where', 'from keys, prep where item_id = doc_id and')}
        select item_id as query_id, case when len(keywords) > 0 then coalesce(hits, 0) else -1 end::int as found, round(case when len(keywords) > 0 then coalesce(hits, 0) / len(list_distinct(keywords)) else 0 end, 9) as coverage from items left join hit using (item_id)""",
    "neighbour_expansion": f"""with {ITEMS}, {CHUNKS}, {_QHITS}, h as (select * from qh where rank <= 5), sib as (select doc_id, lag(doc_id) over w as before, lead(doc_id) over w as after from chunks window w as (partition by parent order by ordinal, doc_id)),
        n as (select query_id, before as doc_id, score / 2 as score, rank * 2 as seen from h join sib using (doc_id) where rank <= 2 and before is not null union all select query_id, after, score / 2, rank * 2 + 1 from h join sib using (doc_id) where rank <= 2 and after is not null),
        a as (select query_id, doc_id, arg_min(score, seen) as score, min(seen) as seen from n where (query_id, doc_id) not in (select (query_id, doc_id) from h) group by 1, 2), u as (select query_id, doc_id, score, rank as seen, 0 as new from h union all select query_id, doc_id, score, seen, 1 from a)
        select query_id, doc_id, round(score, 6) as score, new, row_number() over (partition by query_id order by new, seen, doc_id)::int as rank from u""",
    "reranked": f"""with {ITEMS}, {CHUNKS}, {_QHITS}, h as (select *, count(*) over (partition by query_id) as n from qh where rank <= 10), s as (select query_id, doc_id, rank, case when n <= 1 then score when rank % 3 <> 0 then least(1, (rank * 7 % 11) / 10) else 1 / rank end as score from h)
        select query_id, doc_id, round(score, 6) as score, row_number() over (partition by query_id order by score desc, rank)::int as rank from s qualify row_number() over (partition by query_id order by score desc, rank) <= 5""",
}
