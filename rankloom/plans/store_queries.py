"""Queries that write to the store and read back, and queries on model ports, traces and hybrid search, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from rankloom.functions.text import WS
from rankloom.operators import graph as G, models as P, search as S
from rankloom.plans import strategies as R
from rankloom.plans.graph_queries import _MEM, _asked_communities, _entities, _members
from rankloom.plans.retrieval_queries import DENSE, STEMS, _bm25_sql, _dense

from rankloom.session import cut, numbered, shared_dir, table
from rankloom.sources import store

POOL = 20
_STORED = ["strategy", "chunk_id", "doc_id", "ordinal", "text", "embed_text", "context_header", "embedding"]


def _place(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    return f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"


def _version(spark: SparkSession, folder: str, pick) -> DataFrame:
    """The first or the last row of each chunk of a strategy."""
    order = F.struct("created_at", "id")
    rows = table(spark, folder, "stored_chunks").where("strategy is not null and chunk_id is not null")
    return rows.groupBy("strategy", "chunk_id").agg(pick(F.struct(*_STORED[2:]), order).alias("r"), F.count("*").alias("times")).select("strategy", "chunk_id", "r.*", "times")


def stored_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """SNK-1, SRC-12: chunks written as they came first, then those that came again put in: their text stays, what is embedded changes."""
    path = _place(spark)
    store.upsert_chunks(path, _version(spark, folder, F.min_by).drop("times"))
    store.upsert_chunks(path, _version(spark, folder, F.max_by).where("times > 1").drop("times"))
    rows = store.read_chunks(spark, path, "advanced").unionByName(store.read_chunks(spark, path, "advanced-pro"))
    return cut(rows.select("strategy", "chunk_id", "ordinal", F.length("text").alias("n_text"), F.length("embed_text").alias("n_embedded"), F.when(F.col("embedding").isNotNull(), F.size("embedding")).otherwise(-1).alias("dimensions")))


def store_states(spark: SparkSession, folder: str) -> DataFrame:
    """SNK-2, SNK-4, SRC-14: chunks by strategy after seeding, after a strategy is cleared, and after it is seeded again."""
    path = _place(spark)
    rows = _version(spark, folder, F.max_by).drop("times")
    build = {s: lambda s=s: rows.where(F.col("strategy") == s) for s in ("advanced", "advanced-pro")}
    out = None
    for step, act in (("seeded", lambda: store.seed(spark, path, build)), ("cleared", lambda: store.clear(spark, path, "advanced-pro")), ("again", lambda: store.seed(spark, path, build))):
        act()
        now = cut(store.coverage(spark.read.parquet(path)).select(F.lit(step).alias("step"), "strategy", "chunks", "embedded"))
        out = now if out is None else out.unionByName(now)
    return out


def graph_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """SNK-3, SRC-13, GRF-14: entities and neighbours of a graph that was written and read again."""
    path = _place(spark)
    m = _members(spark, folder)
    lead = m.where("nth = 0").select("community", F.col("entity").alias("source"))
    links = G.adjacency(m.where("nth > 0").select("community", F.col("entity").alias("target")).join(lead, "community").where("source <> target"))
    store.write_graph(path, _entities(spark, folder), links, m)
    entities, near, members = store.read_graph(spark, path)
    return cut(entities.join(near.groupBy("entity").agg(F.count("*").alias("neighbours")), "entity", "left").join(members.groupBy("entity").agg(F.countDistinct("community").alias("communities")), "entity").select("entity", "degree", F.coalesce("neighbours", F.lit(0)).alias("neighbours"), "communities"))


def search_trace(spark: SparkSession, folder: str) -> DataFrame:
    """STR-7: the steps of a search with their candidates (their times differ from run to run and are left out)."""
    t = R.Trace()
    hits = t.step("dense", "best 5", _dense(spark, folder, 5))
    t.step("cut", "best 3", hits.where("rank <= 3"))
    return t.rows().select("query_id", "nth", "name", "detail", "candidates")


def dense_bm25_hybrid(spark: SparkSession, folder: str) -> DataFrame:
    """SCH-1, SCH-3, SCH-4: dense search by a community's vector and BM25 by its title over all summaries, fused."""
    c = table(spark, folder, "graph_communities")
    dense = _asked_communities(spark, folder, POOL).select("query_id", "doc_id", "score", "rank")
    asked = c.where(F.col("seq") % 50 == 0).select(F.col("seq").alias("query_id"), F.col("title").alias("text"))
    sparse = S.bm25_topk(asked, c.select(F.col("seq").alias("doc_id"), F.col("summary").alias("text")), POOL)
    return S.fuse([(dense, 1.0), (sparse, 1.0)], POOL).select("query_id", "doc_id", F.round("score", 9).alias("score"), "rank", F.size("sources").alias("lists"))


def rerank_scores(spark: SparkSession, folder: str) -> DataFrame:
    """MDL-5, STR-6: how much of a question's stems each answer holds, out of ten."""
    a = table(spark, folder, "answer_responses").where("question is not null and answer is not null").select("question", "answer").distinct()
    return a.select(F.md5("question").alias("q"), F.md5("answer").alias("a"), F.round(P.rerank_score(F.col("question"), F.col("answer")), 6).alias("score"))


def judged_answers(spark: SparkSession, folder: str) -> DataFrame:
    """MDL-3: answers judged against the question, with the question as context and the answer's strategy as reference."""
    a = table(spark, folder, "answer_responses").where("question is not null").select("question", "answer", "strategy").distinct()
    j = P.judge(F.col("question"), F.col("answer"), F.concat_ws(" ", F.lit("answer"), "question"), F.col("question"))
    return a.select(F.md5("question").alias("q"), F.md5(F.coalesce("answer", F.lit("-"))).alias("a"), "strategy", j.alias("j")).select("q", "a", "strategy", "j.*")


def community_reports(spark: SparkSession, folder: str) -> DataFrame:
    """GRF-13: every community's title and summary, which are embedded together."""
    return P.community_reports(_members(spark, folder)).select("community", "title", "summary", F.size("embedding").alias("dimensions"))


def report_points(spark: SparkSession, folder: str) -> DataFrame:
    """MDL-7: how far each community's report helps with its own title as the question."""
    reports = P.community_reports(_members(spark, folder)).select("community", "title", "summary")
    q = table(spark, folder, "graph_communities").where("title is not null").select(F.col("seq").alias("query_id"), F.col("title").alias("text"), F.col("id").alias("community"))
    return P.global_points(q, reports)


def extracted_entities(spark: SparkSession, folder: str) -> DataFrame:
    """GRF-1, AGG-10: names found in chunks, three chunks a call, merged."""
    units = numbered(_version(spark, folder, F.max_by).where("strategy = 'advanced'").select("chunk_id", "text"), ["chunk_id"], "nth")
    found = P.extract_graph(units.select("nth", F.col("chunk_id").alias("unit"), "text")).where("kind = 'entity'")
    return G.merge_entities(found.select("seq", "name", "type", "description")).select("entity", "name", "type", "degree")


QUERIES = {f.__name__: f for f in (community_reports, report_points, extracted_entities, stored_upsert, store_states, graph_round_trip, search_trace, dense_bm25_hybrid, rerank_scores, judged_answers)}

_KEPT = "from stored_chunks where strategy is not null and chunk_id is not null"
_OF = lambda column: STEMS.replace("lower(text)", f"lower({column})")
_SHARE = lambda a, b: f"coalesce(len(list_intersect(list_distinct({a}), list_distinct({b}))) / nullif(len(list_distinct({a})), 0), 0)"
_XOR = "lambda a, c: ((xor(a, c)::hugeint * {m}) % 4294967296)::bigint"
_DIGITS = "substr('0123456789abcdefghijklmnopqrstuvwxyz', (({n} // power(36, i)::bigint) % 36 + 1)::int, 1)"
SQL = {
    "community_reports": f"with {_MEM} select id as community, entity_ids[1] as title, entity_ids[1] || ': ' || array_to_string(entity_ids[1:25], ', ') as summary, 64::int as dimensions from graph_communities where len(entity_ids) > 0",
    "report_points": f"""with s as (select seq, id, {_OF('title')} as q, {_OF("(entity_ids[1] || chr(10) || entity_ids[1] || ': ' || array_to_string(entity_ids[1:25], ', '))")} as t from graph_communities where title is not null and len(entity_ids) > 0)
        select seq as query_id, id as community, round(100 * {_SHARE('q', 't')})::int as score from s""",
    "stored_upsert": f"""with v as (select strategy, chunk_id, arg_min(struct_pack(o := ordinal, t := length(text)), struct_pack(c := created_at, i := id)) as f, arg_max(struct_pack(e := length(embed_text), d := coalesce(len(embedding), -1)), struct_pack(c := created_at, i := id)) as l {_KEPT} group by 1, 2)
        select strategy, chunk_id, f.o as ordinal, f.t::int as n_text, l.e::int as n_embedded, l.d::int as dimensions from v""",
    "store_states": f"""with v as (select strategy, arg_max(coalesce(len(embedding), -1), struct_pack(c := created_at, i := id)) >= 0 as e {_KEPT} group by strategy, chunk_id), n as (select strategy, count(*) as chunks, count(*) filter (e) as embedded from v group by 1)
        select step, strategy, chunks, embedded from n, (select unnest(['seeded', 'cleared', 'again']) as step) where not (step = 'cleared' and strategy = 'advanced-pro')""",
    "graph_round_trip": f"""with {_MEM}, l as (select community, entity as source from mem where nth = 0), e as (select source, entity as target from mem join l using (community) where nth > 0 and source <> entity), near as (select source as entity, target as n from e union select target, source from e),
        c as (select entity, count(distinct community) as communities from mem group by 1), k as (select entity, count(*) as neighbours from near group by 1) select entity, degree, coalesce(neighbours, 0) as neighbours, communities from ent left join k using (entity) join c using (entity)""",
    "search_trace": f"with {DENSE}, t as (select query_id, 0 as nth, 'dense' as name, 'best 5' as detail, rank from hits union all select query_id, 1, 'cut', 'best 3', rank from hits where rank <= 3) select query_id, nth::int as nth, name, detail, count(*) as candidates from t group by 1, 2, 3, 4",
    "dense_bm25_hybrid": f"""with c as (select seq, embedding as e from graph_communities where len(embedding) = 64 and len(list_filter(embedding, lambda x: isnan(x) or abs(x) > 1e30)) = 0), s as (select a.seq as query_id, b.seq as doc_id, round(list_sum(list_transform(range(1, 65), lambda i: a.e[i]::double * b.e[i]::double)), 9) as score
        from c a join c b on a.seq % 50 = 0 and a.seq <> b.seq), b1 as (select query_id, doc_id, row_number() over (partition by query_id order by score desc, doc_id)::int as rank from s qualify row_number() over (partition by query_id order by score desc, doc_id) <= {POOL}),
        {_bm25_sql('b2', '(select seq as doc_id, summary as text from graph_communities)', '(select seq as query_id, title as text from graph_communities where seq % 50 = 0)', POOL, '_h')},
        u as (select query_id, doc_id, 0 as list, rank as pl from b1 union all select query_id, doc_id, 1, rank from b2), g as (select query_id, doc_id, round(sum(1.0::double / (60 + pl)), 12) as s, min(list * 1000 + pl) as first, count(*) as lists from u group by 1, 2)
        select query_id, doc_id, round(s, 9) as score, row_number() over (partition by query_id order by s desc, first, doc_id)::int as rank, lists::int as lists from g qualify row_number() over (partition by query_id order by s desc, first, doc_id) <= {POOL}""",
    "rerank_scores": f"""with p as (select distinct question, answer from answer_responses where question is not null and answer is not null), s as (select question, answer, {_OF('question')} as q, {_OF('answer')} as t from p)
        select md5(question) as q, md5(answer) as a, round(10 * {_SHARE('q', 't')}, 6)::double as score from s""",
    "judged_answers": f"""with p as (select distinct question, answer, strategy from answer_responses where question is not null), s as (select *, {_OF('question')} as q, coalesce({_OF('answer')}, []) as t, {_OF("('answer ' || question)")} as r, coalesce(regexp_replace(answer, '[{WS}]+', '', 'g'), '') = '' as e from p),
        o as (select *, {_SHARE('t', 'q')} as faith, {_SHARE('r', 't')} as fact, {_SHARE('q', 't')} as rel from s)
        select md5(question) as q, md5(coalesce(answer, '-')) as a, strategy, round(case when e then 0 else faith end, 6)::double as faithfulness, round(case when e then 0 else fact end, 6)::double as factual_correctness, round(case when e then 0 else rel end, 6)::double as answer_relevance,
        case when e then 'fail' when fact >= 0.75 then 'pass' when fact >= 0.4 then 'partial' else 'fail' end as verdict from o""",
    # The start values and factors of the mixes.
    "hash_ids": f"""with t as (select doc_id, text is null as none, left(coalesce(text, ''), 160) as t from documents), u as (select doc_id, none, flatten(list_transform(range(1, length(t) + 1), lambda i: case when unicode(t[i]) > 65535 then [55296 + (unicode(t[i]) - 65536) // 1024, 56320 + (unicode(t[i]) - 65536) % 1024] else [unicode(t[i])] end))::bigint[] as u from t),
        m as (select doc_id, none, list_reduce(list_concat([3735928559::bigint], u), {_XOR.format(m=2654435761)}) as a, list_reduce(list_concat([1103547991::bigint], u), {_XOR.format(m=1597334677)}) as b from u),
        n as (select doc_id, none, b, xor(((xor(a, a // 65536)::hugeint * 2246822507) % 4294967296)::bigint, ((xor(b, b // 8192)::hugeint * 3266489909) % 4294967296)::bigint) as a from m),
        o as (select doc_id, none, a, xor(((xor(b, b // 65536)::hugeint * 2246822507) % 4294967296)::bigint, ((xor(a, a // 8192)::hugeint * 3266489909) % 4294967296)::bigint) as b from n),
        j as (select doc_id, none, b, ((b::double * 4294967296.0::double + a::double)::hugeint % 4294967296)::bigint as j from o)
        select doc_id, case when not none then coalesce(nullif(ltrim(array_to_string(list_transform(range(6, -1, -1), lambda i: {_DIGITS.format(n='j')}), ''), '0'), ''), '0') || array_to_string(list_transform(range(2, -1, -1), lambda i: {_DIGITS.format(n='(b % 46656)')}), '') end as hash from j""",
}

