"""Queries on the entity graph: nations as entities, trade between them as relationships, months of orders as text units;
and the communities of graph_communities with the entities they name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rankloom.functions.text import WS
from rankloom.operators import blocks as X, graph as G, search as S
from rankloom.plans.retrieval_queries import _bm25_sql, chunks, items
from rankloom.session import cut, table


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    t = lambda n: table(spark, folder, n)
    nation = t("nation").select("n_nationkey", "n_name")
    sup = t("supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("source"))
    cust = t("customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("target"))
    orders = t("orders").select("o_orderkey", "o_custkey", "o_orderdate")
    line = t("lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate")
    j = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(sup, F.col("l_suppkey") == F.col("s_suppkey")).join(cust, F.col("o_custkey") == F.col("c_custkey"))
    return j.select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"), "source", "target", "l_quantity", F.date_format("o_orderdate", "yyyy-MM").alias("unit"))


def _raw_entities(spark: SparkSession, folder: str) -> DataFrame:
    e = _lines(spark, folder)
    messy = F.when(F.col("seq") % 3 == 0, F.lower("source")).when(F.col("seq") % 3 == 1, F.concat(F.lit(" "), "source", F.lit("  "))).otherwise(F.col("source"))
    return e.select("seq", messy.alias("name"), F.when(F.col("seq") % 2 == 0, "PLACE").alias("type"), F.concat(F.lit("trades in "), "unit", F.when(F.col("seq") % 5 == 0, " and later").otherwise("")).alias("description"))


def entity_merge(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-10, TXT-13: mentions of nations merged."""
    return G.merge_entities(_raw_entities(spark, folder))


def _relationships(spark: SparkSession, folder: str) -> DataFrame:
    raw = _lines(spark, folder).where("source not like 'A%'").select("seq", "source", "target", F.col("unit").alias("description"), (F.col("l_quantity") / 4).alias("weight"))
    known = _lines(spark, folder).select(F.upper("source").alias("entity")).where("entity <> 'CHINA'").distinct()
    return G.merge_relationships(raw, known)


def relationship_merge(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-11, JN-8, JN-9, MTH-4: trade merged by undirected pair."""
    return _relationships(spark, folder)


def adjacency(spark: SparkSession, folder: str) -> DataFrame:
    """GRF-2: neighbours of each nation."""
    return G.adjacency(_relationships(spark, folder)).groupBy("entity").agg(F.count("*").alias("neighbours"), F.min("neighbour").alias("first"))


def _units(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark, folder).where(F.col("l_quantity") > 45).select(F.col("source").alias("entity"), "unit").distinct()


def _anchors(spark: SparkSession, folder: str) -> DataFrame:
    n = table(spark, folder, "nation")
    return n.where("n_nationkey % 3 = 0").select(F.col("n_regionkey").alias("query_id"), F.col("n_name").alias("entity"))


def local_expansion(spark: SparkSession, folder: str) -> DataFrame:
    """JN-11: anchors of each region and their neighbours with weights."""
    near = G.adjacency(_lines(spark, folder).where("l_quantity > 48").select("source", "target").where("source <> target"))
    return G.expand(_anchors(spark, folder), near)


def unit_scores(spark: SparkSession, folder: str) -> DataFrame:
    """GRF-5, JN-12: months by the anchors that trade in them."""
    w = _anchors(spark, folder).withColumn("weight", F.lit(1.0))
    return G.score_units(w, _units(spark, folder)).select("query_id", "doc_id", F.round("score", 6).alias("score"))


def anchor_specificity(spark: SparkSession, folder: str) -> DataFrame:
    """GRF-6: how specific the anchors of each region are; regions without anchors have the least weight."""
    few = _anchors(spark, folder).where("query_id <> 2")
    regions = table(spark, folder, "region").select(F.col("r_regionkey").alias("query_id"))
    return G.specificity(few, _units(spark, folder), regions).select("query_id", F.round("weight", 6).alias("weight"))


def _members(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "graph_communities")
    return c.select(F.col("id").alias("community"), "community_level", F.posexplode("entity_ids").alias("nth", "entity"))


def _entities(spark: SparkSession, folder: str) -> DataFrame:
    return _members(spark, folder).groupBy("entity").agg(F.count("*").alias("degree"))


def community_rank(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-12: communities by the degrees of their members."""
    return G.community_ranks(_members(spark, folder), _entities(spark, folder))


def community_parents(spark: SparkSession, folder: str) -> DataFrame:
    """JN-13: communities with their parent's size and rank."""
    c = table(spark, folder, "graph_communities")
    up = c.select(F.col("id").alias("parent_id"), F.size("entity_ids").alias("parent_size"))
    return c.select("id", "parent_id", F.size("entity_ids").alias("size")).join(up, "parent_id", "left").select("id", "parent_id", "size", "parent_size")


def entity_matches(spark: SparkSession, folder: str) -> DataFrame:
    """JN-10, TXT-14: entities that questions name, six at most each."""
    q = items(spark, folder, 10).select(F.col("item_id").alias("query_id"), F.col("question").alias("text"))
    return G.match_entities(q, _entities(spark, folder))


def _mentioned(spark: SparkSession, folder: str) -> DataFrame:
    return G.mentions(chunks(spark, folder).select(F.col("doc_id").alias("unit"), "text"), _entities(spark, folder)).select("unit", "entity").distinct()


def entity_units(spark: SparkSession, folder: str) -> DataFrame:
    """GRF-1: in how many chunks each entity is mentioned."""
    return G.unit_counts(_mentioned(spark, folder))


def graph_local(spark: SparkSession, folder: str) -> DataFrame:
    """GRF-8: chunks supported by the entities of a question and their neighbours in communities of level 0."""
    q = items(spark, folder, 10).select(F.col("item_id").alias("query_id"), F.col("question").alias("text"))
    first = _members(spark, folder).where("community_level = 0 and nth = 0").select("community", F.col("entity").alias("source"))
    near = G.adjacency(_members(spark, folder).where("community_level = 0 and nth > 0").select("community", F.col("entity").alias("target")).join(first, "community").where("source <> target"))
    return G.local_search(q, _entities(spark, folder), near, _mentioned(spark, folder), 20)


def _asked_communities(spark: SparkSession, folder: str, k: int) -> DataFrame:
    c = table(spark, folder, "graph_communities").where("size(embedding) = 64 and not exists(embedding, x -> isnan(x) or abs(x) > 1e30)")
    return S.dense_topk(c.where("seq % 50 = 0").select(F.col("seq").alias("query_id"), "embedding"), c.select(F.col("seq").alias("doc_id"), "embedding"), k)


def community_selection(spark: SparkSession, folder: str) -> DataFrame:
    """GRF-7: the six communities closest to every fiftieth one."""
    return _asked_communities(spark, folder, 6).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def graph_global(spark: SparkSession, folder: str) -> DataFrame:
    """GRF-9: entity weights from points that communities made."""
    m = _members(spark, folder)
    points = m.select("community").distinct().select((F.length("community") % 5).alias("query_id"), "community", (F.pmod(F.length("community") * 37, F.lit(101)) - 40).alias("score"))
    return G.global_weights(points, m.select("community", "entity"))


def graph_drift(spark: SparkSession, folder: str) -> DataFrame:
    """GRF-10: entity weights from primer communities and named entities."""
    m = _members(spark, folder)
    primer = m.where("community_level > 0").select((F.length("community") % 3).alias("query_id"), "community").distinct()
    named = m.where("nth = 1 and community_level = 0").select((F.length("entity") % 3).alias("query_id"), "entity").distinct()
    return G.drift_weights(primer, m, named)


def search_modes(spark: SparkSession, folder: str) -> DataFrame:
    """GRF-12: the search a question takes by its type."""
    q = items(spark, folder, 1).select(F.col("item_id").alias("query_id"), F.when(F.col("question_type").isin("holistic", "summarization"), "broad").otherwise(F.col("question_type")).alias("category"))
    return G.search_mode(q, True, True)


def graph_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """GRF-11: local hits, and BM25 for questions that name no entity."""
    q = items(spark, folder, 10).select(F.col("item_id").alias("query_id"), F.col("question").alias("text"))
    local = cut(graph_local(spark, folder).where("rank <= 5"))
    rest = cut(q.join(local.select("query_id").distinct(), "query_id", "left_anti"))
    basic = X.bm25(rest, X.post(chunks(spark, folder).select("doc_id", "text")), 5)
    return G.with_fallback(local, basic).groupBy("query_id").agg(F.count("*").alias("n"))


def modularity(spark: SparkSession, folder: str) -> DataFrame:
    """GRF-4: how well regions divide the trade."""
    e = _lines(spark, folder).where("l_quantity > 40").groupBy("source", "target").agg(F.sum("l_quantity").alias("weight"))
    parts = table(spark, folder, "nation").select(F.col("n_name").alias("node"), F.col("n_regionkey").alias("community"))
    return G.modularity(e, parts)


def louvain_levels(spark: SparkSession, folder: str) -> DataFrame:
    """GRF-3, JN-13: nested communities of entities that follow each other in communities of level 0."""
    from pyspark.sql import Window

    w = Window.partitionBy("community").orderBy("nth")
    pairs = _members(spark, folder).where("community_level = 0").withColumn("target", F.lead("entity").over(w)).where("target is not null")
    edges = pairs.groupBy(F.col("entity").alias("source"), "target").agg(F.count("*").cast("double").alias("weight"))
    nodes = _entities(spark, folder).select(F.col("entity").alias("node"), F.row_number().over(Window.orderBy("entity")).cast("long").alias("pos"))
    return G.louvain(nodes, edges)


QUERIES = {
    f.__name__: f
    for f in (
        entity_merge, relationship_merge, adjacency, local_expansion, unit_scores, anchor_specificity, community_rank, community_parents, entity_matches, entity_units, graph_local, community_selection, graph_global, graph_drift, search_modes,
        graph_fallback, modularity, louvain_levels,
    )
}

LINES = """lines as (select l_orderkey * 100 + l_linenumber as seq, sn.n_name as source, cn.n_name as target, l_quantity, strftime(o_orderdate, '%Y-%m') as unit from lineitem join orders on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey join nation sn on s_nationkey = sn.n_nationkey
    join customer on o_custkey = c_custkey join nation cn on c_nationkey = cn.n_nationkey)"""
_REL = """rel as (select least(source, target) as a, greatest(source, target) as b, arg_min(source, seq) as source, arg_min(target, seq) as target, arg_min(unit, seq) as description, max(least(10, greatest(1, l_quantity / 4)))::double as weight, count(*) as mentions
    from lines where source not like 'A%' and source <> target and upper(source) <> 'CHINA' and upper(target) <> 'CHINA' group by 1, 2)"""
_UNITS = "units as (select distinct source as entity, unit from lines where l_quantity > 45), un as (select entity, count(*) as n from units group by 1), anc as (select n_regionkey as query_id, n_name as entity from nation where n_nationkey % 3 = 0)"
_MEM = "mem as (select id as community, community_level, unnest(entity_ids) as entity, generate_subscripts(entity_ids, 1) - 1 as nth from graph_communities), ent as (select entity, count(*) as degree from mem group by 1)"
_NAME = lambda c: f"trim(regexp_replace(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}{WS}]', ' ', 'g'), '[{WS}]+', ' ', 'g'))"
_Q10 = "q as (select id as query_id, question from evaluation_items where pos % 10 = 0 qualify row_number() over (partition by id order by loaded_at desc) = 1)"
_MATCH = f"named as (select query_id, entity, length({_NAME('entity')}) * 10 + degree as score from q, ent where length({_NAME('entity')}) >= 3 and contains(' ' || {_NAME('question')} || ' ', ' ' || {_NAME('entity')} || ' ')), anchors as (select *, row_number() over (partition by query_id order by score desc, entity)::int as rank from named qualify rank <= 6)"
_CHUNKS = "chunks as (select chunk_id as unit, text from stored_chunks where strategy = 'advanced' qualify row_number() over (partition by chunk_id order by created_at desc, id desc) = 1)"
_MENTIONED = f"mentioned as (select unit, entity from (select unit, ' ' || {_NAME('text')} || ' ' as t from chunks), (select entity, ' ' || {_NAME('entity')} || ' ' as e from ent) where contains(t, e)), mc as (select entity, count(*) as n from mentioned group by 1)"
_NEAR = """first as (select community, entity as source from mem where community_level = 0 and nth = 0), e1 as (select source, entity as target from mem join first using (community) where community_level = 0 and nth > 0 and source <> entity),
    near as (select source as entity, target as neighbour from e1 union select target, source from e1)"""
_LOCAL = f"""{_NEAR}, w as (select query_id, entity, round(sum(weight), 9) as weight from (select query_id, entity, 1.0::double as weight from anchors union all select query_id, neighbour, 0.4 from anchors join near using (entity)) group by 1, 2),
    local as (select query_id, unit as doc_id, round(sum(weight / log2(2 + n)), 9) as score from w join mc using (entity) join mentioned using (entity) group by 1, 2), lr as (select *, row_number() over (partition by query_id order by score desc, doc_id)::int as rank from local qualify rank <= 20)"""

SQL = {
    "entity_merge": f"""with {LINES}, raw as (select seq, source as name, case when seq % 3 = 0 then lower(source) else source end as shown, case when seq % 2 = 0 then 'PLACE' end as type, 'trades in ' || unit || case when seq % 5 = 0 then ' and later' else '' end as d from lines)
        select upper(name) as entity, arg_min(shown, seq) as name, coalesce(arg_min_null(type, seq), 'CONCEPT') as type, arg_max(d, length(d) * 1000000000000 - seq) as description, count(*) as degree from raw group by 1""",
    "relationship_merge": f"with {LINES}, {_REL} select * from rel",
    "adjacency": f"with {LINES}, {_REL}, n as (select source as entity, target as neighbour from rel union select target, source from rel) select entity, count(*) as neighbours, min(neighbour) as first from n group by 1",
    "local_expansion": f"""with {LINES}, {_UNITS}, e as (select distinct source, target from lines where l_quantity > 48 and source <> target), near as (select source as entity, target as neighbour from e union select target, source from e)
        select query_id, entity, round(sum(weight), 9) as weight from (select query_id, entity, 1.0::double as weight from anc union all select query_id, neighbour, 0.4 from anc join near using (entity)) group by 1, 2""",
    "unit_scores": f"with {LINES}, {_UNITS} select query_id, unit as doc_id, round(round(sum(1 / log2(2 + n)), 9), 6) as score from anc join un using (entity) join units using (entity) group by 1, 2",
    "anchor_specificity": f"with {LINES}, {_UNITS}, m as (select query_id, avg(1 / log2(2 + coalesce(n, 0))) as mean from anc left join un using (entity) where query_id <> 2 group by 1) select r_regionkey as query_id, round(case when mean is null then 0.6 else 0.6 + 1.0 * least(1, mean / 0.63) end, 6)::double as weight from region left join m on query_id = r_regionkey",
    "community_rank": f"with {_MEM} select community, sum(degree)::bigint as rank, count(*) as size from mem join ent using (entity) group by 1 having count(*) >= 2",
    "community_parents": "select c.id, c.parent_id, len(c.entity_ids)::int as size, len(p.entity_ids)::int as parent_size from graph_communities c left join graph_communities p on p.id = c.parent_id",
    "entity_matches": f"with {_MEM}, {_Q10}, {_MATCH} select query_id, entity, score, rank from anchors",
    "entity_units": f"with {_MEM}, {_CHUNKS}, {_MENTIONED} select entity, n from mc",
    "graph_local": f"with {_MEM}, {_Q10}, {_MATCH}, {_CHUNKS}, {_MENTIONED}, {_LOCAL} select query_id, doc_id, score, rank from lr",
    "graph_fallback": f"with {_MEM}, {_Q10}, {_MATCH}, {_CHUNKS}, {_MENTIONED}, {_LOCAL}, {_bm25_sql('gb', '(select unit as doc_id, text from chunks)', '(select query_id, question as text from q)', 5, '_g')}, l5 as (select query_id from lr where rank <= 5), u as (select query_id from l5 union all select query_id from gb where query_id not in (select query_id from l5)) select query_id, count(*) as n from u group by 1",
    "community_selection": """with c as (select seq, embedding as e from graph_communities where len(embedding) = 64 and len(list_filter(embedding, lambda x: isnan(x) or abs(x) > 1e30)) = 0), s as (select a.seq as query_id, b.seq as doc_id, round(list_sum(list_transform(range(1, 65), lambda i: a.e[i]::double * b.e[i]::double)), 9) as score
        from c a join c b on a.seq % 50 = 0 and a.seq <> b.seq) select query_id, doc_id, round(score, 6) as score, row_number() over (partition by query_id order by score desc, doc_id)::int as rank from s qualify row_number() over (partition by query_id order by score desc, doc_id) <= 6""",
    "graph_global": f"with {_MEM}, p as (select distinct length(community) % 5 as query_id, community, length(community) * 37 % 101 - 40 as score from mem) select query_id::int as query_id, entity, round(sum(score / 100), 9) as weight from p join mem using (community) where score > 0 group by 1, 2",
    "graph_drift": f"""with {_MEM}, p as (select distinct length(community) % 3 as query_id, community from mem where community_level > 0), n as (select distinct length(entity) % 3 as query_id, entity from mem where nth = 1 and community_level = 0)
        select query_id::int as query_id, entity, max(weight) as weight from (select query_id, entity, 0.5::double as weight from p join mem using (community) where nth < 12 union all select query_id, entity, 1.0 from n) group by 1, 2""",
    "search_modes": "select id as query_id, case when coalesce(question_type, 'other') in ('holistic', 'summarization') then 'broad' else coalesce(question_type, 'other') end as category, case when question_type in ('holistic', 'summarization') then 'global' when question_type = 'multi_hop' then 'drift' else 'local' end as mode from evaluation_items where pos is not null qualify row_number() over (partition by id order by loaded_at desc) = 1",
    "modularity": f"""with {LINES}, e as (select source, target, sum(l_quantity) as w from lines where l_quantity > 40 group by 1, 2), j as (select e.w, s.n_regionkey as cs, t.n_regionkey as ct from e join nation s on s.n_name = source join nation t on t.n_name = target), m as (select sum(w) as m from j),
        p as (select c, sum(w) as d, sum(i) as i from (select cs as c, w, case when cs = ct then w else 0 end as i from j union all select ct, w, 0 from j) group by 1) select round(sum(i / m - pow(d / (2 * m), 2)), 9) as modularity from p, m""",
}
