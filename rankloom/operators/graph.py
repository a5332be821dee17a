"""The entity graph: mentions, merged entities and relationships, communities, and search over them.

Entities hold no lists: which units mention an entity is a table of its own, so that a hub costs rows, not one huge cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from rankloom.functions import text as T, vectors as V
from rankloom.operators import blocks as X
from rankloom.session import cut, numbered, small_or_join

ANCHORS = 6
NEIGHBOUR = 0.4
LOW, HIGH, CEILING = 0.6, 1.6, 0.63
# Levels of communities, the least gain that counts, sweeps over all nodes.
LEVELS, GAIN, SWEEPS = 4, 1e-6, 20


def phrases(texts: DataFrame, key: str, column: str, lengths: list[int]) -> DataFrame:
    """(key, at, phrase): all runs of the given numbers of words of a text in the form of entity names, with their places."""
    words = F.split(T.entity_name(F.col(column)), " ")
    base = texts.select(key, words.alias("w")).where(F.col("w").isNotNull())
    at = base.select(key, "w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("at"))
    runs = F.array(*[F.when(F.col("at") + n - 1 <= F.size("w"), F.array_join(F.slice("w", F.col("at"), n), " ")) for n in lengths])
    return at.select(key, "at", F.explode(runs).alias("phrase")).where("phrase is not null")


def mentions(units: DataFrame, names: DataFrame) -> DataFrame:
    """(unit, at, entity): where the units (unit, text) mention entities (entity), by names of any length, found by an equi-join.

    Runs are built of the numbers of words that the names have, and only where a name's first word stands; of entities whose names
    read alike each is found.
    """
    known = cut(names.select("entity", T.entity_name(F.col("entity")).alias("phrase")).where(F.length("phrase") >= 3).distinct())
    words = F.split(T.entity_name(F.col("text")), " ")
    heads = cut(known.groupBy(F.split("phrase", " ")[0].alias("word")).agg(F.collect_set(F.size(F.split("phrase", " "))).alias("lengths")))
    longest = heads.agg(F.max(F.array_max("lengths"))).first()[0] or 1
    base = units.select("unit", words.alias("w")).where(F.col("w").isNotNull())
    starts = base.select("unit", "w", F.posexplode("w").alias("p", "word")).select("unit", (F.col("p") + 1).alias("at"), "word", F.slice("w", F.col("p") + 1, F.lit(longest)).alias("w"))
    runs = starts.join(small_or_join(heads), "word").select("unit", "at", "w", F.explode("lengths").alias("n")).where(F.col("n") <= F.size("w"))
    return runs.select("unit", "at", F.array_join(F.slice("w", F.lit(1), F.col("n")), " ").alias("phrase")).join(small_or_join(known), "phrase").select("unit", "at", "entity")


def merge_entities(raw: DataFrame) -> DataFrame:
    """Mentions (seq, name, type, description) merged by key: first name and type, longest description (of equal ones the first), number of mentions.

    Blank names are dropped; a missing type is CONCEPT.
    """
    named = raw.where(T.trim_all(F.col("name")) != "").withColumn("entity", T.entity_key(F.col("name")))
    d = F.coalesce("description", F.lit(""))
    return named.groupBy("entity").agg(
        F.min_by(T.trim_all(F.col("name")), "seq").alias("name"), F.coalesce(F.min_by("type", "seq"), F.lit("CONCEPT")).alias("type"), F.max_by(d, F.struct(F.length(d), -F.col("seq"))).alias("description"), F.count("*").alias("degree")
    )


def merge_relationships(raw: DataFrame, entities: DataFrame) -> DataFrame:
    """Relationships (seq, source, target, description, weight) merged by undirected pair: first direction and description, greatest weight.

    Loops and pairs with an end that is no entity are dropped.
    """
    keyed = raw.select("seq", T.entity_key(F.col("source")).alias("s"), T.entity_key(F.col("target")).alias("t"), "description", V.clamp_weight(F.col("weight")).alias("weight")).where("s <> t")
    known = entities.select("entity")
    valid = keyed.join(known.withColumnRenamed("entity", "s"), "s", "left_semi").join(known.withColumnRenamed("entity", "t"), "t", "left_semi")
    return valid.groupBy(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b")).agg(
        F.min_by("s", "seq").alias("source"), F.min_by("t", "seq").alias("target"), F.min_by("description", "seq").alias("description"), F.max("weight").alias("weight"), F.count("*").alias("mentions")
    )


def adjacency(relationships: DataFrame) -> DataFrame:
    """(entity, neighbour) in both directions, each once."""
    one = relationships.select(F.col("source").alias("entity"), F.col("target").alias("neighbour"))
    return one.union(one.select("neighbour", "entity")).distinct()


def unit_counts(units: DataFrame) -> DataFrame:
    """(entity, n): in how many units an entity is mentioned; units: entity, unit."""
    return units.select("entity", "unit").distinct().groupBy("entity").agg(F.count("*").alias("n"))


def score_units(weights: DataFrame, units: DataFrame) -> DataFrame:
    """(query_id, doc_id, score): the weight each entity has for a query, damped by how many units mention it, summed over units."""
    pairs = units.select("entity", "unit").distinct()
    damped = weights.join(unit_counts(units), "entity").select("query_id", "entity", (F.col("weight") / F.log2(2 + F.col("n"))).alias("w"))
    return damped.join(pairs, "entity").groupBy("query_id", F.col("unit").alias("doc_id")).agg(F.round(F.sum("w"), 9).alias("score"))


def specificity(anchors: DataFrame, units: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, weight): how far a query's anchors pin the answer down, from 0.6 (hubs, or none) to 1.6."""
    rare = anchors.join(unit_counts(units), "entity", "left").groupBy("query_id").agg(F.avg(1 / F.log2(2 + F.coalesce("n", F.lit(0)))).alias("mean"))
    share = F.when(F.col("mean").isNotNull(), F.least(F.lit(1.0), F.col("mean") / CEILING))
    return queries.select("query_id").join(rare, "query_id", "left").select("query_id", F.round(F.coalesce(LOW + (HIGH - LOW) * share, F.lit(LOW)), 9).alias("weight"))


def match_entities(questions: DataFrame, entities: DataFrame, limit: int = ANCHORS) -> DataFrame:
    """(query_id, entity, score, rank): the entities a question names, longer names and better connected ones first."""
    hits = mentions(questions.select(F.col("query_id").alias("unit"), "text"), entities).select(F.col("unit").alias("query_id"), "entity").distinct()
    scored = hits.join(entities.select("entity", "degree"), "entity").select("query_id", "entity", (F.length(T.entity_name(F.col("entity"))) * 10 + F.col("degree")).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "entity")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def expand(anchors: DataFrame, near: DataFrame) -> DataFrame:
    """(query_id, entity, weight): each anchor counts 1, each neighbour of one 0.4, summed."""
    own = anchors.select("query_id", "entity", F.lit(1.0).alias("weight"))
    beside = anchors.select("query_id", "entity").join(near, "entity").select("query_id", F.col("neighbour").alias("entity"), F.lit(NEIGHBOUR).alias("weight"))
    return own.unionByName(beside).groupBy("query_id", "entity").agg(F.round(F.sum("weight"), 9).alias("weight"))


def local_search(questions: DataFrame, entities: DataFrame, near: DataFrame, units: DataFrame, k: int) -> DataFrame:
    """The units best supported by the entities a question names and their neighbours; a question without anchors has none."""
    return best_units(cut(match_entities(questions, entities)), near, units, k)


def best_units(anchors: DataFrame, near: DataFrame, units: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best of score_units(expand(anchors, near), units), without a row for each query and unit.

    Queries with the same anchors have the same units, so each set of anchors is searched once, over an index of the units' entities.
    """
    pairs = units.select("entity", "unit").distinct()
    held = pairs.sparkSession.read.parquet(X.keep(pairs.groupBy("unit").agg(F.collect_list("entity").alias("names"))))
    counts = held.select(F.explode("names").alias("entity")).groupBy("entity").agg(F.count("*").alias("n"))
    named = cut(anchors.groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_set("entity")), "\u0001").alias("set")))
    each = named.select(F.col("set").alias("query_id")).distinct().select("query_id", F.explode(F.split("query_id", "\u0001")).alias("entity"))
    damped = expand(each, near).join(counts, "entity").select("query_id", F.struct(F.xxhash64("entity").alias("term"), (F.col("weight") / F.log2(2 + F.col("n"))).alias("w")).alias("t"))
    asked = damped.groupBy("query_id").agg(F.collect_list("t").alias("t")).select("query_id", F.transform("t", lambda x: x["term"]).alias("terms"), F.transform("t", lambda x: x["w"]).alias("weights"))
    hits = X.search(asked, X.post_sets(held.select(F.col("unit").alias("doc_id"), "names")), k).select(F.col("query_id").alias("set"), "doc_id", "score", "rank")
    return named.join(hits, "set").select("query_id", "doc_id", "score", "rank")


def global_weights(points: DataFrame, members: DataFrame) -> DataFrame:
    """(query_id, entity, weight) from the points (query_id, community, score of 0..100) communities made: those above 0, summed over members (community, entity)."""
    return points.where("score > 0").join(members, "community").groupBy("query_id", "entity").agg(F.round(F.sum(F.col("score") / 100), 9).alias("weight"))


def drift_weights(primer: DataFrame, members: DataFrame, named: DataFrame, most: int = 12) -> DataFrame:
    """(query_id, entity, weight): named entities count 1, the first ``most`` members (nth from 0) of primer communities 0.5."""
    led = primer.join(members.where(F.col("nth") < most), "community").select("query_id", "entity", F.lit(0.5).alias("weight"))
    return led.unionByName(named.select("query_id", "entity", F.lit(1.0).alias("weight"))).groupBy("query_id", "entity").agg(F.max("weight").alias("weight"))


def search_mode(routes: DataFrame, has_graph: bool, has_communities: bool) -> DataFrame:
    """The search each route (query_id, category) takes: basic without a graph, global for broad ones, drift for those of many hops, else local."""
    if not has_graph:
        return routes.withColumn("mode", F.lit("basic"))
    broad = F.lit("global") if has_communities else F.lit("local")
    hops = F.lit("drift") if has_communities else F.lit("local")
    return routes.withColumn("mode", F.when(F.col("category") == "broad", broad).when(F.col("category") == "multi_hop", hops).otherwise(F.lit("local")))


def with_fallback(hits: DataFrame, basic: DataFrame) -> DataFrame:
    """Hits, and for queries without any those of the basic search."""
    return hits.unionByName(basic.join(hits.select("query_id").distinct(), "query_id", "left_anti"))


def community_ranks(members: DataFrame, entities: DataFrame) -> DataFrame:
    """(community, rank, size): the summed degrees of its members; communities of fewer than two are dropped."""
    return members.join(entities.select("entity", "degree"), "entity", "left").groupBy("community").agg(F.coalesce(F.sum("degree"), F.lit(0)).alias("rank"), F.count("*").alias("size")).where("size >= 2")


def community_prompts(members: DataFrame, entities: DataFrame, relationships: DataFrame, most: int = 30, first: int = 25, edges: int = 30) -> DataFrame:
    """GRF-13: (community, rank, prompt) of the best ranked communities: their first members and the heaviest relationships inside.

    members: community, nth, entity; relationships: source, target, weight.
    """
    best = community_ranks(members, entities).orderBy(F.desc("rank"), "community").limit(most)
    inside = members.join(F.broadcast(best.select("community", "rank")), "community")
    named = inside.where(F.col("nth") < first).groupBy("community", "rank").agg(F.sort_array(F.collect_list(F.struct("nth", "entity"))).alias("m"))
    ends = inside.select("community", "entity")
    links = ends.withColumnRenamed("entity", "source").join(relationships, "source").join(ends.withColumnRenamed("entity", "target"), ["community", "target"])
    w = Window.partitionBy("community").orderBy(F.desc("weight"), "source", "target")
    top_links = links.withColumn("place", F.row_number().over(w)).where(F.col("place") <= edges).groupBy("community").agg(F.sort_array(F.collect_list(F.struct("place", F.concat_ws(" - ", "source", "target").alias("line")))).alias("r"))
    lines = lambda c, f: F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x[f])), "\n")
    prompt = F.concat(F.lit("Entities:\n"), lines("m", "entity"), F.lit("\nRelationships:\n"), F.coalesce(lines("r", "line"), F.lit("")))
    return named.join(top_links, "community", "left").select("community", "rank", prompt.alias("prompt"))


def modularity(edges: DataFrame, members: DataFrame) -> DataFrame:
    """The modularity of a partition (node, community) of edges (source, target, weight), as one row."""
    w = F.when(F.col("weight") > 0, F.col("weight").cast("double")).otherwise(1.0)
    j = edges.select("source", "target", w.alias("w")).join(members.select(F.col("node").alias("source"), F.col("community").alias("cs")), "source").join(members.select(F.col("node").alias("target"), F.col("community").alias("ct")), "target")
    total = j.agg(F.sum("w").alias("m"))
    ends = j.select(F.explode(F.array(F.struct(F.col("cs").alias("c"), "w", F.when(F.col("cs") == F.col("ct"), F.col("w")).otherwise(0.0).alias("inner")), F.struct(F.col("ct").alias("c"), "w", F.lit(0.0).alias("inner")))).alias("e")).select("e.*")
    per = ends.groupBy("c").agg(F.sum("w").alias("degree"), F.sum("inner").alias("inner"))
    return per.crossJoin(F.broadcast(total)).agg(F.round(F.sum(F.col("inner") / F.col("m") - F.pow(F.col("degree") / (2 * F.col("m")), 2)), 9).alias("modularity"))


def _links(edges: DataFrame) -> DataFrame:
    """Undirected edges (source, target, w) in both directions, parallel ones summed; a loop counts in one row."""
    e = edges.select("source", "target", "w")
    turned = e.where("source <> target").select(F.col("target").alias("source"), F.col("source").alias("target"), "w")
    return cut(e.unionByName(turned).groupBy("source", "target").agg(F.sum("w").alias("w")))


def _settled(links: DataFrame, twice: float, sweeps: int = SWEEPS) -> DataFrame:
    """(node, community): nodes moved to the neighbouring community of largest gain until no move pays; ``twice``: the weight of all ends.

    A sweep has two turns; by a hash of node and sweep a node moves in one of them, so that two neighbours rarely swap places.
    A turn is three aggregates and joins over all links, whatever the shape of the graph. Of equal gains the smaller community wins.
    """
    ends = F.when(F.col("source") == F.col("target"), 2 * F.col("w")).otherwise(F.col("w"))
    state = cut(links.groupBy(F.col("source").alias("node")).agg(F.sum(ends).alias("k")).withColumn("community", F.col("node")))
    outward = links.where("source <> target")
    still = 0
    for turn in range(2 * sweeps):
        mine = F.pmod(F.xxhash64("node", F.lit(turn // 2)), F.lit(2)) == turn % 2
        mass = state.groupBy("community").agg(F.sum("k").alias("mass"))
        toward = outward.withColumnRenamed("source", "node").where(mine).join(state.select(F.col("node").alias("target"), "community"), "target").select("node", "community", "w")
        own = state.where(mine).select("node", "community", F.lit(0.0).alias("w"))
        options = toward.unionByName(own).groupBy("node", "community").agg(F.sum("w").alias("w"))
        judged = options.join(mass, "community").join(state.select("node", "k", F.col("community").alias("now")), "node")
        stays = F.col("community") == F.col("now")
        gain = F.col("w") - (F.col("mass") - F.when(stays, F.col("k")).otherwise(0.0)) * F.col("k") / twice
        best = judged.select("node", "k", "now", "community", stays.alias("stays"), F.round(gain, 9).alias("gain")).groupBy("node").agg(
            F.first("k").alias("k"), F.first("now").alias("now"), F.min_by("community", F.struct(-F.col("gain"), "community")).alias("next"), F.max("gain").alias("best"), F.max(F.when(F.col("stays"), F.col("gain"))).alias("stay"))
        pays = F.col("best") > F.col("stay") + GAIN
        turned = best.select("node", "k", F.when(pays, F.col("next")).otherwise(F.col("now")).alias("community"), pays.alias("moved"))
        after = cut(turned.unionByName(state.where(~mine).withColumn("moved", F.lit(False))), bare=True)
        moved = not after.where("moved").isEmpty()
        state = after.drop("moved")
        still = 0 if moved else still + 1
        if still == 2:
            break
    return state.select("node", "community")


def louvain(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(level, node, community): nested communities of nodes (node, pos) by edges (source, target, weight), LEVELS at most.

    One way for graphs of every size and shape: on each level the nodes of the level before (first the nodes themselves) move
    by joins until no move pays, then each community becomes a node; it ends when nothing is merged or one community is left. All nodes of
    a turn decide by the state before it, so where gains are equal or close communities can differ from those of one node after
    the other. Edges with unknown ends are ignored, weights that aren't positive count 1, nodes without edges are alone; without edges there
    is no level. Names are c{level}_{n}, n in the order of the smallest pos.
    """
    w = F.when(F.col("weight") > 0, F.col("weight").cast("double")).otherwise(1.0)
    known = cut(nodes.select(F.col("node").cast("string").alias("node"), F.col("pos").cast("long").alias("pos")))
    number = lambda end: edges_.join(known.select(F.col("node").alias(end), F.col("pos").alias(f"{end}_pos")), end)
    edges_ = edges.select(F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target"), w.alias("w"))
    edges_ = number("source")
    edges_ = number("target").select(F.col("source_pos").alias("source"), F.col("target_pos").alias("target"), "w")
    links = _links(edges_)
    twice = links.agg(F.sum(F.when(F.col("source") == F.col("target"), 2 * F.col("w")).otherwise(F.col("w")))).first()[0]
    out = nodes.sparkSession.createDataFrame([], "level int, node string, community string")
    at = known.withColumn("now", F.col("pos"))
    size = known.count()
    for level in range(LEVELS if twice else 0):
        found = _settled(links, twice)
        joined = at.join(found.withColumnRenamed("node", "now"), "now", "left").select("node", "pos", F.coalesce("community", "now").alias("group"))
        named = numbered(joined.groupBy("group").agg(F.min("pos").alias("first")), ["first"], "n")
        at = cut(joined.join(named, "group").select("node", "pos", "n", F.col("first").alias("now"), "group"))
        merged = at.select("now").distinct().count()
        if merged == size:
            break
        out = out.unionByName(at.select(F.lit(level).alias("level"), "node", F.concat(F.lit(f"c{level}_"), F.col("n").cast("string")).alias("community")))
        if merged == 1:
            break
        of = found.join(named.select(F.col("group").alias("community"), "first"), "community").select("node", "first")
        ends = links.join(of.select(F.col("node").alias("source"), F.col("first").alias("s")), "source").join(of.select(F.col("node").alias("target"), F.col("first").alias("t")), "target")
        inner = F.when((F.col("s") == F.col("t")) & (F.col("source") != F.col("target")), F.col("w") / 2).otherwise(F.col("w"))  # an inner edge stands in both directions
        links = cut(ends.groupBy(F.col("s").alias("source"), F.col("t").alias("target")).agg(F.sum(inner).alias("w")))
        at, size = at.select("node", "pos", "now"), merged
    return out


def parents(membership: DataFrame) -> DataFrame:
    """(community, level, parent): the community one level up that holds its members."""
    up = membership.select("node", (F.col("level") - 1).alias("level"), F.col("community").alias("parent"))
    return membership.join(up, ["node", "level"], "left").groupBy("level", "community").agg(F.min("parent").alias("parent"))
