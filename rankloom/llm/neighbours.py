"""The k most similar vectors for every vector: a neighbour graph by NN-descent, and greedy search on it.

Vectors are normalised and travel in half precision. Equal vectors form a class that is one node of the graph. The
graph has a weak start (a few partitions of the space by random hyperplanes, compared inside their small cells) and improves by joins
of neighbours with neighbours until hardly anything changes: each node gathers those it points to and those that point to it, and tells
each of them about closer ones among the others. Nothing is fitted, and one way holds at every size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from rankloom.session import cut, small_or_join

DIMENSIONS = 64
K = 5
#: The space is parted in WAYS ways by hyperplanes, so many that a cell has about CELL vectors.
WAYS, CELL = 8, 256
#: A cell of more vectors is halved by further hyperplanes, and by hash where those don't part it.
MAX_CELL = 2_000
#: Neighbours kept of each node while the graph is built.
LIST = 5
#: Rounds go on, two at least, until one changes at most this share of the edges.
SETTLED, ROUNDS = 0.02, 2
PLANES = 62
#: A node that more than so many others point to gathers them in groups of about this size.
HUB = 64


def _unit(batches: Iterator[pd.DataFrame], dimensions: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        fits = pdf["embedding"].map(lambda v: v is not None and len(v) == dimensions).to_numpy(bool)
        keys = pdf["key"].to_numpy()[fits]
        if not len(keys):
            continue
        m = np.stack(pdf["embedding"].to_numpy()[fits]).astype(np.float64)
        fine = np.isfinite(m).all(1)
        m, keys = m[fine], keys[fine]
        largest = np.abs(m).max(1)
        some = largest > 0
        m, keys = m[some] / largest[some, None], keys[some]
        m = (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float16) + np.float16(0)  # no negative zero
        yield pd.DataFrame({"key": keys, "vec": [v.tobytes() for v in m]})


def usable(rows: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """key and vec of every embedding that has ``dimensions`` finite values, not all zero; a key counts once."""
    return rows.select("key", "embedding").dropDuplicates(["key"]).mapInPandas(lambda it: _unit(it, dimensions), "key bigint, vec binary")


def _matrix(column, dimensions: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float16).reshape(-1, dimensions).astype(np.float32)


def _assign(planes: np.ndarray, dimensions: int):
    """The side of every hyperplane on which a vector lies, as the bits of a number for each way."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                m = _matrix(pdf["vec"], dimensions)
                sides = [((m @ p.T) > 0) @ (1 << np.arange(PLANES, dtype=np.int64)) for p in planes]
                yield pd.DataFrame({"key": np.tile(pdf["key"].to_numpy(), WAYS), "vec": np.tile(pdf["vec"].to_numpy(), WAYS), "way": np.repeat(np.arange(WAYS), len(pdf)), "sides": np.concatenate(sides)})

    return run


def _groups(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Sorted batches cut anew, so that no group of equal keys is split."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        last = pdf[key].iloc[-1]
        tail = int(np.searchsorted(pdf[key].to_numpy(), last))
        if tail:
            yield pd.concat([*held, pdf.iloc[:tail]], ignore_index=True)
            held = [pdf.iloc[tail:]]
        elif held and held[0][key].iloc[0] != last:
            yield pd.concat(held, ignore_index=True)
            held = [pdf]
        else:
            held.append(pdf)
    if held:
        yield pd.concat(held, ignore_index=True)


def _best(m: np.ndarray, keys: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For blocks of vectors the k most similar others among all of m."""
    k = min(k, len(m) - 1)
    for a in range(0, len(m), 1024):
        s = m[a : a + 1024] @ m.T
        s[np.arange(len(s)), a + np.arange(len(s))] = -9
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        yield np.repeat(keys[a : a + 1024], k), keys[top].ravel(), np.take_along_axis(s, top, 1).ravel()


EDGES = "key bigint, other bigint, sim float"


def _in_cells(k: int, dimensions: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _groups(batches, "part"):
            parts = pdf["part"].to_numpy()
            edges = np.flatnonzero(np.diff(parts)) + 1
            for a, b in zip([0, *edges], [*edges, len(parts)]):
                if b - a > 1:
                    m = _matrix(pdf["vec"].iloc[a:b], dimensions)
                    for x, y, s in _best(m, pdf["key"].to_numpy()[a:b], k):
                        yield pd.DataFrame({"key": x, "other": y, "sim": s})

    return run


def top(edges: DataFrame, k: int) -> DataFrame:
    """The k best edges of each node; of equal similarity the smaller key first. One shuffle serves both the copies and the ranking."""
    w = Window.partitionBy("key").orderBy(F.desc("sim"), "other")
    return edges.repartition("key").groupBy("key", "other").agg(F.max("sim").alias("sim")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rank")


def start(vectors: DataFrame, total: int, k: int, dimensions: int) -> DataFrame:
    """The first graph: the k most similar among those of the same cells."""
    planes = np.random.default_rng(11).standard_normal((WAYS, PLANES, dimensions)).astype(np.float32)
    bits = min(PLANES, max(0, int(np.ceil(np.log2(max(1, total) / CELL)))))
    low = lambda n: F.col("sides").bitwiseAND((F.pow(F.lit(2.0), n) - 1).cast("bigint"))
    placed = vectors.mapInPandas(_assign(planes, dimensions), "key bigint, vec binary, way int, sides bigint").withColumn("cell", low(F.lit(bits)))
    more = F.least(F.lit(PLANES - bits), F.ceil(F.log2(F.col("n") / MAX_CELL))).cast("int")
    large = placed.groupBy("way", "cell").agg(F.count("*").alias("n")).where(F.col("n") > MAX_CELL).select("way", "cell", more.alias("more"))
    halved = placed.join(small_or_join(cut(large)), ["way", "cell"], "left").withColumn("more", F.coalesce("more", F.lit(0))).withColumn("cell", low(bits + F.col("more"))).withColumn("own", F.xxhash64("way", "more", "cell"))
    crowded = halved.where("more > 0").groupBy("own").agg(F.count("*").alias("n")).where(F.col("n") > 2 * MAX_CELL).select("own", F.ceil(F.col("n") / MAX_CELL).alias("shares"))
    cells = halved.join(small_or_join(cut(crowded)), "own", "left").select("key", "vec", F.xxhash64("own", F.pmod(F.xxhash64("key", "way"), F.coalesce("shares", F.lit(1)))).alias("part"))
    inside = cells.repartition("part").sortWithinPartitions("part").mapInPandas(_in_cells(k, dimensions), EDGES)
    return top(inside, k)


TOLD = "key bigint, other bigint, sim float"


def _tell(k: int, dimensions: int):
    """For every node the members it gathered, each with its worst similarity and its neighbours: emits closer pairs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _groups(batches, "centre"):
            centre = pdf["centre"].to_numpy()
            m, keys = _matrix(pdf["vec"], dimensions), pdf["key"].to_numpy()
            worst = pdf["worst"].to_numpy(np.float32)
            near = np.frombuffer(b"".join(pdf["near"]), ">i8").reshape(-1, k)
            fresh = pdf["fresh"].to_numpy(bool)
            first = np.flatnonzero(np.r_[True, centre[1:] != centre[:-1]])
            size = np.diff(np.r_[first, len(centre)])
            for n in np.unique(size[size > 1]).tolist():
                rows = first[size == n]
                for a in range(0, len(rows), max(1, 400_000 // (n * n))):
                    at = rows[a : a + max(1, 400_000 // (n * n)), None] + np.arange(n)
                    s = m[at] @ m[at].transpose(0, 2, 1)
                    g, i, j = np.nonzero((s > worst[at][:, :, None] + 1e-6) & (fresh[at][:, :, None] | fresh[at][:, None, :]))
                    i_at, j_at = at[g, i], at[g, j]
                    new = (keys[i_at] != keys[j_at]) & (near[i_at] != keys[j_at][:, None]).all(1)
                    if new.any():
                        told = pd.DataFrame({"key": keys[i_at[new]], "other": keys[j_at[new]], "sim": s[g, i, j][new]}).drop_duplicates(["key", "other"]).sort_values(["key", "sim", "other"], ascending=[True, False, True])
                        yield told[told.groupby("key").cumcount() < k]  # no more than k of a node can stay

    return run


def improve(vectors: DataFrame, graph: DataFrame, fresh: DataFrame | None, k: int, dimensions: int) -> DataFrame:
    """One round: the pairs of neighbours of a common node that are closer than what one of them has so far."""
    marked = graph.withColumn("fresh", F.lit(True)) if fresh is None else graph.join(fresh.select("key", "other", F.lit(True).alias("fresh")), ["key", "other"], "left").fillna(False, ["fresh"])
    both = marked.select(F.col("key").alias("centre"), F.col("other").alias("key"), "fresh").union(marked.select(F.col("other").alias("centre"), "key", "fresh"))
    both = both.groupBy("centre", "key").agg(F.max("fresh").alias("fresh"))
    crowd = both.groupBy("centre").agg(F.count("*").alias("n"), F.max("fresh").alias("any")).where("any")
    groups = F.ceil(F.col("n") / HUB)
    both = both.join(crowd, "centre").select(F.xxhash64("centre", F.pmod(F.xxhash64("key"), groups)).alias("centre"), "key", "fresh")
    listed = graph.groupBy("key").agg(F.min("sim").alias("low"), F.count("*").alias("n"), F.sort_array(F.collect_list("other")).alias("o"))
    packed = F.concat(*[F.to_binary(F.lpad(F.hex(F.coalesce(F.get("o", F.lit(i)), F.lit(0))), 16, "0"), F.lit("hex")) for i in range(k)])
    known = listed.select("key", F.when(F.col("n") < k, F.lit(-2.0)).otherwise(F.col("low")).cast("float").alias("worst"), packed.alias("near"))
    nodes = vectors.join(known, "key")
    gathered = both.join(nodes, "key").select("centre", "key", "vec", "worst", "near", "fresh")
    return gathered.repartition("centre").sortWithinPartitions("centre").mapInPandas(_tell(k, dimensions), TOLD)


def classes(rows: DataFrame, k: int = K) -> DataFrame:
    """Of every different vector its smallest key and its k + 1 smallest keys (a bounded list, however many are equal)."""
    w = Window.partitionBy("vec").orderBy("key")
    few = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k + 1)
    return few.groupBy("vec").agg(F.min("key").alias("key"), F.sort_array(F.collect_list("key")).alias("keys"))


def build(nodes: DataFrame, k: int = K, dimensions: int = DIMENSIONS) -> DataFrame:
    """The neighbour graph (key, other, sim) of nodes with different vectors, improved until it has settled: the k nearest that were found."""
    wanted, k = k, max(k, LIST)
    graph = cut(start(nodes, nodes.count(), k, dimensions))
    fresh, edges, done = None, graph.count(), 0
    while edges:
        better = cut(top(graph.unionByName(improve(nodes, graph, fresh, k, dimensions)), k))
        fresh = cut(better.join(graph, ["key", "other"], "left_anti").select("key", "other"))
        graph, done = better, done + 1
        if done >= ROUNDS and fresh.count() <= SETTLED * edges:
            break
    return top(graph, wanted) if wanted < k else graph


def most_similar(rows: DataFrame, k: int = K, dimensions: int = DIMENSIONS) -> DataFrame:
    """key, other, sim: for every usable vector the k most similar other rows, equal vectors included.

    Input: key and embedding; other columns are ignored. Null, short, long, not finite and all-zero embeddings take no
    part; fewer than k others give fewer rows; an empty table gives an empty result. Of equal similarity the smaller key comes
    first. A class of equal vectors is one node, so it costs no more than any other, and its members share one bounded list.
    """
    vectors = cut(usable(rows, dimensions))
    groups = cut(classes(vectors, k))
    graph = build(groups.select("key", "vec"), k, dimensions=dimensions)
    own = groups.select("key", F.col("key").alias("other"), F.lit(2.0).cast("float").alias("sim"))
    keys = groups.select(F.col("key").alias("other"), "keys")
    spread = graph.unionByName(own).join(keys, "other").select("key", "sim", F.explode("keys").alias("other"))
    w = Window.partitionBy("key").orderBy(F.desc("sim"), "other")
    lists = spread.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k + 1).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("rank", "other", "sim"))).alias("list"))
    alone = groups.where(F.size("keys") == 1).select("key", F.col("key").alias("class"))
    several = groups.where(F.size("keys") > 1).select("vec", F.col("key").alias("class"))
    members = alone.unionByName(vectors.join(several, "vec").select("key", "class"))
    others = F.slice(F.filter("list", lambda e: e["other"] != F.col("key")), 1, k)
    return members.join(lists.withColumnRenamed("key", "class"), "class").select("key", F.explode(others).alias("e")).select("key", "e.other", F.least("e.sim", F.lit(1.0)).cast("float").alias("sim"))


def pairs(found: DataFrame) -> DataFrame:
    """Each pair once, smaller key first."""
    return found.select(F.least("key", "other").alias("id_lo"), F.greatest("key", "other").alias("id_hi")).distinct()


#: A search enters at one of so many nodes, at ENTRIES at least; DOORS of them are held at a time.
SHARE, ENTRIES, DOORS, WIDTH = 4, 512, 16_384, 96


def _enter(keys: list[int], packed: list[bytes], best: int, dimensions: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, own = _matrix(packed, dimensions), np.asarray(keys)
        for pdf in batches:
            if not len(pdf):
                continue
            s = _matrix(pdf["vec"], dimensions) @ m.T
            k = min(best, len(own))
            top_ = np.argpartition(-s, k - 1, axis=1)[:, :k]
            yield pd.DataFrame({"query": np.repeat(pdf["query"].to_numpy(), k), "key": own[top_].ravel(), "sim": np.take_along_axis(s, top_, 1).ravel()})

    return run


def _compare(dimensions: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                s = (_matrix(pdf["vec"], dimensions) * _matrix(pdf["asked"], dimensions)).sum(1)
                yield pd.DataFrame({"query": pdf["query"], "key": pdf["key"], "sim": s})

    return run


def greedy_search(queries: DataFrame, nodes: DataFrame, graph: DataFrame, k: int = K, dimensions: int = DIMENSIONS) -> DataFrame:
    """(query, key, sim, rank): the k nodes (key, vec) most similar to each query (query, vec), by greedy steps on the graph.

    A query starts at the best of a fixed share of the nodes (drawn by hash, read in blocks of a bounded size), looks at the neighbours,
    either way, of the WIDTH best nodes it knows and hasn't looked at, and goes on until nothing is new. All queries step together.
    """
    schema = "query bigint, key bigint, sim float"
    total = nodes.count()
    hashed = F.xxhash64("key")
    if total <= SHARE * ENTRIES:
        blocks = [nodes.orderBy(hashed, "key").limit(ENTRIES)]
    else:
        buckets = SHARE * -(-total // (SHARE * DOORS))
        blocks = [nodes.where(F.pmod(hashed, F.lit(buckets)) == b) for b in range(buckets // SHARE)]
    w = Window.partitionBy("query").orderBy(F.desc("sim"), "key")
    pool = queries.sparkSession.createDataFrame([], schema)
    for block in blocks:
        doors = block.select("key", "vec").toPandas()
        if len(doors):
            entered = queries.select("query", "vec").mapInPandas(_enter(doors["key"].tolist(), doors["vec"].tolist(), WIDTH // 2, dimensions), schema)
            pool = cut(pool.unionByName(entered).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= WIDTH // 2).drop("rank"))
    pool = pool.withColumn("open", F.lit(True))
    asked = queries.select("query", F.col("vec").alias("asked"))
    both = cut(graph.select("key", "other").union(graph.select("other", "key")).distinct())
    while True:
        pool = cut(pool.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= WIDTH).drop("rank"))
        if pool.where("open").isEmpty():
            break
        ahead = pool.where("open").select("query", "key").join(both, "key").select("query", F.col("other").alias("key")).distinct()
        fresh = ahead.join(pool.select("query", "key"), ["query", "key"], "left_anti")
        seen = fresh.join(nodes.select("key", "vec"), "key").join(asked, "query").select("query", "key", "vec", "asked").mapInPandas(_compare(dimensions), schema)
        pool = pool.withColumn("open", F.lit(False)).unionByName(seen.withColumn("open", F.lit(True)))
    return pool.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", "key", "sim", "rank")


def members(found: DataFrame, groups: DataFrame, k: int = K) -> DataFrame:
    """What greedy_search found among classes of equal vectors (as classes gives them), as the k most similar rows of each query."""
    w = Window.partitionBy("query").orderBy(F.desc("sim"), "key")
    rows = found.drop("rank").join(groups.select("key", "keys"), "key").select("query", F.explode("keys").alias("key"), "sim")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
