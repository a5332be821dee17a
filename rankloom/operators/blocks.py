"""Many queries against a corpus that all tasks read from the shared folder.

Queries are parted into blocks, one a task. A task streams the kept corpus past its block, slice by slice, and holds the best of each
query; so neither texts nor pairs of queries and texts are shuffled, and every text is looked at. What can't reach a query's best is
passed over by bounds that are proven (the largest weight of each term), never by a sample or a cap. A document ID stands once in a corpus.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, functions as F

from rankloom.functions import text as T
from rankloom.session import shared_dir

K1, B = 1.5, 0.75
# Postings of a slice, queries of a task at most, rows read at once, and what may be lost by rounding.
SLICE, BLOCK, ROWS, EPS = 2_000_000, 16_384, 4_096, 1e-8


def keep(df: DataFrame) -> str:
    """Writes df into the shared folder, compressed and by column, and gives its place; a row's place in it never changes."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/kept-{uuid.uuid4().hex}")
    where = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    df.write.option("compression", "zstd").parquet(where)
    return where


def held(df: DataFrame) -> DataFrame:
    """df computed once and read from the shared folder, smaller there than a checkpoint."""
    return df.sparkSession.read.parquet(keep(df))


def _batches(where: str, columns: list[str], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    system, path = (fs.LocalFileSystem(), where.removeprefix("file:")) if where.startswith("file:") else fs.FileSystem.from_uri(where)
    for f in sorted(f.path for f in system.get_file_info(fs.FileSelector(path)) if f.path.endswith(".parquet")):
        with system.open_input_file(f) as opened, pq.ParquetFile(opened) as file:
            yield from file.iter_batches(batch_size=rows, columns=columns)


def in_blocks(queries: DataFrame) -> DataFrame:
    """Queries in as many partitions as there are blocks, two a core at least where they are enough."""
    n, cores = queries.count(), queries.sparkSession.sparkContext.defaultParallelism
    return queries.repartition(max(1, min(n, 2 * cores), -(-n // BLOCK)))


def term_ids(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def keyword_id(k: Column) -> Column:
    """The ID of a normalised keyword among the terms of a text; it begins with a character that no stem has."""
    return F.xxhash64(F.concat(F.lit("\u0001"), k))


# Keywords in texts.


@cache
def _stem(w: str) -> str:
    """As stem of functions/text."""
    b = w.removesuffix("'s")
    n = len(b)
    if n > 4 and b.endswith("ies"):
        return b[:-3] + "y"
    if n > 4 and b.endswith("es") and not b.endswith("ses"):
        return b[:-2]
    if n > 3 and b.endswith("s") and not b.endswith("ss"):
        return b[:-1]
    return b[:-3] if n > 5 and b.endswith("ing") else b[:-2] if n > 4 and b.endswith("ed") else b


_PIECE = re.compile(r"[^\W_]+")


def _stands(k: str, h: str) -> bool:
    """Whether a phrase occurs with no letter or digit next to it."""
    at = h.find(k)
    while at >= 0:
        end = at + len(k)
        if not (at and h[at - 1].isalnum()) and not (end < len(h) and h[end].isalnum()):
            return True
        at = h.find(k, at + 1)
    return False


class Keywords:
    """Which of many normalised keywords occur in normalised texts, as keyword_in_normal tells, by lists of the texts that hold a keyword's parts."""

    def __init__(self, ids: list[int], keywords: list[str]) -> None:
        self.of = [(i, k, list(dict.fromkeys(_PIECE.findall(k))), [_stem(w) for w in k.split(" ")]) for i, k in zip(ids, keywords)]
        self.pieces = {p for _, _, ps, _ in self.of for p in ps}
        self.stems = {s for _, _, _, ss in self.of for s in ss}

    def found(self, texts: list[str]) -> tuple[list[int], list[int]]:
        """Numbers of texts and the IDs of the keywords in them."""
        holds: dict[str, set[int]] = {}
        first: dict[str, dict[int, int]] = {}
        for n, h in enumerate(texts):
            for p in self.pieces.intersection(_PIECE.findall(h)):
                holds.setdefault(p, set()).add(n)
            for at, w in enumerate(h.split(" ")):
                if (s := _stem(w)) in self.stems:
                    first.setdefault(s, {}).setdefault(n, at)
        _stem.cache_clear()
        where, which = [], []
        for i, k, pieces, stems in self.of:
            with_pieces = [holds.get(p) for p in pieces]
            hits = set()
            if pieces and all(with_pieces):
                hits = set.intersection(*sorted(with_pieces, key=len))
                if pieces != [k]:
                    hits = {n for n in hits if _stands(k, texts[n])}
            places = [first.get(s) for s in stems]
            if all(places):
                least = min(places, key=len)
                for n in least:
                    if n not in hits and all(n in p for p in places):
                        at = [p[n] for p in places]
                        if len(stems) == 1 or max(at) - min(at) <= 4 * len(stems) or not pieces and _stands(k, texts[n]):
                            hits.add(n)
            where += hits
            which += [i] * len(hits)
        return where, which


# The index.


def _postings(ids: pa.Array, lengths: np.ndarray, doc: np.ndarray, term: np.ndarray) -> dict:
    """One slice: documents in the order of their IDs; for each term, in order, the documents that hold it and how often."""
    order = pc.sort_indices(ids).to_numpy()
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    doc = place[doc]
    by = np.lexsort((doc, term))
    term, doc = term[by], doc[by]
    new = np.ones(len(term), bool)
    new[1:] = (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    tf = np.diff(np.append(at, len(term))).astype(np.int32)
    term, doc = term[at], doc[at]
    begins = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)
    lengths = lengths[order]
    return {
        "n": len(order), "total": int(lengths.sum()), "docs": ids.take(pa.array(order)), "lengths": lengths.astype(np.int32).tobytes(), "vocab": term[begins].tobytes(),
        "starts": np.append(begins, len(term)).astype(np.int32).tobytes(), "at": doc.tobytes(), "tf": tf.tobytes(),
    }


def _posted(keywords: str | None, kind: pa.DataType, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        if keywords:
            read = [b for b in _batches(keywords, ["id", "k"])]
            known = Keywords([i for b in read for i in b["id"].to_pylist()], [k for b in read for k in b["k"].to_pylist()])
        held: list[tuple] = []
        n = postings = 0

        def out() -> pa.RecordBatch:
            ids = pa.concat_arrays([h[0] for h in held])
            one = _postings(ids, np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held]))
            docs = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), one.pop("docs"))
            binary = {c: pa.array([one[c]], pa.binary()) for c in ("lengths", "vocab", "starts", "at", "tf")}
            return pa.RecordBatch.from_pydict({"n": pa.array([one["n"]], pa.int64()), "total": pa.array([one["total"]], pa.int64()), "docs": docs} | binary)

        for whole in batches:
            for b in (whole.slice(a, ROWS) for a in range(0, len(whole), ROWS)):
                terms = b["terms"]
                doc, term = np.repeat(np.arange(len(b)), terms.value_lengths().to_numpy()), terms.flatten().to_numpy().astype(np.int64)
                if known:
                    where, which = known.found(b["h"].to_pylist())
                    doc, term = np.append(doc, np.array(where, np.int64)), np.append(term, np.array(which, np.int64))
                held.append((b["doc_id"].cast(kind), b["length"].to_numpy(), doc + n, term))
                n, postings = n + len(b), postings + len(term)
                if postings >= size:
                    yield out()
                    held, n, postings = [], 0, 0
        if held:
            yield out()

    return run


_INDEX = "n bigint, total bigint, docs array<{}>, lengths binary, vocab binary, starts binary, at binary, tf binary"


def _made(rows: DataFrame, keywords: str | None, size: int) -> str:
    kind = rows.schema["doc_id"].dataType.simpleString()
    kind = "bigint" if kind in ("bigint", "int") else "string"
    return keep(rows.mapInArrow(_posted(keywords, pa.int64() if kind == "bigint" else pa.string(), size), _INDEX.format(kind)))


def post_sets(rows: DataFrame, size: int = SLICE) -> str:
    """The place of an index of rows (doc_id, names), an array of names each."""
    return _made(rows.select("doc_id", term_ids(F.col("names")).alias("terms"), F.size("names").alias("length")), None, size)


def post(corpus: DataFrame, keywords: DataFrame | None = None, size: int = SLICE) -> str:
    """The place of an index of a corpus (doc_id, text): its stems, and which of the keywords (keyword) occur in it; null texts have none.

    A task holds the distinct keywords and a slice of postings.
    """
    text = F.coalesce("text", F.lit(""))
    stems = corpus.select("doc_id", term_ids(T.stems(text)).alias("terms"), *([T.normalize_for_match(text).alias("h")] if keywords is not None else [])).withColumn("length", F.size("terms"))
    place = None
    if keywords is not None:
        k = keywords.select(T.normalize_for_match(F.col("keyword")).alias("k")).where("k <> ''").distinct()
        place = keep(k.select(keyword_id(F.col("k")).alias("id"), "k"))
    return _made(stems, place, size)


class _Slice:
    """Postings of the terms that a block of queries has."""

    def __init__(self, row: pa.RecordBatch, used: np.ndarray, mean: float | None) -> None:
        get = lambda c, kind: np.frombuffer(row[c][0].as_buffer(), kind)
        self.n, self.docs = row["n"][0].as_py(), row["docs"].flatten()
        vocab, starts, self.at = get("vocab", np.int64), get("starts", np.int32).astype(np.int64), get("at", np.int32)
        place = np.searchsorted(vocab, used)
        place[place == len(vocab)] = 0
        known = vocab[place] == used if len(vocab) else np.zeros(len(used), bool)
        self.begin, self.end = np.zeros(len(used), np.int64), np.zeros(len(used), np.int64)
        self.begin[known], self.end[known] = starts[place[known]], starts[place[known] + 1]
        self.starts, self.most = starts, np.zeros(len(used))
        if mean is None:
            self.w = None
            self.most[known] = 1.0
        else:
            tf, length = get("tf", np.int32).astype(np.float64), get("lengths", np.int32)
            self.w = tf * (K1 + 1) / (tf + (K1 * (1 - B + B * length / mean))[self.at]) if len(tf) else tf
            if len(vocab):
                self.most[known] = np.maximum.reduceat(self.w, starts[:-1])[place[known]]
        self.place, self.sums, self.wide = np.where(known, place, -1), np.zeros(self.n), {}

    def _at(self, u: int, docs: np.ndarray) -> np.ndarray:
        """The weights of a term in some documents, 0 where it isn't."""
        a, b = self.begin[u], self.end[u]
        if b - a > self.n // 32 and len(docs) * 8 > self.n // 64:
            if u not in self.wide:
                self.wide[u] = np.zeros(self.n)
                self.wide[u][self.at[a:b]] = 1.0 if self.w is None else self.w[a:b]
            return self.wide[u][docs]
        own = self.at[a:b]
        p = np.searchsorted(own, docs)
        p[p == b - a] = 0
        return np.where(own[p] == docs, 1.0 if self.w is None else self.w[a:b][p], 0.0)

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, least: float, count: float | None) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents and scores of the k best that reach ``least``, and how many reach ``count``.

        Terms come by their largest possible weight; once those left together can't reach the bound, only documents seen so far go on.
        """
        bounds = weights * self.most[terms]
        there = bounds > 0
        terms, weights, bounds = terms[there], weights[there], bounds[there]
        none = np.zeros(0, np.int64), np.zeros(0), 0
        rest = float(bounds.sum())
        bound = (least if count is None else min(least, count)) - EPS
        if rest < bound or not len(terms):
            return none
        order = np.lexsort((self.end[terms] - self.begin[terms], -bounds)).tolist()
        begin, end, sums, touched, i = self.begin, self.end, self.sums, [], 0
        for i, o in enumerate(order):  # noqa: B007
            if rest < bound:
                break
            u, w = terms[o], weights[o]
            own = self.at[begin[u] : end[u]]
            sums[own] += w if self.w is None else w * self.w[begin[u] : end[u]]
            touched.append(own)
            rest -= bounds[o]
        else:
            i += 1
        if sum(map(len, touched)) * 4 > self.n:
            docs = np.flatnonzero(sums >= max(bound - rest, 1e-300))
            found = sums[docs]
            sums[:] = 0
        else:
            docs = np.concatenate(touched)
            docs = docs[sums[docs] >= bound - rest]
            docs = np.unique(docs)
            found = sums[docs]
            for own in touched:
                sums[own] = 0
        for o in order[i:]:
            if not len(docs):
                return none
            found += weights[o] * self._at(terms[o], docs)
            rest -= bounds[o]
            keep_ = found >= bound - rest
            docs, found = docs[keep_], found[keep_]
        found = np.round(found, 9)
        if count is not None:
            found = np.minimum(found, 1.0)
        above = 0 if count is None else int((found >= count).sum())
        good = (found >= least) & (found > 0)
        docs, found = docs[good], found[good]
        if len(docs) > k:
            good = found >= np.partition(found, len(found) - k)[len(found) - k]
            docs, found = docs[good], found[good]
            top = np.lexsort((docs, -found))[:k]
            docs, found = docs[top], found[top]
        return docs, found, above

    def scores(self, docs: np.ndarray, sizes: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Scores of given documents; ``sizes`` of the flat terms belong to each."""
        pair = np.repeat(np.arange(len(docs)), sizes)
        place = self.place[terms]
        keys = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts)) * self.n + self.at
        want = place * self.n + docs[pair]
        p = np.searchsorted(keys, want)
        p[p == len(keys)] = 0
        hit = (place >= 0) & (keys[p] == want) if len(keys) else np.zeros(len(want), bool)
        return np.round(np.bincount(pair[hit], weights[hit] * (1.0 if self.w is None else self.w[p[hit]]), len(docs)), 9)


def _searched(where: str, k: int, bm25: bool, count: float | None, kind: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if len(b)]) else None
        if asked is None:
            return
        asked = asked.combine_chunks()
        column = lambda c: asked[c].chunk(0)
        ids = column("query_id")
        flat = column("terms").flatten().to_numpy().astype(np.int64)
        ends = np.append(0, np.cumsum(column("terms").value_lengths().to_numpy()))
        weights = column("weights").flatten().to_numpy() if "weights" in asked.column_names else np.ones(len(flat))
        used, flat = np.unique(flat, return_inverse=True)
        mean = None
        if bm25:
            n = total = 0
            df = np.zeros(len(used))
            for row in _batches(where, ["n", "total", "vocab", "starts"], 1):
                n, total = n + row["n"][0].as_py(), total + row["total"][0].as_py()
                vocab = np.frombuffer(row["vocab"][0].as_buffer(), np.int64)
                if len(vocab):
                    place = np.minimum(np.searchsorted(vocab, used), len(vocab) - 1)
                    df += np.where(vocab[place] == used, np.diff(np.frombuffer(row["starts"][0].as_buffer(), np.int32))[place], 0)
            mean = total / n if total else 1.0
            weights = weights * np.log(1 + (n - df + 0.5) / (df + 0.5))[flat]
        wanted = column("wanted") if "wanted" in asked.column_names else None
        if wanted is not None:
            sizes = np.diff(ends)
            of = np.repeat(np.arange(len(ids)), wanted.value_lengths().fill_null(0).to_numpy())
            wanted = wanted.flatten()
        best: list[list] = [[] for _ in range(len(ids))]
        least, above = np.zeros(len(ids)), np.zeros(len(ids), np.int64)
        at, docs, scores = [], [], []
        for row in _batches(where, ["n", "docs", "lengths", "vocab", "starts", "at", "tf"], 1):
            s = _Slice(row, used, mean)
            for q in range(len(ids)):
                a, b = ends[q], ends[q + 1]
                if a == b:
                    continue
                found, score, more = s.best(flat[a:b], weights[a:b], k, least[q], count)
                above[q] += more
                if len(found):
                    own = sorted([*best[q], *zip((-score).tolist(), s.docs.take(pa.array(found)).to_pylist())])[:k]
                    best[q] = own
                    if len(own) == k:
                        least[q] = -own[-1][0]
            if wanted is not None and len(wanted):
                place = pc.index_in(wanted, value_set=s.docs)
                here = np.flatnonzero(place.is_valid().to_numpy(zero_copy_only=False))
                if len(here):
                    q = of[here]
                    take = np.concatenate([np.arange(ends[x], ends[x + 1]) for x in q])
                    got = s.scores(place.take(pa.array(here)).to_numpy(), sizes[q], flat[take], weights[take])
                    at.append(q)
                    docs.append(wanted.take(pa.array(here)).cast(kind))
                    scores.append(got if count is None else np.minimum(got, 1.0))
        sizes = [len(x) for x in best]
        q = np.concatenate([np.repeat(np.arange(len(ids)), sizes), *at])
        top = pa.array([d for x in best for _, d in x], kind)
        rank = pa.array([*(i + 1 for x in best for i in range(len(x))), *[None] * (len(q) - len(top))], pa.int32())
        score = np.concatenate([np.array([-v for x in best for v, _ in x], np.float64), *scores])
        out = pa.RecordBatch.from_pydict({"query_id": ids.take(pa.array(q)), "doc_id": pa.concat_arrays([top, *docs]), "score": pa.array(score), "rank": rank, "above": pa.array(above[q])})
        yield from (out.slice(a, 65_536) for a in range(0, len(out), 65_536))

    return run


def search(queries: DataFrame, where: str, k: int, bm25: bool = False, count: float | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank, above): the k best texts of an index by the summed weights of the terms they share with a query.

    queries: query_id, terms (IDs), weights (positive; none for BM25), and wanted, texts whose scores are given as well, with a null rank. With
    ``count`` a score is 1 at most, and ``above`` tells how many texts reach it. Scores are rounded to nine digits, ties go to the smaller doc_id.
    """
    spark = queries.sparkSession
    made = spark.read.parquet(where).schema["docs"].dataType.elementType
    columns = [c for c in ("query_id", "terms", "weights", "wanted") if c in queries.columns]
    kind = pa.int64() if made.simpleString() == "bigint" else pa.string()
    return in_blocks(queries.select(*columns)).mapInArrow(_searched(where, k, bm25, count, kind), f"query_id {queries.schema['query_id'].dataType.simpleString()}, doc_id {made.simpleString()}, score double, rank int, above bigint")


def bm25(queries: DataFrame, where: str, k: int) -> DataFrame:
    """BM25 of queries (query_id, text) over an index: the k best with a positive score."""
    asked = queries.select("query_id", F.array_distinct(term_ids(T.stems(F.col("text")))).alias("terms")).where(F.size("terms") > 0)
    return search(asked, where, k, bm25=True).select("query_id", "doc_id", "score", "rank")


# Vectors.


def _near(where: str, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for asked in (b.slice(a, ROWS) for a in range(0, len(b), ROWS)):
                yield _nearest(asked, where, k)

    return run


def _matrix(c: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows with vectors of a width, and those vectors."""
    fits = np.flatnonzero(c.value_lengths().fill_null(0).to_numpy() == width)
    return fits, c.take(pa.array(fits)).flatten().to_numpy().astype(np.float32).reshape(len(fits), width)


def _nearest(asked: pa.RecordBatch, where: str, k: int) -> pa.RecordBatch:
    width = max(asked["embedding"].value_lengths().fill_null(0).to_pylist(), default=0)
    rows, q = _matrix(asked["embedding"], width)
    first, inverse = np.unique(q, axis=0, return_inverse=True) if len(q) else (q, np.zeros(0, np.int64))
    exact = first.astype(np.float64)
    norms = np.linalg.norm(exact, axis=1)
    names: list[str] = []
    n = np.zeros((len(first), 0), np.int64)
    name, score = n.copy(), np.zeros((len(first), 0))
    least = np.full(len(first), -np.inf)
    for b in _batches(where, ["n", "doc_id", "embedding"]):
        fits, m = _matrix(b["embedding"], width)
        if not len(fits) or not len(first):
            continue
        slack = (width + 4) * 2.4e-7 * norms * float(np.linalg.norm(m.astype(np.float64), axis=1).max(initial=0)) + EPS
        s = first @ m.T  # in single precision; what comes near a query's k best is computed again
        bound = least
        if s.shape[1] > k:
            bound = np.maximum(bound, np.partition(s, s.shape[1] - k, axis=1)[:, -k] - slack) if (least == -np.inf).any() else bound
        i, j = np.nonzero(s >= (bound - slack)[:, None])
        if not len(i):
            continue
        good = np.round(np.concatenate([np.einsum("ij,ij->i", exact[i[a : a + 65_536]], m[j[a : a + 65_536]].astype(np.float64)) for a in range(0, len(i), 65_536)]), 9)
        own = b["n"].take(pa.array(fits)).to_numpy()
        ids = b["doc_id"].take(pa.array(fits))
        keep_ = good >= least[i]
        i, j, good = i[keep_], j[keep_], good[keep_]
        used, at = np.unique(j, return_inverse=True)
        names_at = len(names) + at
        names += ids.take(pa.array(used)).to_pylist()
        # All queries at once: those held before and those that are new, by query, score and number.
        old = np.repeat(np.arange(len(first)), [name.shape[1]] * len(first))
        held = name.ravel() >= 0
        qs = np.concatenate([old[held], i])
        sc, nu, na = np.concatenate([score.ravel()[held], good]), np.concatenate([n.ravel()[held], own[j]]), np.concatenate([name.ravel()[held], names_at])
        order = np.lexsort((nu, -sc, qs))
        qs, sc, nu, na = qs[order], sc[order], nu[order], na[order]
        begins = np.searchsorted(qs, np.arange(len(first)))
        rank = np.arange(len(qs)) - begins[qs]
        top = rank < k
        name, n, score = np.full((len(first), k), -1), np.zeros((len(first), k), np.int64), np.full((len(first), k), -np.inf)
        name[qs[top], rank[top]], n[qs[top], rank[top]], score[qs[top], rank[top]] = na[top], nu[top], sc[top]
        least = score[:, k - 1]
        if len(names) > 4 * name.size + ROWS:  # names that no list holds any more go
            used, at = np.unique(name, return_inverse=True)
            names = [names[u] for u in used if u >= 0]
            name = (at - (used[0] < 0)).reshape(name.shape)
    every, ranks, docs = [], [], []
    for r, u in zip(rows, inverse):
        own = name[u][name[u] >= 0]
        every.append(np.column_stack([np.full(len(own), r), np.arange(1, len(own) + 1)]))
        docs += [names[x] for x in own]
        ranks.append(score[u][: len(own)])
    every_ = np.concatenate(every).astype(np.int64) if every else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_pydict({"query_id": asked["query_id"].take(pa.array(every_[:, 0])), "doc_id": pa.array(docs, pa.string()), "score": pa.array(np.concatenate(ranks) if ranks else np.zeros(0)), "rank": pa.array(every_[:, 1], pa.int32())})


def dense(queries: DataFrame, where: str, k: int) -> DataFrame:
    """Exact search of queries (query_id, embedding), parted by in_blocks, over kept vectors (n, doc_id, embedding) by inner product; ties go to the smaller n.

    Equal queries are searched once a task; null vectors and those of another length than the queries' take no part.
    """
    return queries.select("query_id", "embedding").mapInArrow(_near(where, k), f"query_id {queries.schema['query_id'].dataType.simpleString()}, doc_id string, score double, rank int")


# Texts.


def _read(where: str, whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if len(b)]) else None
        if asked is None:
            return
        asked = asked.combine_chunks()
        docs = asked["docs"].chunk(0)
        sizes = docs.value_lengths().fill_null(0).to_numpy()
        of, flat = np.repeat(np.arange(len(docs)), sizes), docs.flatten()
        rest = [asked[c].chunk(0) for c in asked.column_names if c != "docs"]
        names = [c for c in asked.column_names if c != "docs"]
        texts: dict[str, str] = {}
        for b in _batches(where, ["doc_id", "text"]):
            at = pc.index_in(flat, value_set=b["doc_id"])
            here = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
            if not len(here):
                continue
            if whole:
                found = pc.unique(at.take(pa.array(here)))
                texts.update(zip(b["doc_id"].take(found).to_pylist(), b["text"].take(found).to_pylist()))
                continue
            for a in range(0, len(here), ROWS):
                part = here[a : a + ROWS]
                row = pa.array(of[part])
                yield pa.RecordBatch.from_arrays([*(c.take(row) for c in rest), flat.take(pa.array(part)), b["text"].take(at.take(pa.array(part)))], [*names, "doc_id", "text"])
        if whole:
            ends = np.append(0, np.cumsum(sizes))
            for a in range(0, len(docs), 1024):
                joined = ["\n\n".join(texts[d] for d in flat[ends[i] : ends[i + 1]].to_pylist() if texts.get(d) is not None) for i in range(a, min(a + 1024, len(docs)))]
                yield pa.RecordBatch.from_arrays([*(c.slice(a, len(joined)) for c in rest), pa.array(joined, pa.string())], [*names, "context"])

    return run


def with_texts(rows: DataFrame, where: str) -> DataFrame:
    """Rows with ``docs``, an array of document IDs, once for each of them that is in the kept table (doc_id, text), with doc_id and text."""
    out = rows.drop("docs").withColumns({c: F.lit(None).cast("string") for c in ("doc_id", "text")}).schema
    return in_blocks(rows).mapInArrow(_read(where, False), out)


def with_context(rows: DataFrame, where: str) -> DataFrame:
    """Rows with ``docs``, an array of document IDs, and the texts of those in their order as ``context``, with a blank line between; empty where there is none."""
    out = rows.drop("docs").withColumn("context", F.lit(None).cast("string")).schema
    return in_blocks(rows).mapInArrow(_read(where, True), out)
