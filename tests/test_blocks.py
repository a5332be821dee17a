"""Search in blocks: against brute force and the operators on pairs, with slices and blocks of any size; and strategies on every question."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.functions import text as T
from rankloom.operators import blocks as X, graph as G, labels as L, metrics as M, search as S
from rankloom.session import latest, newest

WORDS = ["claim", "claims", "policy", "policies", "2015", "2015-06", "Avery", "Lancaster", "IQ", "IQTest", "desk's", "renewed", "office", "$1,343", "12½", "don't", "a_b"]


def _texts(rng, n, most):
    return [" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, most))) for _ in range(n)]


@pytest.mark.parametrize("size", [40, 10**6])
def test_bm25_as_with_all_pairs(spark, size):
    rng = random.Random(size)
    docs = spark.createDataFrame([*enumerate(_texts(rng, 300, 20)), (900, None), (901, "")], "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([*((f"q{i}", t) for i, t in enumerate(_texts(rng, 60, 6))), ("none", None), ("no", "zebra")], "query_id string, text string")
    want = {tuple(r) for r in S.bm25_topk(asked, docs, 7).select("query_id", "doc_id", "score", "rank").collect()}
    assert {tuple(r) for r in X.bm25(asked, X.post(docs, size=size), 7).collect()} == want and len(want) > 300
    assert X.bm25(asked, X.post(docs.limit(0)), 7).collect() == [] and X.bm25(asked.limit(0), X.post(docs), 7).collect() == []


@pytest.mark.parametrize("size", [60, 10**6])
def test_metrics_from_the_best_grades_are_those_of_all_grades(spark, size):
    rng = random.Random(size + 1)
    docs = spark.createDataFrame([*((f"d{i:03}", t) for i, t in enumerate(_texts(rng, 200, 14))), ("dn", None)], "doc_id string, text string").repartition(3)
    rows = [(f"i{n}", [rng.choice(WORDS) + (" " + rng.choice(WORDS) if n % 2 else "") for _ in range(n % 4)], " ".join(rng.choice(WORDS) for _ in range(n % 7)), None) for n in range(50)]
    rows += [("gold", ["claim"], "x", ["d003", "d003", "zz"]), ("null", None, None, []), ("odd", ["-", "", None, "claims", "claims", "no such word"], "the", None)]
    items = spark.createDataFrame(rows, "item_id string, keywords array<string>, answer string, gold array<string>")
    asked = items.select(F.col("item_id").alias("query_id"))
    hits = spark.createDataFrame([(r[0], f"d{rng.randrange(200):03}", k) for r in rows for k in range(1, 6)], "query_id string, doc_id string, rank int").dropDuplicates(["query_id", "doc_id"])
    where = X.post(docs, items.select(F.explode("keywords").alias("keyword")), size)
    every = L.grades(items, docs)
    needed = L.needed(items, where, hits)
    given = {(r.item_id, r.doc_id): r.grade for r in every.collect()}
    own = {(r.item_id, r.doc_id): r.grade for r in needed.collect()}
    assert all(abs(given[k] - g) < 1e-9 for k, g in own.items()) and {(r.query_id, r.doc_id) for r in hits.collect()} & set(given) <= set(own) and len(own) < len(given)
    a, b = ({r.query_id: r for r in M.evaluate(asked, hits, L.rescue(x).withColumnRenamed("item_id", "query_id")).collect()} for x in (every, needed))
    assert a == b and max(r.relevant_total for r in a.values()) > 10


def test_keywords_as_the_exact_test_tells(spark):
    rng = random.Random(9)
    texts = [t.replace(" IQ", ", IQ.") for t in _texts(rng, 120, 12)] + ["x claim-policy y", "ünï 東京 office's offices", "--", "a.b claims"]
    keys = [*WORDS, *(f"{a} {b}" for a in WORDS[:9] for b in WORDS[3:12]), "東京", "offices", "-", "--", "b claim", "ünï office", "%"]
    pairs = spark.createDataFrame(list(enumerate(keys)), "i int, k string").crossJoin(spark.createDataFrame(list(enumerate(texts)), "d int, t string")).select("i", "d", T.normalize_for_match(F.col("k")).alias("k"), T.normalize_for_match(F.col("t")).alias("h"))
    rows = pairs.withColumn("p", T.keyword_in_normal(F.col("k"), F.col("h"))).collect()
    normal, h = {r.i: r.k for r in rows if r.k}, {r.d: r.h for r in rows}
    pieceless = {i for i, k in normal.items() if not X._PIECE.search(k)}
    where, which = X.Keywords(list(normal), list(normal.values())).found([h[d] for d in range(len(texts))])
    # Of keywords without letter or digit only texts with all their words count, as in keyword_hits.
    want = {(r.d, r.i) for r in rows if r.p and (r.i not in pieceless or all(w in r.h.split(" ") for w in r.k.split(" ")))}
    assert set(zip(where, which)) == want and len(want) > 500


def test_dense_against_a_full_sort(spark, monkeypatch):
    monkeypatch.setattr(X, "ROWS", 64)
    rng = np.random.default_rng(4)
    m = rng.standard_normal((500, 8)).astype(np.float32)
    m[100:160] = m[7]
    docs = spark.createDataFrame([(i, f"d{i}", [float(x) for x in v]) for i, v in enumerate(m)] + [(900, "null", None), (901, "short", [1.0])], "n long, doc_id string, embedding array<float>").repartition(4)
    q = spark.createDataFrame([(f"q{i}", [float(x) for x in m[i]]) for i in (7, 7, 20, 499)] + [("none", None)], "query_id string, embedding array<float>").coalesce(1)
    got = {}
    for r in X.dense(q, X.keep(docs), 9).dropDuplicates().collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.doc_id, r.score))
    for i in (7, 20, 499):
        s = np.round(m.astype(float) @ m[i].astype(float), 9)
        best = sorted(range(500), key=lambda j: (-s[j], j))[:9]
        assert [(r, d) for r, d, _ in sorted(got.pop(f"q{i}"))] == [(n + 1, f"d{j}") for n, j in enumerate(best)]
    assert not got


def test_texts_and_contexts(spark):
    where = X.keep(spark.createDataFrame([("a", "A"), ("b", None), ("c", "C")], "doc_id string, text string"))
    rows = spark.createDataFrame([(1, ["c", "b", "a"]), (2, None), (3, ["zz"])], "n long, docs array<string>")
    assert {r.n: r.context for r in X.with_context(rows, where).collect()} == {1: "C\n\nA", 2: "", 3: ""}
    assert sorted((r.n, r.doc_id, r.text or "") for r in X.with_texts(rows, where).collect()) == [(1, "a", "A"), (1, "b", ""), (1, "c", "C")]


def test_best_units_as_of_all_scores(spark):
    rng = random.Random(3)
    names = [f"E{i}" for i in range(30)]
    units = spark.createDataFrame([(rng.choice(names), f"u{rng.randrange(150)}") for _ in range(900)], "entity string, unit string")
    anchors = spark.createDataFrame([(q, e) for q in range(40) for e in rng.sample(names, q % 4)] + [(50, "nowhere")], "query_id int, entity string")
    near = spark.createDataFrame(list({(rng.choice(names), rng.choice(names)) for _ in range(80)}), "entity string, neighbour string")
    want = S.ranked(G.score_units(G.expand(anchors, near), units), 6)
    assert {tuple(r) for r in G.best_units(anchors, near, units, 6).collect()} == {tuple(r) for r in want.select("query_id", "doc_id", "score", "rank").collect()}


def test_newest_is_latest(spark):
    rows = [("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z"), (None, 1, "n"), (None, 3, "m"), ("c", None, "c"), ("c", 1, "d")]
    df = spark.createDataFrame(rows, "id string, at int, text string")
    assert sorted(map(str, newest(df, ["id"], ["at"]).collect())) == sorted(map(str, latest(df, ["id"], ["at"]).collect()))


def _tables(spark, folder):
    docs = [(f"s{i}", f"t{i}.md", "team", f"# Item {i}\n\nItem {i} was renewed in May {2000 + i}. The Hull office handles item {i}.", "2024-01-01") for i in range(12)]
    spark.createDataFrame(docs, "id string, title string, category string, text string, loaded_at string").write.parquet(f"{folder}/source_documents.parquet")
    rows = [(f"q{i}", "2024-01-01", i if i else None, f"When was item {i} renewed?", f"In May {2000 + i}", [f"May {2000 + i}"], "fact", ["c"]) for i in range(12)]
    spark.createDataFrame(rows, "id string, loaded_at string, pos long, question string, reference_answer string, expected_keywords array<string>, question_type string, gold_chunk_ids array<string>").write.parquet(f"{folder}/evaluation_items.parquet")
    spark.createDataFrame([("g", 0, ["ITEM", "HULL"])], "id string, community_level int, entity_ids array<string>").write.parquet(f"{folder}/graph_communities.parquet")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    place = str(tmp_path_factory.mktemp("tables"))
    _tables(spark, place)
    return place


@pytest.mark.parametrize("name", ["strategy_baseline", "strategy_advanced", "strategy_advanced_pro", "strategy_graphrag"])
def test_strategies_answer_every_question(spark, folder, name):
    from rankloom.plans import strategy_queries

    rows = strategy_queries.QUERIES[name](spark, folder).collect()
    assert sorted(r.query_id for r in rows) == sorted(f"q{i}" for i in range(12)) and sum(r.hit_rate for r in rows) >= 5


def test_scores_are_of_every_question(spark, folder, monkeypatch):
    from rankloom.operators import aggregates as A
    from rankloom.plans import strategy_queries

    monkeypatch.setattr(A, "summary", lambda rows: rows)
    assert strategy_queries.strategy_scores(spark, folder).count() == 12
