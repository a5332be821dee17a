import math
import random

import numpy as np
from pyspark.sql import functions as F

from rankloom.operators import labels as L, metrics as M, search as S


def _hits(spark, rows):
    return spark.createDataFrame(rows, "query_id string, doc_id string, score double, rank int")


def test_dense_topk_against_a_full_sort(spark):
    rng = np.random.default_rng(3)
    m = rng.standard_normal((300, 16)).astype(np.float32)
    m[7] = m[3]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(900, None), (901, [1.0])], "doc_id long, embedding array<float>").repartition(5)
    q = df.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id")
    got = {}
    for r in S.dense_topk(q, df, 4).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.doc_id))
    for i, hits in got.items():
        s = np.round(m.astype(float) @ m[i].astype(float), 9)
        want = sorted((j for j in range(300) if j != i), key=lambda j: (-s[j], j))[:4]
        assert [d for _, d in sorted(hits)] == want
    assert len(got) == 6 and S.dense_topk(q.limit(0), df, 4).collect() == []


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "apex contract renewal"), (2, "apex contract"), (3, "jordan lee person"), (4, None), (5, "")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "Apex Apex"), (2, "Apex"), (3, "the of"), (4, None), (5, "jordan")], "query_id long, text string")
    got = {(r.query_id, r.doc_id): r.score for r in S.bm25_topk(q, docs, 5).collect()}
    mean, idf = (3 + 2 + 3) / 5, math.log(1 + (5 - 2 + 0.5) / 2.5)
    assert abs(got[(2, 2)] - idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / mean))) < 1e-8
    assert got[(1, 1)] == got[(2, 1)] < got[(2, 2)] and {k for k in got if k[0] in (3, 4)} == set() and set(got) >= {(5, 3)}


def test_rrf_weights_ties_and_ranks(spark):
    a, b = _hits(spark, [("q", "a", 9.0, 1), ("q", "b", 8.0, 2)]), _hits(spark, [("q", "b", 3.0, 1), ("q", "c", 2.0, 2)])
    rows = S.fuse([(a, 1.0), (b, 1.0)], 10).orderBy("rank").collect()
    assert [(r.doc_id, r.rank) for r in rows] == [("b", 1), ("a", 2), ("c", 3)] and abs(rows[0].score - (1 / 62 + 1 / 61)) < 1e-9 and len(rows[0].sources) == 2
    tie = S.fuse([(_hits(spark, [("q", "z", 1.0, 1)]), 1.0), (_hits(spark, [("q", "y", 1.0, 1)]), 1.0)], 10).orderBy("rank").collect()
    assert [r.doc_id for r in tie] == ["z", "y"]
    assert S.fuse([(a, 0.1), (b, 5.0)], 1).first().doc_id == "b"


def test_rerank_neighbours_compress(spark):
    h = _hits(spark, [("q", "a", 0.9, 1), ("q", "b", 0.8, 2), ("q", "c", 0.7, 3), ("one", "x", 0.3, 1)])
    s = spark.createDataFrame([("q", "a", 1.0), ("q", "c", 99.0), ("one", "x", 1.0)], "query_id string, doc_id string, model_score double")
    got = [(r.query_id, r.doc_id, r.score, r["rank"]) for r in S.rerank(h, s, 5).orderBy("query_id", "rank").collect()]
    assert got == [("one", "x", 0.3, 1), ("q", "c", 1.0, 1), ("q", "b", 0.5, 2), ("q", "a", 0.1, 3)]
    sib = spark.createDataFrame([("p", "D", 1), ("a", "D", 2), ("b", "D", 3), ("n", "D", 4), ("c", "E", 1)], "doc_id string, parent string, ordinal int")
    wide = [(r.doc_id, round(r.score, 2), r.new) for r in S.add_neighbours(h.where("query_id = 'q'"), sib).orderBy("rank").collect()]
    assert wide == [("a", 0.9, 0), ("b", 0.8, 0), ("c", 0.7, 0), ("p", 0.45, 1), ("n", 0.4, 1)]
    t = spark.createDataFrame([("a", "Same  text"), ("b", "same text"), ("c", "other"), ("x", None)], "doc_id string, text string")
    assert [(r.query_id, r.doc_id) for r in S.compress(h, t, 2).orderBy("query_id", "rank").collect()] == [("one", "x"), ("q", "a"), ("q", "c")]
    twice = S.dedupe(h.union(_hits(spark, [("q", "a", 0.1, 4)])))
    assert [r["rank"] for r in twice.where("query_id = 'q'").orderBy("rank").collect()] == [1, 2, 3]


def test_metrics_by_hand(spark):
    q = spark.createDataFrame([("q",), ("none",), ("r3",), ("no labels",)], "query_id string")
    h = _hits(spark, [("q", "a", 1.0, 1), ("q", "x", 1.0, 2), ("q", "b", 1.0, 3), ("r3", "x", 1.0, 1), ("r3", "y", 1.0, 2), ("r3", "b", 1.0, 3), ("no labels", "a", 1.0, 1)])
    lab = spark.createDataFrame([("q", "a", 1.0), ("q", "b", 0.5), ("q", "c", 0.3), ("r3", "b", 1.0), ("none", "b", 1.0)], "query_id string, doc_id string, grade double")
    m = {r.query_id: r for r in M.evaluate(q, h, lab, 5).collect()}
    assert abs(m["q"].context_precision - (1 + 2 / 3) / 2) < 1e-8 and m["q"].recall == 1.0 and abs(m["q"].precision - 2 / 3) < 1e-8
    g = lambda x: 2**x - 1
    assert abs(m["q"].ndcg - (g(1) + g(0.5) / 2) / (g(1) + g(0.5) / math.log2(3) + g(0.3) / 2)) < 1e-8
    assert abs(m["r3"].reciprocal_rank - 1 / 3) < 1e-8 and m["none"].recall == 0 and m["none"].relevant_total == 1 and m["no labels"].ndcg == 0
    assert all(0 <= r[c] <= 1 for r in m.values() for c in M.METRICS)


def _slow_grade(keywords, answer, text, present, stems):
    kw = sum(present(k, text) for k in keywords) / len(keywords) if keywords else 0
    a, c = set(stems(answer)), set(stems(text))
    return min(1, 0.6 * kw + 0.4 * (len(a & c) / len(a) if a else 0))


def test_labels_against_all_pairs(spark):
    from rankloom.functions import text as T

    rng = random.Random(2)
    words = ["claim", "claims", "policy", "policies", "2015", "2015-06", "Avery", "Lancaster", "IQ", "IQTest", "desk's", "renewed", "office"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 14))) for _ in range(25)]
    items = [(f"i{n}", [rng.choice(words) + (" " + rng.choice(words) if n % 2 else "") for _ in range(n % 4)], " ".join(rng.choice(words) for _ in range(n % 5)), None) for n in range(12)]
    i = spark.createDataFrame(items + [("gold", ["claim"], "x", ["d3", "d3", "zz"]), ("null", None, None, [])], "item_id string, keywords array<string>, answer string, gold array<string>")
    c = spark.createDataFrame([(f"d{n}", t) for n, t in enumerate(texts)] + [("dn", None)], "doc_id string, text string")
    got = {(r.item_id, r.doc_id): r.grade for r in L.grades(i, c).collect()}
    flat = i.where("gold is null").crossJoin(c.where("text is not null"))
    tested = flat.select("item_id", "doc_id", F.explode_outer("keywords").alias("k"), "text").select("item_id", "doc_id", F.coalesce(T.keyword_present(F.col("k"), F.col("text")), F.lit(False)).alias("p"))
    kw = {(r.item_id, r.doc_id): r.s for r in tested.groupBy("item_id", "doc_id").agg(F.avg(F.col("p").cast("int")).alias("s")).collect()}
    st = {(r.item_id, r.doc_id): (set(r.a), set(r.b)) for r in flat.select("item_id", "doc_id", T.stems(F.col("answer")).alias("a"), T.stems(F.col("text")).alias("b")).collect()}
    want = {}
    for k, (a, b) in st.items():
        g = min(1, 0.6 * kw[k] + 0.4 * (len(a & b) / len(a) if a else 0))
        if g > 0:
            want[k] = g
    want |= {("gold", "d3"): 1.0, ("gold", "zz"): 1.0}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-8 for k in want)


def test_rescue(spark):
    g = spark.createDataFrame([("a", "x", 0.6), ("a", "y", 0.3), ("b", "x", 0.4), ("b", "y", 0.4), ("b", "z", 0.3), ("c", "x", 0.2)], "item_id string, doc_id string, grade double")
    got = {(r.item_id, r.doc_id): (r.grade, r.unsupported) for r in L.rescue(g).collect()}
    assert got == {("a", "x"): (0.6, False), ("a", "y"): (0.3, False), ("b", "x"): (0.5, False), ("b", "y"): (0.5, False), ("b", "z"): (0.3, False), ("c", "x"): (0.2, True)}


def test_coverage_of_keywords(spark):
    i = spark.createDataFrame([("q", ["a", "b c"]), ("none", []), ("null", None)], "query_id string, keywords array<string>")
    t = spark.createDataFrame([("q", "here A is")], "query_id string, text string")
    got = {r.query_id: (r.coverage, r.hits) for r in M.keyword_coverage(i, t).collect()}
    assert got["q"] == (0.5, {"a": True, "b c": False}) and got["none"][0] == got["null"][0] == 0
