import numpy as np

from rankloom.llm import neighbours as N

rng = np.random.default_rng(5)


def _brute(ids, m, k):
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = m @ m.T
    np.fill_diagonal(s, -9)
    return {(i, ids[j]) for n, i in enumerate(ids) for j in sorted(range(len(ids)), key=lambda j: (-round(s[n, j], 6), ids[j]))[:k] if j != n}


def _frame(spark, ids, m):
    return spark.createDataFrame([(int(i), [float(x) for x in v], "x") for i, v in zip(ids, m)], "key long, embedding array<float>, sim string")


def test_recall_against_brute_force_over_several_cells(spark):
    centres = rng.standard_normal((40, 64)) * 2
    m = np.concatenate([c + rng.standard_normal((60, 64)) for c in centres])
    ids = list(range(1, len(m) + 1))
    got = {(r.key, r.other) for r in N.most_similar(_frame(spark, ids, m)).collect()}
    want = _brute(ids, m, 5)
    assert len(got & want) / len(want) >= 0.95 and len(got - want) / len(got) <= 0.05


def test_equal_scaled_and_unusable_vectors(spark):
    v = rng.standard_normal(64)
    rows = [(9, v), (3, v * 2), (5, v), (7, v), (1, v), (2, v), (4, v), (20, rng.standard_normal(64))]
    df = _frame(spark, [i for i, _ in rows], [x for _, x in rows])
    odd = spark.createDataFrame([(30, None, "x"), (31, [0.0] * 64, "x"), (32, [1.0] * 48, "x"), (33, [float("nan")] * 64, "x"), (34, [float("inf")] * 64, "x"), (9, [float(x) for x in v], "again")], "key long, embedding array<float>, sim string")
    got = {}
    for r in N.most_similar(df.unionByName(odd)).collect():
        got.setdefault(r.key, set()).add(r.other)
    assert set(got) == {1, 2, 3, 4, 5, 7, 9, 20}
    assert got[9] == {1, 2, 3, 4, 5} and got[1] == {2, 3, 4, 5, 7} and got[20] == {1, 2, 3, 4, 5}


def test_keys_of_any_size(spark):
    m = rng.standard_normal((30, 64))
    ids = [-(2**62) + i * 2**57 for i in range(30)]
    got = {(r.key, r.other) for r in N.most_similar(_frame(spark, ids, m)).collect()}
    assert got == _brute(ids, m, 5)


def test_few_and_none(spark):
    assert N.most_similar(_frame(spark, [], [])).collect() == []
    assert N.most_similar(_frame(spark, [1], [np.ones(64)])).collect() == []
    two = N.pairs(N.most_similar(_frame(spark, [1, 2], rng.standard_normal((2, 64))))).collect()
    assert [(r.id_lo, r.id_hi) for r in two] == [(1, 2)]


def test_oversized_cells_are_halved(spark, monkeypatch):
    monkeypatch.setattr(N, "MAX_CELL", 100)
    m = rng.standard_normal((500, 8)) @ rng.standard_normal((8, 64))
    ids = list(range(500))
    got = {(r.key, r.other) for r in N.most_similar(_frame(spark, ids, m)).collect()}
    want = _brute(ids, m, 5)
    assert len(got & want) / len(want) >= 0.95


def test_descent_finds_the_neighbours_from_a_weak_start(spark, monkeypatch):
    monkeypatch.setattr(N, "WAYS", 3)
    m = rng.standard_normal((3000, 64))
    m += np.repeat(rng.standard_normal((100, 64)) * 1.5, 30, axis=0)
    ids = list(range(3000))
    nodes = N.classes(N.usable(_frame(spark, ids, m))).select("key", "vec")
    want = _brute(ids, m, 5)
    recall = lambda g: len({(r.key, r.other) for r in g.collect()} & want) / len(want)
    begun, built = recall(N.start(nodes, 3000, 5, 64)), recall(N.build(nodes))
    assert begun < built - 0.03 and built >= 0.95, (begun, built)


def test_greedy_search_recall(spark):
    centres = rng.standard_normal((30, 64)) * 2
    m = np.concatenate([c + rng.standard_normal((40, 64)) for c in centres])
    ids = list(range(len(m)))
    nodes = N.classes(N.usable(_frame(spark, ids, m))).select("key", "vec")
    q = np.stack([c + rng.standard_normal(64) for c in centres])
    queries = N.usable(_frame(spark, list(range(30)), q)).withColumnRenamed("key", "query")
    got = {(r.query, r.key) for r in N.greedy_search(queries, nodes, N.build(nodes)).collect()}
    s = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (m / np.linalg.norm(m, axis=1, keepdims=True)).T
    want = {(i, int(j)) for i in range(30) for j in np.argsort(-s[i])[:5]}
    assert len(got & want) / len(want) >= 0.9


def test_search_gives_equal_rows(spark, tmp_path):
    from rankloom.llm import queries

    m = rng.standard_normal((40, 64))
    spark.createDataFrame([(50, [float(x) for x in m[0]]), (51, [float(x) for x in m[1]])], "id long, embedding array<float>").write.parquet(str(tmp_path / "stored_chunks.parquet"))
    rows = [(i, m[i % 40] * (1 + i // 40)) for i in range(120)]
    spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "seq long, embedding array<float>").write.parquet(str(tmp_path / "graph_communities.parquet"))
    got = [(r.query, r.key, r.rank) for r in queries.p3_search(spark, str(tmp_path)).orderBy("rank").collect()]
    s = m[0] / np.linalg.norm(m[0]) @ (m / np.linalg.norm(m, axis=1, keepdims=True)).T
    second = int(np.argsort(-s)[1])
    assert got == [(50, 0, 1), (50, 40, 2), (50, 80, 3), (50, second, 4), (50, second + 40, 5)]
