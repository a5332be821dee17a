import random

from pyspark.sql import functions as F

from rankloom.operators import graph as G

BARBELL = [("a", "b", 10.0), ("b", "c", 10.0), ("a", "c", 10.0), ("d", "e", 10.0), ("e", "f", 10.0), ("d", "f", 10.0), ("c", "d", 1.0)]


def _modularity(nodes, edges, label):
    m = sum(w for *_, w in edges)
    q = 0.0
    for c in set(label.values()):
        inner = sum(w for s, t, w in edges if label[s] == label[t] == c)
        degree = sum(w * ((label[s] == c) + (label[t] == c)) for s, t, w in edges)
        q += inner / m - (degree / (2 * m)) ** 2
    return q


def _levels(spark, nodes, edges):
    rows = G.louvain(spark.createDataFrame(list(zip(nodes, range(len(nodes)))), "node string, pos long"), spark.createDataFrame(edges, "source string, target string, weight double")).collect()
    out = {}
    for r in rows:
        out.setdefault(r.level, {})[r.node] = r.community
    return out


def test_barbell_has_two_communities(spark):
    (level,) = list(_levels(spark, [*"abcdef", "alone"], [*BARBELL, ("a", "a", 3.0), ("ghost", "a", 5.0)]).values())[:1]
    assert [level[n] for n in "abcdef"] == ["c0_0"] * 3 + ["c0_1"] * 3 and level["alone"] == "c0_2"
    assert _modularity(list("abcdef"), BARBELL, level) > 0.3


def test_no_edges_and_unknown_ends(spark):
    assert _levels(spark, ["a", "b"], []) == {} and _levels(spark, ["a", "b"], [("a", "ghost", 1.0)]) == {}
    got = _levels(spark, ["a", "b"], [("a", "b", 0.0), ("a", "a", 2.0)])
    assert got in ({}, {0: {"a": "c0_0", "b": "c0_0"}})


def test_chained_triangles_have_levels(spark):
    nodes = [f"g{g}n{i}" for g in range(6) for i in range(3)]
    edges = [(f"g{g}n{i}", f"g{g}n{(i + 1) % 3}", 20.0) for g in range(6) for i in range(3)] + [(f"g{g - 1}n0", f"g{g}n0", 1.0) for g in range(1, 6)]
    got = _levels(spark, nodes, edges)
    assert len(set(got[0].values())) >= 4
    for level in range(1, len(got)):
        assert set(got[level]) == set(nodes) and len(set(got[level].values())) < len(set(got[level - 1].values()))
        assert len({(got[level - 1][n], got[level][n]) for n in nodes}) == len(set(got[level - 1].values()))  # nested


def _one_after_the_other(nodes, edges):
    """Best modularity by single moves in order, from single nodes: what a sequential first level reaches."""
    label = {n: i for i, n in enumerate(nodes)}
    best, again = _modularity(nodes, edges, label), True
    while again:
        again = False
        for n in nodes:
            for c in sorted(set(label.values())):
                before, label[n] = label[n], c
                q = _modularity(nodes, edges, label)
                if q > best + 1e-9:
                    best, again = q, True
                else:
                    label[n] = before
    return best


def test_moves_in_turns_are_as_good_as_in_order(spark):
    rng = random.Random(5)
    nodes = [f"n{i}" for i in range(24)]
    edges = sorted({(nodes[i], nodes[j]) for i in range(24) for j in range(i + 1, 24) if rng.random() < (0.5 if i // 8 == j // 8 else 0.03)})
    edges = [(s, t, 1.0 + rng.random()) for s, t in edges]
    got = _levels(spark, nodes, edges)
    q = max(_modularity(nodes, edges, level) for level in got.values())
    assert q > 0.97 * _one_after_the_other(nodes, edges) > 0.3


def test_modularity_matches_the_formula(spark):
    label = dict(a=0, b=0, c=0, d=1, e=1, f=1)
    parts = spark.createDataFrame(list(label.items()), "node string, community int")
    q = G.modularity(spark.createDataFrame(BARBELL, "source string, target string, weight double"), parts).first()[0]
    assert abs(q - _modularity(list("abcdef"), BARBELL, label)) < 1e-8


def test_hub_counts_less_than_a_rare_entity(spark):
    units = spark.createDataFrame([("HUB", f"u{i}") for i in range(200)] + [("RARE", "u1")] * 2, "entity string, unit string")
    w = spark.createDataFrame([(1, "HUB", 1.0), (2, "RARE", 1.0)], "query_id int, entity string, weight double")
    s = {(r.query_id, r.doc_id): r.score for r in G.score_units(w, units).collect()}
    assert s[(2, "u1")] > 4 * s[(1, "u1")]
    q = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    spec = {r.query_id: r.weight for r in G.specificity(w, units, q).collect()}
    assert spec[3] == 0.6 and spec[2] > 1.4 and spec[1] < 0.9


def test_relationships_merge_and_drop_unknown_ends(spark):
    raw = spark.createDataFrame([(2, "B", "a ", "later", 3.0), (1, "a", "B", "first", 30.0), (3, "a", "zz", "x", 1.0), (4, "a", " A", "loop", 1.0), (5, "a", "b", "nan", float("nan"))], "seq int, source string, target string, description string, weight double")
    known = spark.createDataFrame([("A",), ("B",)], "entity string")
    (r,) = G.merge_relationships(raw, known).collect()
    assert (r.source, r.target, r.description, r.weight, r.mentions) == ("A", "B", "first", 10.0, 3)


def test_entities_merge(spark):
    raw = spark.createDataFrame([(1, " Apex  Ltd", None, "x"), (2, "apex ltd", "ORG", "longer"), (3, "APEX LTD", "ORG", "equal!"), (4, "  ", "ORG", "dropped"), (5, None, None, None)], "seq int, name string, type string, description string")
    (e,) = G.merge_entities(raw).collect()
    assert (e.entity, e.name, e.degree, e.description) == ("APEX LTD", "Apex  Ltd", 3, "longer")


def test_names_of_any_length_and_alike(spark):
    names = spark.createDataFrame([("BANK OF NEW ENGLAND", 2), ("ACME-NORTH", 1), ("ACME NORTH", 5), ("ONE TWO THREE FOUR FIVE SIX SEVEN", 1), ("AB", 9)], "entity string, degree long")
    units = spark.createDataFrame([(1, "The Bank of New England sued Acme North."), (2, "one two three four five six seven"), (3, "ab, bank of new"), (4, None)], "unit long, text string")
    got = {(r.unit, r.at, r.entity) for r in G.mentions(units, names).collect()}
    assert got == {(1, 2, "BANK OF NEW ENGLAND"), (1, 7, "ACME-NORTH"), (1, 7, "ACME NORTH"), (2, 1, "ONE TWO THREE FOUR FIVE SIX SEVEN")}
    asked = units.select(F.col("unit").alias("query_id"), "text")
    assert [(r.entity, r.score) for r in G.match_entities(asked, names).where("query_id = 1").orderBy("rank").collect()] == [("BANK OF NEW ENGLAND", 192), ("ACME NORTH", 105), ("ACME-NORTH", 101)]
    assert G.mentions(units, names.limit(0)).collect() == []
