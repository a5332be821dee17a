from pyspark.sql import functions as F

from rankloom.functions import text as T
from rankloom.functions.ticks import nice_ticks
from rankloom.operators import chunking as C, graph as G, models as P


def test_ticks(spark):
    df = spark.createDataFrame([(0.9,), (350.0,), (1400.0,), (0.0,), (None,), (float("inf"),), (33.0,)], "v double")
    got = [r.t for r in df.select(nice_ticks(F.col("v")).alias("t")).collect()]
    assert got[0] == [0.0, 0.25, 0.5, 0.75, 1.0] and got[2] == [0.0, 350.0, 700.0, 1050.0, 1400.0] and got[3] == got[4] == got[5] == [0.0, 1.0] and got[6] == [0.0, 9.0, 18.0, 27.0, 36.0]
    assert got[1][0] == 0 and got[1][-1] >= 350 and len(got[1]) == 5


def test_embed_input(spark):
    df = spark.createDataFrame([(None,), ("",), ("  ",), ("x ",)], "t string")
    assert [r.x for r in df.select(T.embed_input(F.col("t")).alias("x")).collect()] == [" ", " ", " ", "x "]


def test_headers_cached_written_and_derived(spark):
    docs = spark.createDataFrame([("d", "a/b.md", "cat", "The first sentence. More.")], "doc_id string, title string, category string, text string")
    chunks = spark.createDataFrame([("d", f"c{i}", i, ["H"], f"t{i}") for i in range(3)], "doc_id string, chunk_id string, ordinal int, heading_path array<string>, text string")
    cached = spark.createDataFrame([("c1", "Cached  header here"), ("c1", "Cached  header here"), ("zz", "x")], "chunk_id string, header string")
    got = {r.chunk_id: r.line for r in C.with_headers(chunks, cached, docs, budget=1).collect()}
    assert got == {"c0": "[Context: The first sentence.]\n", "c1": "[Context: Cached header here]\n", "c2": "[Context: cat > a/b > H]\n"}


def test_community_prompts(spark):
    m = spark.createDataFrame([("x", 0, "A"), ("x", 1, "B"), ("x", 2, "C"), ("y", 0, "A"), ("y", 1, "D"), ("one", 0, "A")], "community string, nth int, entity string")
    e = spark.createDataFrame([("A", 3), ("B", 1), ("C", 1), ("D", 9)], "entity string, degree int")
    r = spark.createDataFrame([("A", "B", 1.0), ("B", "C", 5.0), ("A", "D", 2.0)], "source string, target string, weight double")
    got = {x.community: (x["rank"], x.prompt) for x in G.community_prompts(m, e, r, most=2, first=2).collect()}
    assert got == {"y": (12, "Entities:\n- A\n- D\nRelationships:\n- A - D"), "x": (5, "Entities:\n- A\n- B\nRelationships:\n- B - C\n- A - B")}


def test_generated_questions_and_embeddings(spark):
    df = spark.createDataFrame([("Quarterly revenue increased strongly. More text.",), (None,), ("",)], "text string")
    g = [r.g for r in df.select(P.generated_question(F.col("text")).alias("g")).collect()]
    assert g[0].answer == "Quarterly revenue increased strongly." and "quarterly" in g[0].keywords
    v = P.embed(df).collect()
    assert len(v[0].embedding) == 64 and abs(sum(x * x for x in v[0].embedding) - 1) < 1e-5 and v[1].embedding == v[2].embedding


def test_query_plans_of_every_question(spark, tmp_path):
    from rankloom.plans import strategy_queries

    rows = [(f"q{i}", "2024-01-01", i if i < 60 else None, f"What is item {i}?") for i in range(62)] + [("q1", "2024-01-02", 1, "What is the later item?")]
    df = spark.createDataFrame(rows, "id string, loaded_at string, pos long, question string")
    df.selectExpr("*", "'a' as reference_answer", "array('k') as expected_keywords", "'fact' as question_type", "array('c') as gold_chunk_ids").write.parquet(str(tmp_path / "evaluation_items.parquet"))
    assert {r.query_id for r in strategy_queries.query_plans(spark, str(tmp_path)).select("query_id").collect()} == {f"q{i}" for i in range(62)}
