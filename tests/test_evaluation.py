import math

from pyspark.sql import functions as F

from rankloom.operators import aggregates as A, models as P
from rankloom.plans import strategies as R


def _results(spark, rows):
    cols = ["strategy", "item_id", "pos", "question_type", "error", *A.METRICS, "verdict", "latency_ms", "input_tokens", "cached_tokens", "output_tokens", "stage", "cost"]
    types = ["string", "string", "int", "string", "string", *["double"] * 6, "string", "double", "long", "long", "long", "string", "double"]
    return spark.createDataFrame(rows, ", ".join(f"{c} {t}" for c, t in zip(cols, types)))


def _row(s, i, t="x", error=None, m=1.0, verdict="pass", ms=10.0, stage="answer", cost=1.0):
    return (s, f"i{i}", i, t, error, *[m] * 6, verdict, ms, 10, 2, 5, stage, cost)


def test_summary_failures_and_zeros(spark):
    r = _results(spark, [_row("a", 0, m=1.0), _row("a", 1, m=0.5, verdict="partial"), _row("a", 2, error="boom", m=0.0), _row("z", 3, error="boom")])
    s = {x.strategy: x for x in A.summary(r).collect()}
    assert (s["a"].questions, s["a"].failures, s["a"].passed, s["a"].partial, s["a"].failed) == (3, 1, 1, 1, 1)
    assert abs(s["a"].composite - 0.75 * 2 / 3) < 1e-8 and s["a"].ndcg == 0.75 and s["z"].ndcg == 0 and s["z"].composite == 0 and s["z"].failed == 1
    assert A.summary(r.limit(0)).collect() == []


def test_latency_percentiles(spark):
    r = _results(spark, [_row("a", i, ms=v) for i, v in enumerate((1.0, 2.0, 3.0, 10.0))] + [_row("a", 9, error="x", ms=999.0), _row("z", 5, error="x")])
    d = {x.strategy: x for x in A.latency(r, ["latency_ms"]).collect()}
    assert abs(d["a"].p95 - 8.95) < 1e-6 and d["a"].median == 2.5 and d["a"].n == 4 and abs(d["a"].std_dev - math.sqrt(12.5)) < 1e-5
    assert (d["z"].mean, d["z"].p95, d["z"].n) == (0, 0, 0)


def test_types_in_order_and_usage(spark):
    r = _results(spark, [_row("a", 0, "small"), _row("a", 1, "tie"), _row("a", 2, "big"), _row("a", 3, "big"), _row("a", 4, "lost", error="x", stage="embedding", cost=0.0)])
    assert [x.question_type for x in A.by_type(r).orderBy("place").collect()] == ["big", "small", "tie"]
    u = A.usage(r, ["strategy"]).first()
    assert u.input_tokens == 50 and u.embedding_tokens == 10 and u.total_tokens == 75 and set(u.tokens_by_stage) == set(A.STAGES) and u.tokens_by_stage["judge"] == 0
    assert [(x.stage, x.cost) for x in A.cost_breakdown(A.usage(r, ["strategy"]), "strategy").collect()] == [("answer", 4.0)]
    none = spark.createDataFrame([], "strategy string, questions long")
    assert A.per_question(A.usage(r, ["strategy"]), none, "strategy").first().total_tokens == 75


def test_tradeoff_deltas_pivot(spark):
    s = spark.createDataFrame([("a", 0.5, 2.0), ("b", 0.9, 5.0), ("c", 0.9, 1.0)], "strategy string, composite double, cost double")
    got = {x.strategy: (x.is_best, x.is_cheapest) for x in A.tradeoff(s).collect()}
    assert got == {"a": (False, False), "b": (True, False), "c": (False, True)}
    one = {x.strategy: (x.is_best, x.is_cheapest) for x in A.tradeoff(s.where("strategy <> 'b'")).collect()}
    assert one["c"] == (True, False)
    m = s.select("strategy", "composite", *[F.lit(0.0).alias(x) if x == "recall" else F.col("composite").alias(x) for x in A.METRICS])
    d = {x.strategy: x for x in A.deltas(m, ["b", "a"]).collect()}
    assert set(d) == {"a", "b"} and abs(d["a"].ndcg + 4 / 9) < 1e-6 and d["a"].recall is None and d["b"].ndcg == 0
    t = spark.createDataFrame([("a", "x", 0.5)], "strategy string, question_type string, ndcg double")
    assert A.pivot_by_type(t, "ndcg", ["a", "b"]).first().asDict() == {"question_type": "x", "a": 0.5, "b": 0.0}


def test_judge_replies(spark):
    rows = [("x", 2.0, "pass"), ("x", float("nan"), "PASS "), ("x", 0.5, "great"), ("x", None, None), (" ", 1.0, "pass"), (None, 1.0, "pass")]
    got = [(r.score, r.verdict) for r in A.judge_normal(spark.createDataFrame(rows, "answer string, score double, verdict string")).collect()]
    assert got == [(1.0, "pass"), (0.0, "pass"), (0.5, "partial"), (0.0, "fail"), (0.0, "fail"), (0.0, "fail")]


def test_retries_and_errors(spark):
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise P.ModelError("busy", 503)
        return "ok"

    assert P.retried(flaky, P.Settings(sleep=waits.append)) == "ok" and len(waits) == 2 and waits[1] > waits[0]
    bad = []
    try:
        P.retried(lambda: bad.append(1) or (_ for _ in ()).throw(P.ModelError("no", 400)), P.Settings(sleep=waits.append))
    except P.ModelError:
        pass
    assert len(bad) == 1 and P.is_reasoning("gpt-5-nano") and not P.is_reasoning("gpt-4o")


def test_ports_replay_and_failures_are_rows(spark):
    p = spark.createDataFrame([("k1", '{"q": "a"}', 1), ("k2", '{"q": "b"}', 2), ("k2", '{"q": "b"}', 3), ("k3", "broken", 4)], "key string, payload string, n int")
    rec = spark.createDataFrame([("k1", "recorded")], "key string, reply string")

    def port(x):
        if x["q"] == "a":
            raise AssertionError("recorded replies come first")
        return x["q"].upper()

    got = {r.n: (r.reply, (r.error or "")[:4]) for r in P.ask(p, port, rec).collect()}
    assert got == {1: ("recorded", ""), 2: ("B", ""), 3: ("B", ""), 4: (None, "JSON")}


def test_routes_and_queries(spark):
    df = spark.createDataFrame([("broad", 9.0), ("odd", 3.4), (None, None), ("multi_hop", float("nan"))], "c string, k double")
    assert [tuple(r.r) for r in df.select(P.normal_route(F.col("c"), F.col("k")).alias("r")).collect()] == [("broad", 5), ("specific", 3), ("specific", 5), ("multi_hop", 5)]
    q = spark.createDataFrame([("Who?", ['"who?"', "abc", "what is it", "What is IT", "more words"])], "q string, p array<string>")
    assert q.select(P.usable_queries(F.col("q"), F.col("p"), 4).alias("x")).first().x == ["Who?", "what is it", "more words"]


def test_requests():
    assert R.validated(["baseline", "baseline", "advanced"], 5, True, True) == ["baseline", "advanced"]
    for bad in ((["x"], 5, True, True), ([], 5, True, True), (R.STRATEGIES, 5, True, True), (["baseline"], 0, True, True), (["baseline"], 101, True, True), (["baseline"], 5, False, True)):
        try:
            R.validated(*bad)
        except ValueError:
            continue
        raise AssertionError(bad)


def test_strategies_end_to_end(spark):
    docs = [("d1", "team/apex.md", "team", "# Apex\n\nApex Ltd renewed its contract in May 2020. The fee is 12 crowns.\n\n## Office\n\nThe Hull office handles Apex Ltd."), ("d2", "team/bolt.md", "team", "# Bolt\n\nBolt Inc. signed in June 2021. The fee is 99 crowns."), ("d3", "x.md", "root", "Nothing of note.")]
    corpus = spark.createDataFrame(docs, "doc_id string, title string, category string, text string")
    items = spark.createDataFrame([("q1", 0, "When did Apex Ltd renew its contract?", "In May 2020", ["May 2020"], "temporal", None), ("q2", 1, "Which office handles Apex Ltd and who signed?", "The Hull office", ["Hull"], "other", None)], "item_id string, pos int, question string, answer string, keywords array<string>, question_type string, gold array<string>")
    for name, profile, search in (("baseline", "fixed", R.baseline), ("advanced", "structural", R.advanced), ("advanced-pro", "contextual", R.advanced_pro)):
        ix = R.index(corpus, profile)
        rows = {r.query_id: r for r in R.run(items, lambda q: search(q, ix), ix, name).collect()}  # noqa: B023
        assert set(rows) == {"q1", "q2"} and rows["q1"].hit_rate == 1.0 and "May 2020" in rows["q1"].generated and rows["q1"].verdict == "pass"
