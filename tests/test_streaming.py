import datetime as dt

from pyspark.sql import functions as F

from rankloom.streaming import events as E

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def _log(spark, path, rows, n=2):
    spark.createDataFrame(rows, SCHEMA).repartition(n).write.mode("append").parquet(path)


def _rows(n):
    return [(i, T0 + dt.timedelta(minutes=7 * i), i % 3, "ab"[i % 2], float(i)) for i in range(n)]


def test_stream_equals_batch_and_drops_redelivery(spark, tmp_path):
    path = str(tmp_path / "log")
    _log(spark, path, _rows(40))
    _log(spark, path, _rows(10))
    batch = spark.read.parquet(path)
    assert E.drained(E.deduplicated(E.source(spark, path), ["event_id"])).count() == 40 == E.deduplicated(batch, ["event_id"]).count()
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(E.drained(E.progress(E.source(spark, path), "event_type"), "complete")) == key(E.progress(batch, "event_type"))
    assert key(E.drained(E.latest(E.source(spark, path), ["user_id"]), "complete")) == key(E.latest(batch, ["user_id"]))


def test_windows_sessions_and_late_events(spark, tmp_path):
    path = str(tmp_path / "log")
    _log(spark, path, [(1, T0, 1, "a", 1.0), (2, T0 + dt.timedelta(minutes=59), 1, "a", 1.0), (3, T0 + dt.timedelta(minutes=180), 1, "a", 1.0), (4, T0, 2, "a", 1.0)])
    batch = spark.read.parquet(path)
    got = sorted((r.user_id, r.n, (r.end - r.start).seconds // 60) for r in E.sessions(batch).collect())
    assert got == [(1, 1, 60), (1, 2, 119), (2, 1, 60)]
    assert sorted(r.n for r in E.windowed(batch, "1 hour", "event_type").collect()) == [1, 3]
    assert E.drained(E.windowed(E.source(spark, path), "1 hour", "event_type")).count() <= 2


def _slow_quota(rows, limit):
    state, out = {}, {}
    for e, key, ts, refund in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        start, count = state.get(key, (None, 0))
        if start is None or (ts - start).total_seconds() >= 86400:
            start, count = ts, 0
        ok = True
        if refund:
            count = max(0, count - 1)
        elif count < limit:
            count += 1
        else:
            ok = False
        state[key] = (start, count)
        out[e] = (count, ok)
    return out


def test_quota_is_anchored_at_first_use(spark, tmp_path):
    rows = [(i, f"u{i % 3}", T0 + dt.timedelta(hours=3 * i), i % 5 == 4) for i in range(60)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "event_id long, key string, ts timestamp, refund boolean, used string").repartition(4)
    want = _slow_quota(rows, 3)
    assert {r.event_id: (r.used, r.allowed) for r in E.quota(df, 3).collect()} == want
    path = str(tmp_path / "q")
    df.drop("used").coalesce(1).write.parquet(path)
    assert {r.event_id: (r.used, r.allowed) for r in E.drained(E.quota_stream(E.source(spark, path), 3)).collect()} == want
    odd = spark.createDataFrame([(1, None, T0, None), (2, "k", None, None), (3, "k", T0, None)], "event_id long, key string, ts timestamp, refund boolean")
    assert [r.event_id for r in E.quota(odd, 3).collect()] == [3] and E.quota(odd.limit(0), 3).collect() == []


def test_eviction_and_tail(spark):
    live = spark.createDataFrame([(i, i, i < 3) for i in range(30)], "id int, touched int, running boolean")
    assert sorted(r.id for r in E.evicted(live, 25).collect()) == [3, 4, 5, 6, 7]
    log = spark.range(2000).select(F.col("id").alias("event_id"))
    assert E.retained(log).agg(F.min("event_id")).first()[0] == 800


def test_heartbeat_is_a_stream(spark):
    assert E.heartbeat(spark).isStreaming


def test_cancellation(spark):
    flag = E.Cancellation(spark, "run")
    done = E.over_strategies(["a", "b", "c"], lambda n: (flag.stop() if n == "b" else None, n)[1], flag)
    assert done == ["a", "b"]
