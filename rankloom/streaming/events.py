"""The event log of runs as a stream: replay, dedupe, reduction to the latest state, running figures, sessions and quotas.

Events have event_id, ts, user_id, event_type, value. Every transformation takes a streaming or a batch DataFrame alike.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from rankloom.session import shared_dir

KEPT = 1200
DELAY = "1 hour"
# Uses of an action in a window of 24 hours.
QUOTAS = {"run": 7, "upload": 7, "generate": 3}
WINDOW_MS = 24 * 3600 * 1000


def source(spark: SparkSession, path: str) -> DataFrame:
    """The log as a stream from its start, so that a late reader gets all that was before and then what comes."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        rows = reader.parquet(path)
    else:
        rows = reader.option("pathGlobFilter", place.getName()).parquet(place.getParent().toString())
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def heartbeat(spark: SparkSession, seconds: int = 15) -> DataFrame:
    """STM-2: a ping every so many seconds."""
    beats = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return beats.where(F.col("value") % seconds == 0).select(F.lit("ping").alias("event_type"), F.col("timestamp").alias("ts"))


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that a stream gives for the input that is there now, as a table in the shared folder. Restarts resume from the same checkpoint."""
    spark = stream.sparkSession
    place = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, n: int) -> None:
        if mode == "append":
            batch.write.mode("append").parquet(f"{place}/out")
        else:
            batch.write.mode("overwrite").parquet(f"{place}/out")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/state").trigger(availableNow=True)
    writer.foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/out")


def retained(log: DataFrame, kept: int = KEPT) -> DataFrame:
    """The newest events of a log (event_id), older ones dropped."""
    return log.orderBy(F.desc("event_id")).limit(kept)


def deduplicated(events: DataFrame, keys: list[str]) -> DataFrame:
    """Events without those delivered again (same keys); on a stream within the delay for which state is kept."""
    if events.isStreaming:
        return events.withWatermark("ts", DELAY).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


def latest(events: DataFrame, keys: list[str]) -> DataFrame:
    """The last event of each key: of equal times the one with the larger id."""
    order = F.struct("ts", "event_id")
    return events.groupBy(*keys).agg(F.max(F.col("ts")).alias("ts"), F.max_by("event_id", order).alias("event_id"), F.max_by("value", order).alias("value"))


def progress(events: DataFrame, key: str) -> DataFrame:
    """STM-5, MTH-8: running figures of each key, the mean null without values: events so far, sum and mean of their values."""
    return events.groupBy(key).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"), F.round(F.avg("value"), 6).alias("mean"))


def windowed(events: DataFrame, size: str, key: str) -> DataFrame:
    """Events and values in tumbling windows by key; late ones count until the delay is over."""
    marked = events.withWatermark("ts", DELAY) if events.isStreaming else events
    return marked.groupBy(F.window("ts", size), key).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("window.start").alias("start"), key, "n", "total")


def sessions(events: DataFrame, gap: str = "60 minutes") -> DataFrame:
    """Sessions of a user that end after so much inactivity: first, end (last event and gap) and number of events."""
    marked = events.withWatermark("ts", DELAY) if events.isStreaming else events
    return marked.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def evicted(live: DataFrame, capacity: int = 25) -> DataFrame:
    """Of live sessions (id, touched, running) those to be dropped: the ones untouched longest beyond the capacity, never one that runs.

    Running ones take their place first; ties go by id.
    """
    w = Window.orderBy(F.desc("running"), F.desc("touched"), "id")
    return live.withColumn("place", F.row_number().over(w)).where((F.col("place") > capacity) & ~F.col("running")).drop("place")


USED = "event_id bigint, key string, window_start timestamp, used int, allowed boolean"


def _use(at: int, started: int | None, count: int, limit: int, refund: bool) -> tuple[int, int, bool]:
    """(window start, count, allowed) after an event at a time in ms; a window begins at the first use after the one before is over."""
    if started is None or at - started >= WINDOW_MS:
        started, count = at, 0
    if refund:
        return started, max(0, count - 1), True
    if count >= limit:
        return started, count, False
    return started, count + 1, True


def quota(events: DataFrame, limit: int) -> DataFrame:
    """Whether each event (event_id, key, ts, refund) is within the quota of its key; windows are anchored at first use, refunds give one back.

    State is carried along rows sorted by key and time, so no key is ever gathered, however many events it has.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, started, count = None, None, 0
        for pdf in batches:
            out = []
            for e, k, ts, refund in zip(pdf["event_id"], pdf["key"], pdf["ts"], pdf["refund"]):
                if k != key:
                    key, started, count = k, None, 0
                started, count, ok = _use(int(ts.value // 1_000_000), started, count, limit, bool(refund))
                out.append((e, k, pd.Timestamp(started, unit="ms"), count, ok))
            yield pd.DataFrame(out, columns=["event_id", "key", "window_start", "used", "allowed"])

    rows = events.select("event_id", F.col("key").cast("string").alias("key"), "ts", F.coalesce("refund", F.lit(False)).alias("refund")).where("key is not null and ts is not null")
    return rows.repartition("key").sortWithinPartitions("key", "ts", "event_id").mapInPandas(run, USED)


def quota_stream(events: DataFrame, limit: int) -> DataFrame:
    """As quota, on a stream: the window of each key is state that survives restarts and ends after its 24 hours."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        started, count = state.get if state.exists else (None, 0)
        for pdf in batches:
            out = []
            for e, ts, refund in pdf.sort_values(["ts", "event_id"])[["event_id", "ts", "refund"]].itertuples(index=False):
                started, count, ok = _use(int(ts.value // 1_000_000), started, count, limit, bool(refund))
                out.append((e, key[0], pd.Timestamp(started, unit="ms"), count, ok))
            yield pd.DataFrame(out, columns=["event_id", "key", "window_start", "used", "allowed"])
        if started is not None:
            state.update((started, count))

    rows = events.select("event_id", F.col("key").cast("string").alias("key"), "ts", F.coalesce("refund", F.lit(False)).alias("refund"))
    return rows.groupBy("key").applyInPandasWithState(run, USED, "started long, used int", "append", GroupStateTimeout.NoTimeout)


class Cancellation:
    """STM-9: a flag that runs look at between strategies and questions; stopping cancels the jobs of the run's group."""

    def __init__(self, spark: SparkSession, run_id: str):
        self.spark, self.run_id, self.stopped = spark, run_id, False

    def start(self) -> None:
        self.spark.sparkContext.setJobGroup(self.run_id, self.run_id, interruptOnCancel=True)

    def stop(self) -> None:
        self.stopped = True
        self.spark.sparkContext.cancelJobGroup(self.run_id)


def over_strategies(names: list[str], work, flag: Cancellation) -> list:
    """The results of the strategies in turn, as far as it came before the run was stopped."""
    out = []
    for n in names:
        if flag.stopped:
            break
        out.append(work(n))
    return out
