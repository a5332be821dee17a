"""Session helpers: lineage cuts and sized broadcasts that hold on a cluster as well as in tests."""

from __future__ import annotations

import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

#: A side is broadcast by hint only if its row count is at most this (proven by counting it).
BROADCAST_ROWS = 20_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one only where it is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = folder.get() if folder.isDefined() else None
        if not folder:
            folder = tempfile.mkdtemp(prefix="rankloom-checkpoint-")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame, bare: bool = False) -> DataFrame:
    """Computes df once and cuts its lineage with a reliable checkpoint in the shared folder.

    A checkpoint keeps what the engine inferred of its columns (constraints, orders, partitionings); over many rounds of an
    iteration that grows without bound, and ``bare`` leaves it out.
    """
    spark = df.sparkSession
    shared_dir(spark)
    held = df.checkpoint(eager=True)
    if not bare:
        return held
    rows = held._jdf.queryExecution().toRdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, held._jdf.schema(), False), spark)


def small_or_join(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it provably has at most ``rows`` rows, else df as it is (the planner shuffles)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Tables whose rows are dear to work on, so that idle cores cost more than moving them.
DEAR = {"documents", "source_documents", "stored_chunks", "answer_responses", "evaluation_items"}


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files are fewer than those; large inputs have more splits than cores and are left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the input tables, read by path; filters and columns still reach the scan."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(df) if name in DEAR else df


def numbered(df: DataFrame, order: list, into: str) -> DataFrame:
    """df with a number from 0 in the given order, which must be total; no task holds more than its range of the order.

    The rows are parted by ranges and sorted there; a range's numbers begin where those before it end. Only the sizes of the ranges
    come to the driver. The ranges are kept by a lineage cut, so a row's number doesn't change when a task is run again.
    """
    parted = df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.monotonically_increasing_id().alias("_id"))
    held = cut(parted.select("*", F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND((1 << 33) - 1).alias("_nth")))
    begin, starts = 0, []
    for part, n in sorted((r["_part"], r["n"]) for r in held.groupBy("_part").agg(F.count("*").alias("n")).collect()):
        starts.append((part, begin))
        begin += n
    first = df.sparkSession.createDataFrame(starts, "_part bigint, _first bigint")
    return held.join(F.broadcast(first), "_part").select(*[F.col(c) for c in df.columns], (F.col("_first") + F.col("_nth")).alias(into))


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the one with the highest ``order`` (nulls lowest): rows delivered twice count once.

    Done as an aggregate of a struct, so copies are combined before the shuffle and a hot key costs one row a task.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.max(F.struct(*order, *rest)).alias("_row")
    return df.groupBy(*keys).agg(packed).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in [*order, *rest]]).select(*df.columns)


def newest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """As latest, for wide rows few of which are delivered twice: only those are aggregated, the others are not shuffled."""
    often = df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").select(*[F.col(k).alias(f"_{k}") for k in keys])
    often = small_or_join(cut(often), 500_000)
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return df.join(often, same, "left_anti").unionByName(latest(df.join(often, same, "left_semi"), keys, order))


__all__ = ["BROADCAST_ROWS", "StorageLevel", "cut", "latest", "newest", "numbered", "shared_dir", "small_or_join", "spread", "table"]
