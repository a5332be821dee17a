"""Stored chunks, graphs and manifests as Parquet, partitioned by strategy; schema migrations as a table of checksums."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

KEY = ["strategy", "chunk_id"]


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_chunks(spark: SparkSession, path: str, strategy: str) -> DataFrame:
    """SRC-12: the chunks of a strategy, by document and place; only its partition is read."""
    return spark.read.parquet(path).where(F.col("strategy") == strategy).orderBy("doc_id", "ordinal")


def merged(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored rows with the fresh ones put in: a chunk that is there keeps all but embedding, embed_text and context_header.

    A chunk that comes twice in fresh counts once, by the later text.
    """
    changed = ["embedding", "embed_text", "context_header"]
    w = Window.partitionBy(*KEY).orderBy(F.desc("embed_text"))
    one = fresh.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    new = one.select(*KEY, *[F.col(c).alias(f"new_{c}") for c in changed], F.lit(True).alias("_hit"))
    old = stored.join(new, KEY, "left")
    kept = old.select(*[F.when(F.col("_hit"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in stored.columns])
    return kept.unionByName(one.join(stored.select(*KEY), KEY, "left_anti").select(*stored.columns))


def upsert_chunks(path: str, fresh: DataFrame) -> None:
    """SNK-1: writes chunks, replacing only the partitions of the strategies they belong to.

    The merged rows are written beside the table first and moved in by a second write, since Spark can't overwrite what it reads.
    """
    spark = fresh.sparkSession
    if exists(spark, path):
        strategies = fresh.select("strategy").distinct()
        stored = spark.read.parquet(path).join(F.broadcast(strategies), "strategy", "left_semi")
        merged(stored, fresh).write.mode("overwrite").parquet(f"{path}.next")
        fresh = spark.read.parquet(f"{path}.next")
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("strategy").parquet(path)


def clear(spark: SparkSession, path: str, strategy: str | None = None) -> None:
    """SNK-2: removes the rows of a strategy, or all."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path if strategy is None else f"{path}/strategy={strategy}")
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def write_one(path: str, rows: DataFrame) -> None:
    """SNK-3: replaces a small table: a manifest, a graph's counts."""
    rows.coalesce(1).write.mode("overwrite").parquet(path)


def write_graph(path: str, entities: DataFrame, relationships: DataFrame, communities: DataFrame) -> None:
    """GRF-14: a graph as three tables. No index on vectors is kept (SNK-6): search is exact."""
    for name, rows in (("entities", entities), ("relationships", relationships), ("communities", communities)):
        rows.write.mode("overwrite").parquet(f"{path}/{name}")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, ...]:
    """SRC-13: the three tables of a graph."""
    return tuple(spark.read.parquet(f"{path}/{name}") for name in ("entities", "relationships", "communities"))


def coverage(chunks: DataFrame) -> DataFrame:
    """Chunks by strategy, and how many of them have a vector."""
    return chunks.groupBy("strategy").agg(F.count("*").alias("chunks"), F.count("embedding").alias("embedded"))


def is_stale(manifest: DataFrame, fingerprint: DataFrame) -> DataFrame:
    """Whether a manifest was written for another corpus."""
    return manifest.select(F.col("fingerprint").alias("stored")).crossJoin(fingerprint.select("fingerprint")).select("stored", "fingerprint", (F.col("stored") != F.col("fingerprint")).alias("stale"))


def with_cached(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """Chunks with their cached vectors; those without one are to be embedded."""
    return chunks.join(cache.select(*KEY, "embedding"), KEY, "left")


def missing(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """Chunks that have no cached vector."""
    return chunks.join(cache.where("embedding is not null").select(*KEY), KEY, "left_anti")


def seed(spark: SparkSession, path: str, strategies: dict[str, Callable[[], DataFrame]], reset: bool = False, only: str | None = None) -> list[str]:
    """SNK-4: writes the chunks of each strategy that has none yet (all on reset, one with ``only``); gives the names written."""
    have = {r.strategy for r in coverage(spark.read.parquet(path)).collect()} if exists(spark, path) else set()
    done = []
    for name, build in strategies.items():
        if only not in (None, name) or name in have and not reset and only is None:
            continue
        upsert_chunks(path, build().withColumn("strategy", F.lit(name)))
        done.append(name)
    return done


def migrate(spark: SparkSession, path: str, scripts: dict[str, str], run: Callable[[str], object] | None = None) -> list[str]:
    """SNK-5: runs the scripts (by version) that haven't been, in order, and gives their versions.

    A lock file beside the table of what was applied keeps others out (RuntimeError where it is held). Every script is recorded
    as soon as it has run, so one that fails stops there and the next start goes on with it. A script that was
    changed after it ran, or is missing, is a ValueError and nothing runs. ``run`` executes a statement (default: Spark SQL).
    """
    run = run or (lambda sql: spark.sql(sql))
    jvm = spark.sparkContext._jvm
    lock = jvm.org.apache.hadoop.fs.Path(f"{path}.lock")
    fs = lock.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        fs.create(lock, False).close()
    except Exception as e:
        raise RuntimeError(f"{path}: another migration holds the lock") from e
    try:
        schema = "version string, checksum string"
        applied = spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)
        states = {r.version: r.state for r in migration_states(spark.createDataFrame(list(scripts.items()), "version string, sql string"), applied).collect()}
        if wrong := sorted(v for v, s in states.items() if s in ("modified", "missing")):
            raise ValueError(f"scripts changed or missing since they ran: {', '.join(wrong)}")
        done = []
        for version in sorted(v for v, s in states.items() if s == "pending"):
            for statement in filter(str.strip, scripts[version].split(";\n")):
                run(statement)
            spark.createDataFrame([(version, scripts[version])], "version string, sql string").select("version", checksum(F.col("sql")).alias("checksum")).coalesce(1).write.mode("append").parquet(path)
            done.append(version)
        return done
    finally:
        fs.delete(lock, False)


def checksum(c):
    """The first 16 digits of a digest of a script, whatever its line ends."""
    return F.left(F.sha2(F.replace(c, F.lit("\r\n"), F.lit("\n")).cast("binary"), 256), F.lit(16))


def migration_states(files: DataFrame, applied: DataFrame) -> DataFrame:
    """SNK-5: (version, state) of scripts (version, sql) against those applied (version, checksum): applied, pending, modified or missing."""
    j = files.select("version", checksum(F.col("sql")).alias("now")).join(applied.select("version", F.col("checksum").alias("then")), "version", "full_outer")
    state = F.when(F.col("now").isNull(), "missing").when(F.col("then").isNull(), "pending").when(F.col("now") == F.col("then"), "applied").otherwise("modified")
    return j.select("version", state.alias("state"))
