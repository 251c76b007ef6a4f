"""Structured Streaming: snapshots with dedup, exactly-once scoring, windows with late data, reassembly of deltas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


#: State on the executors' disks with one bound of memory per executor, not on their heaps.
STATE_ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "500",
}


def parquet_stream(spark: SparkSession, path: str, files_per_trigger: int | None = 100) -> DataFrame:
    """A stream over a folder of Parquet files (or one file's folder pattern), with the schema of what is there.

    None: a trigger takes all files that are there. Files that are not in the order of their times need that before a
    watermark: what one trigger has seen makes older rows of the next one late.
    """
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    return (reader if files_per_trigger is None else reader.option("maxFilesPerTrigger", files_per_trigger)).parquet(path)


def deduplicated(stream: DataFrame, ts: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Rows once per key; a key is forgotten when the watermark has passed it, so state is bounded."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, ts: str, keys: list[str], window: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts per event-time window and key; rows later than the watermark are dropped."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    return stream.withWatermark(ts, late).groupBy(w, *keys).agg(F.count("*").alias("n"))


def session_counts(stream: DataFrame, ts: str, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap)).agg(F.count("*").alias("n"))


def score_new(stream: DataFrame, key: str, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Scores what has arrived and appends it; keys already in out are skipped, so a replayed batch adds nothing."""

    def one(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        try:
            fresh = fresh.join(spark.read.parquet(out).select(key), key, "left_anti")
        except Exception as e:  # the folder is not there before the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
        score(fresh).write.mode("append").parquet(out)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def complete_passes(items: DataFrame, generated: DataFrame, key: str, run: str) -> DataFrame:
    """run, complete: whether a run's generated keys cover all items."""
    total = items.select(key).distinct().agg(F.count("*").alias("total"))
    have = generated.join(items.select(key).distinct(), key, "left_semi").groupBy(run).agg(F.count_distinct(key).alias("n"))
    return have.join(F.broadcast(total)).select(run, (F.col("n") == F.col("total")).alias("complete"))


def run_to_memory(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs what is available and returns the result; for tests and small results."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def run_to_files(stream: DataFrame, folder: str, settings: dict[str, str] = STATE_ON_DISK) -> DataFrame:
    """Runs what is available and returns the Parquet files that it appended, each row once; no row passes the driver.

    Files and state lie in a folder that driver and executors share. The settings hold for this stream alone: it takes
    a copy of the session's when it starts.
    """
    spark, out = stream.sparkSession, f"{folder}/out"
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start(out)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def next_family(quotas: dict[str, int], kept: dict[str, int], tried: dict[str, int]) -> str | None:
    """Driver-side scheduler: the family furthest from its quota by drafts still needed, at a Laplace keep rate."""
    need = {f: (q - kept.get(f, 0)) / ((kept.get(f, 0) + 1) / (tried.get(f, 0) + 2)) for f, q in quotas.items() if kept.get(f, 0) < q}
    return max(sorted(need), key=need.get) if need else None
