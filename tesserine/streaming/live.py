"""The engine on streams (ST1-ST4): searches in micro-batches, index maintenance, cache state, running latency."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.operators import cache, lsh, ranking


def read(spark: SparkSession, like: DataFrame, path: str, files_a_batch: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream with the columns of ``like``."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def maintain_index(stream: DataFrame, out: str, checkpoint: str, tables: int, bits: int, dim: int):
    """ST2: new vectors are hashed and appended to the postings, exactly once by the checkpoint."""
    return lsh.postings(stream, tables, bits, dim).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).partitionBy("table_id").trigger(availableNow=True).start()


def search(stream: DataFrame, rows: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], tables: int, bits: int, dim: int, k: int = 10):
    """ST1: each micro-batch of query vectors is one batch search, whose results go to ``sink``."""

    def run(batch: DataFrame, epoch: int) -> None:
        sink(ranking.in_buckets(batch, rows, k, tables, bits, dim), epoch)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cached(stream: DataFrame, checkpoint: str, out: str, capacity: int):
    """ST3: one LRU cache over a stream; writes (seq, key, hit) in a folder an epoch.

    Micro-batches come in the order of seq. Each is replayed in chunks over all tasks from what the cache held after the last
    one, which is kept by epoch beside the checkpoint: an epoch that runs again reads the same and overwrites its own. No task
    holds more than a chunk, however large a micro-batch is.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        held = spark.read.parquet(f"{checkpoint}/held/{epoch - 1}") if epoch else None
        cache.replay(spark, batch, capacity, held=held).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
        cache.last_keys(batch, capacity, held).write.mode("overwrite").parquet(f"{checkpoint}/held/{epoch}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latency(stream: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """ST4: searches and mean latency in tumbling windows of event time."""
    timed = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width)).agg(F.count("*").alias("n"), F.avg("value").alias("mean_ms")).select(F.col("window.start").alias("start"), "n", "mean_ms")
