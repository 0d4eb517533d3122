"""Cutting lineage, distributed row numbers, and the sinks of the library."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a folder under /tmp in a local session and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return folder or "file:///tmp/tesserine-checkpoints"


def cut(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``df`` written to the folder of shared_folder() and read again; it goes when the application ends."""
    path = f"{shared_folder(spark)}/tesserine/{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def numbered(spark: SparkSession, df: DataFrame, *order: Column | str, name: str = "seq") -> DataFrame:
    """Rows in order with a gapless number from 0, without bringing all to one task.

    Sorted partitions are written with their place; only the number of rows of each partition reaches the driver.
    """
    placed = cut(spark, df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    sizes = sorted((r["p"], r["n"]) for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    rows, at = [], 0
    for p, n in sizes:
        rows.append((p, at))
        at += n
    shifts = F.broadcast(spark.createDataFrame(rows, "__p long, __at long"))
    return placed.join(shifts, part == F.col("__p")).withColumn(name, F.col("__at") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).drop("__id", "__p", "__at")


def write_postings(postings: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder a table, so that lookups prune by table_id; a table is dealt over tasks and files by ranges of keys."""
    postings.repartitionByRange("table_id", "bucket_key").write.mode(mode).partitionBy("table_id").parquet(path)


def write_features(features: DataFrame, path: str, pack: str = "pack") -> None:
    """O1, O2: columnar features, a folder a pack."""
    features.write.mode("overwrite").option("compression", "zstd").partitionBy(pack).parquet(path)


def write_split(stored: DataFrame, path: str) -> None:
    """Split postings by table, and beside them the table of the keys that were split."""
    stored.repartitionByRange("table_id", "store_key").write.mode("overwrite").partitionBy("table_id").parquet(f"{path}/postings")
    keys = stored.filter("store_key <> bucket_key").groupBy("table_id", "bucket_key").agg(F.count("*").alias("size"), F.countDistinct("store_key").alias("parts"))
    keys.write.mode("overwrite").parquet(f"{path}/split_keys")


def write_report(rows: DataFrame, path: str) -> None:
    """One JSON document a row."""
    rows.write.mode("overwrite").json(path)


def write_curve(rows: DataFrame, path: str) -> None:
    """K, precision and recall with a header."""
    rows.coalesce(1).write.mode("overwrite").csv(path, header=True)
