"""Incremental maintenance."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserine.operators import lsh


def conflicts(batch: DataFrame, rows: DataFrame) -> DataFrame:
    """(image_id, line, reason) of lines that can't be inserted: their id is there, or comes earlier in the batch."""
    again = batch.withColumn("k", F.row_number().over(Window.partitionBy("image_id").orderBy("line")))
    known = rows.select("image_id", F.lit(True).alias("known"))
    both = again.join(known, "image_id", "left")
    return both.filter("known or k > 1").select("image_id", "line", F.when(F.col("known"), "exists").otherwise("repeated").alias("reason"))


def accepted(batch: DataFrame, rows: DataFrame) -> DataFrame:
    """The other lines."""
    return batch.join(conflicts(batch, rows).select("line"), "line", "left_anti")


def insert(batch: DataFrame, rows: DataFrame, tables: int, bits: int, dim: int, all_or_nothing: bool = False) -> DataFrame:
    """The postings that a batch adds. With ``all_or_nothing`` a conflict raises before anything is made."""
    if all_or_nothing and not (bad := conflicts(batch, rows)).isEmpty():
        raise ValueError(f"{bad.count()} lines can't be inserted")
    return lsh.postings(accepted(batch, rows), tables, bits, dim)


def log(added: DataFrame) -> DataFrame:
    """A line for each image with its keys by table."""
    return added.groupBy("image_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("table_id", "bucket_key"))), lambda x: x["bucket_key"]), ",").alias("bucket_keys"))


def last_entries(entries: DataFrame) -> DataFrame:
    """The newest entry of each image."""
    return entries.groupBy("image_id").agg(F.max_by(F.struct("ts", "bucket_keys"), "ts").alias("e")).select("image_id", "e.ts", "e.bucket_keys")


def verify(rows: DataFrame, posted: DataFrame, tables: int, bits: int, dim: int) -> DataFrame:
    """Whether each image stands in the bucket of its key in every table."""
    expected = lsh.postings(rows, tables, bits, dim)
    there = posted.select("image_id", "table_id", "bucket_key", F.lit(True).alias("there")).distinct()
    return expected.join(there, ["image_id", "table_id", "bucket_key"], "left").groupBy("image_id").agg(F.count_if("there").alias("n_found"), F.bool_and(F.coalesce("there", F.lit(False))).alias("verified"))


def latest(features: DataFrame) -> DataFrame:
    """Of rows appended for one image, the last by ingest time (of equal times, any)."""
    newest = features.groupBy("image_id").agg(F.max_by(F.struct(*features.columns), "ingested").alias("row"))
    return newest.select("row.*")


def merge_packs(packs: list[DataFrame]) -> DataFrame:
    """U4: packs as one; of rows with one id the last pack's stays. A missing pack raises."""
    if not packs or any(p is None for p in packs):
        raise FileNotFoundError("a pack is missing")
    together = None
    for i, p in enumerate(packs):
        p = p.withColumn("__pack", F.lit(i))
        together = p if together is None else together.unionByName(p)
    last = Window.partitionBy("image_id").orderBy(F.desc("__pack"))
    return together.withColumn("__k", F.row_number().over(last)).filter("__k = 1").drop("__k", "__pack")


def unprocessed(rows: DataFrame, done: DataFrame) -> DataFrame:
    """The rows that aren't there yet."""
    return rows.join(done.select("image_id"), "image_id", "left_anti")


class Snapshots:
    """Versions of a table as immutable folders; the newest commit file names the current one. Readers need no lock."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_commits")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where, jvm

    def versions(self) -> list[int]:
        fs, where, _ = self._fs()
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(where)) if fs.exists(where) else []

    def append(self, rows: DataFrame) -> int:
        """A new version with these rows added; a writer that comes second fails rather than overwrites."""
        version = (self.versions() or [0])[-1] + 1
        folder = f"{self.path}/data/{version}-{time.time_ns()}"
        rows.write.parquet(folder)
        fs, where, jvm = self._fs()
        out = fs.create(jvm.org.apache.hadoop.fs.Path(where, str(version)), False)
        out.write(bytearray(json.dumps({"folder": folder}).encode()))
        out.close()
        return version

    def read(self, version: int | None = None) -> DataFrame:
        """All rows up to a version, the newest by default."""
        known = self.versions()
        upto = [v for v in known if version is None or v <= version]
        if not upto:
            raise FileNotFoundError("no version yet")
        commits = self.spark.read.json([f"{self.path}/_commits/{v}" for v in upto])
        return self.spark.read.parquet(*sorted(r["folder"] for r in commits.collect()))
