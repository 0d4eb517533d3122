"""Bucket statistics, hot buckets and their split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserine.config import DEDUP, FIXED_MS, MS_PER_CANDIDATE, SIZE_BINS
from tesserine.functions import hashes


def sizes(posted: DataFrame) -> DataFrame:
    return posted.groupBy("table_id", "bucket_key").agg(F.count("*").alias("size"))


def _metrics() -> list[Column]:
    p = lambda q: F.expr(f"percentile(size, {q}D)")
    return [F.count("*").alias("n_buckets"), F.sum("size").alias("total"), F.min("size").alias("min"), F.max("size").alias("max"), F.round(F.avg("size"), 6).alias("mean"), p(0.5).alias("median"), F.round(F.stddev_pop("size"), 6).alias("std"), F.round(p(0.95), 6).alias("p95"), F.round(p(0.99), 6).alias("p99"), F.round(F.max("size") / F.avg("size"), 6).alias("imbalance")]


def stats(bucket_sizes: DataFrame) -> DataFrame:
    """A3, A4: of each table."""
    return bucket_sizes.groupBy("table_id").agg(*_metrics())


def stats_rollup(bucket_sizes: DataFrame) -> DataFrame:
    """Of each table and of all (table_id -1), in one pass."""
    return bucket_sizes.rollup("table_id").agg(*_metrics()).withColumn("table_id", F.coalesce("table_id", F.lit(-1)))


def histogram(bucket_sizes: DataFrame) -> DataFrame:
    """A5: buckets in each range, with the gaps at upper bounds."""
    each = F.array(*[F.struct(F.lit(label).alias("bin"), F.sum(F.when((F.col("size") >= low) & (F.col("size") < high if high else F.lit(True)), 1).otherwise(0)).alias("n")) for label, low, high in SIZE_BINS])
    return bucket_sizes.groupBy("table_id").agg(each.alias("bins")).select("table_id", F.explode("bins").alias("b")).select("table_id", "b.bin", "b.n")


def histogram_inclusive(bucket_sizes: DataFrame) -> DataFrame:
    """A5 without gaps: upper bounds belong to their range."""
    name = F.lit(SIZE_BINS[-1][0])
    for label, _, high in reversed(SIZE_BINS[:-1]):
        name = F.when(F.col("size") <= high, label).otherwise(name)
    return bucket_sizes.groupBy("table_id", name.alias("bin")).agg(F.count("*").alias("n"))


def with_mean(bucket_sizes: DataFrame) -> DataFrame:
    means = bucket_sizes.groupBy("table_id").agg(F.avg("size").alias("mean"))
    return bucket_sizes.join(F.broadcast(means), "table_id")


def hotspots(bucket_sizes: DataFrame, times: float = 3.0, most: int = 20) -> DataFrame:
    """Buckets over ``times`` the mean of their table, the largest first, ``most`` a table."""
    best = Window.partitionBy("table_id").orderBy(F.desc("size"), "bucket_key")
    hot = with_mean(bucket_sizes).filter(F.col("size") > times * F.col("mean"))
    return hot.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= most).select("table_id", "rank", "bucket_key", "size", F.round(F.col("size") / F.col("mean"), 6).alias("ratio"))


def by_table(bucket_sizes: DataFrame, times: float = 3.0) -> DataFrame:
    """Of each table its buckets, postings, hot buckets and the share of postings in them."""
    hot = F.col("size") > times * F.col("mean")
    return with_mean(bucket_sizes).groupBy("table_id").agg(F.count("*").alias("n_buckets"), F.sum("size").alias("total"), F.max("size").alias("max"), F.count_if(hot).alias("n_hot"), F.round(F.sum(F.when(hot, F.col("size")).otherwise(0)) / F.sum("size"), 6).alias("hot_share"))


def coldspots(bucket_sizes: DataFrame, under: int = 10) -> DataFrame:
    """P4."""
    return bucket_sizes.filter(F.col("size") < under).select("table_id", "bucket_key", "size")


def latency_model(bucket_sizes: DataFrame, tables: int) -> DataFrame:
    """Modelled milliseconds of a query on the mean, median, p95, p99 and largest bucket."""
    model = lambda x: F.round(FIXED_MS + x * tables * DEDUP * MS_PER_CANDIDATE, 6)
    p = lambda q: F.expr(f"percentile(size, {q}D)")
    return bucket_sizes.agg(model(F.avg("size")).alias("mean_ms"), model(p(0.5)).alias("p50_ms"), model(p(0.95)).alias("p95_ms"), model(p(0.99)).alias("p99_ms"), model(F.max("size")).alias("max_ms"))


def split(posted: DataFrame, times: float = 3.0) -> DataFrame:
    """Postings with store_key, where hot buckets become 16. Only the list of hot keys is joined, not the postings among themselves."""
    hot = with_mean(sizes(posted)).filter(F.col("size") > times * F.col("mean")).select("table_id", "bucket_key", F.lit(True).alias("hot"))
    out = posted.join(hot, ["table_id", "bucket_key"], "left")
    return out.select("image_id", "table_id", "bucket_key", F.when(F.col("hot"), F.concat("bucket_key", hashes.sub_hash(F.col("table_id"), F.col("bucket_key"), F.col("image_id")))).otherwise(F.col("bucket_key")).alias("store_key"))


def split_matches(queries: DataFrame, stored: DataFrame) -> DataFrame:
    """Lookups on the split layout: a query's key meets the bucket of that key and, if it was split, all its 16 parts."""
    parts = F.expr("transform(sequence(0, 15), i -> lpad(bin(i), 4, '0'))")
    q = queries.select(F.col("image_id").alias("query_id"), "table_id", F.explode(F.concat(F.array("bucket_key"), F.transform(parts, lambda x: F.concat("bucket_key", x)))).alias("store_key"))
    return q.join(stored.select("image_id", "table_id", "store_key"), ["table_id", "store_key"]).select("query_id", "image_id", "table_id")


def cohesion(posted: DataFrame, rows: DataFrame) -> DataFrame:
    """For each table, the mean cosine of pairs in one bucket and of other pairs, over all pairs.

    The sum of products over pairs of unit vectors is (|sum|^2 - n) / 2, so no pair is made.
    """
    unit = rows.select("image_id", F.posexplode("embedding").alias("d", "x"))
    norms = unit.groupBy("image_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    unit = unit.join(norms, "image_id").select("image_id", "d", (F.col("x") / F.col("norm")).alias("x"))

    def pairs(sums: DataFrame, *by: str) -> DataFrame:
        return sums.groupBy(*by).agg(F.sum(F.col("s") * F.col("s")).alias("square"), F.max("n").alias("n")).withColumns({"products": (F.col("square") - F.col("n")) / 2, "pairs": F.col("n") * (F.col("n") - 1) / 2})

    everything = pairs(unit.groupBy("d").agg(F.sum("x").alias("s"), F.count("*").alias("n"))).select(F.col("products").alias("all_products"), F.col("pairs").alias("all_pairs"))
    same = pairs(posted.join(unit, "image_id").groupBy("table_id", "bucket_key", "d").agg(F.sum("x").alias("s"), F.count("*").alias("n")), "table_id", "bucket_key")
    same = same.groupBy("table_id").agg(F.sum("products").alias("products"), F.sum("pairs").alias("pairs"))
    return same.crossJoin(F.broadcast(everything)).select("table_id", F.round(F.col("products") / F.col("pairs"), 6).alias("same_bucket"), F.round((F.col("all_products") - F.col("products")) / (F.col("all_pairs") - F.col("pairs")), 6).alias("other_bucket"))
