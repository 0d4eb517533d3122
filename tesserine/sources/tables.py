"""Input tables and what is derived from them (S1-S12 and the fixtures of FIXTURES.md)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.functions import hashes, vectors
from tesserine.sources import storage

#: Images whose id is divisible by EVERY are the query set.
FIRST_VARIANT, EVERY = 2_000_000, 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: (image_id, embedding) in double precision."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def image_files(spark: SparkSession, folder: str, offset: int = 0) -> DataFrame:
    """(image_id, path, content) of the jpg, jpeg and png files under a folder, numbered by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).filter(F.lower("path").rlike(r"\.(jpe?g|png)$")).dropDuplicates(["path"])
    return storage.numbered(spark, files.select("path", "content"), "path", name="image_id").withColumn("image_id", F.col("image_id") + offset)


def ground_truth_json(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, relevant_id) of a JSON object from base id to variant ids."""
    text = spark.read.text(path, wholetext=True)
    pairs = text.select(F.explode(F.from_json("value", "map<string,array<bigint>>")).alias("query_id", "ids"))
    return pairs.select(F.col("query_id").cast("long"), F.explode("ids").alias("relevant_id"))


def point_lookup(rows: DataFrame, ids: DataFrame, *columns: str) -> DataFrame:
    """The rows of some ids."""
    return ids.join(rows.select("image_id", *columns), "image_id")


def paths(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Paths, unknown_id_N where there is none."""
    return rows.join(known, "image_id", "left").select("image_id", F.coalesce("path", F.concat(F.lit("unknown_id_"), F.col("image_id"))).alias("path"))


def features(rows: DataFrame) -> DataFrame:
    """Stand-ins for image descriptors, from a 64-dimensional vector seen as an 8 x 8 patch."""
    e = F.col("embedding")
    at = lambda i: F.element_at(e, i + 1)
    mean = F.aggregate(e, F.lit(0.0), lambda s, x: s + x) / 64
    ordered = F.array_sort(e)
    median = (F.element_at(ordered, 32) + F.element_at(ordered, 33)) / 2
    places = F.sequence(F.lit(0), F.lit(63))
    quarter = lambda i: F.floor(i / 32) * 2 + F.floor((i % 8) / 4)
    cell = lambda x: F.least(F.lit(7), F.greatest(F.lit(0), F.floor((x + 0.5) * 8)))
    return (
        rows.withColumn("__mean", mean)
        .withColumn("__median", median)
        .withColumns(
            {
                "ahash": hashes.bits_to_long(F.transform(e, lambda x: x > F.col("__mean"))),
                "dhash": hashes.bits_to_long(F.transform(places, lambda i: at((i + 1) % 64) > at(i))),
                "phash": hashes.bits_to_long(F.transform(e, lambda x: x > F.col("__median"))),
                "sift": F.transform(places, lambda i: at(i) - at((i + 8) % 64)),
                "orb": F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: (at(2 * i) + at(2 * i + 1)) / 2),
                "hist": F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.size(F.filter(e, lambda x, i: (quarter(i) == F.floor(k / 8)) & (cell(x) == k % 8))) / F.lit(16.0)),
            }
        )
        .drop("__mean", "__median")
    )


def variants(rows: DataFrame) -> DataFrame:
    """Bases and five near duplicates of each, (image_id, base_id, variant, embedding)."""
    noise = lambda x, d: x + F.lit(0.02) * F.col("variant") * (((F.col("image_id") * 7919 + d * 104729 + F.col("variant") * 1299709) % 2001) - 1000) / F.lit(1000.0)
    v = rows.filter(F.col("image_id") % EVERY == 0).withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(5))))
    v = v.withColumn("moved", F.when(F.col("variant") == 0, F.col("embedding")).otherwise(F.transform("embedding", noise)))
    v = v.withColumn("moved", F.when(F.col("variant") == 0, F.col("moved")).otherwise(vectors.l2_normalize(F.col("moved"))))
    base = FIRST_VARIANT + 6 * F.col("image_id")
    return v.select((base + F.col("variant")).alias("image_id"), base.alias("base_id"), "variant", F.col("moved").alias("embedding"))


def searched(rows: DataFrame) -> DataFrame:
    """(image_id, embedding) of the variants and of all images that aren't bases."""
    return variants(rows).select("image_id", "embedding").union(rows.filter(F.col("image_id") % EVERY != 0).select("image_id", "embedding"))


def truth(rows: DataFrame) -> DataFrame:
    return variants(rows).filter("variant > 0").select(F.col("base_id").alias("query_id"), F.col("image_id").alias("relevant_id"))


def truth_as_json(pairs: DataFrame) -> str:
    """The ground truth as the JSON object that ground_truth_json() reads."""
    found: dict[str, list[int]] = {}
    for r in pairs.orderBy("query_id", "relevant_id").toLocalIterator():
        found.setdefault(str(r["query_id"]), []).append(r["relevant_id"])
    return json.dumps(found)


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, key, latency_ms) of the events in order of time."""
    events = table(spark, sf_dir, "events").select("ts", "event_id", F.col("user_id").alias("key"), F.col("value").alias("latency_ms"))
    return storage.numbered(spark, events, "ts", "event_id").select("seq", "key", "latency_ms")


def insert_batch(rows: DataFrame) -> DataFrame:
    """C4: 20 new vectors, and three that conflict: (image_id, embedding, line). Made from the 21 smallest ids."""
    new = rows.filter("image_id < 20").select((F.col("image_id") + 1_000_000).alias("image_id"), F.reverse("embedding").alias("embedding"), F.col("image_id").alias("line"))
    same = rows.filter("image_id = 5").select("image_id", "embedding", F.lit(20).cast("long").alias("line"))
    other = rows.filter("image_id = 6").select("image_id", F.reverse("embedding").alias("embedding"), F.lit(21).cast("long").alias("line"))
    again = rows.filter("image_id = 3").select((F.col("image_id") + 1_000_000).alias("image_id"), "embedding", F.lit(22).cast("long").alias("line"))
    return new.unionByName(same).unionByName(other).unionByName(again)
