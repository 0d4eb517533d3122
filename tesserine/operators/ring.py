"""Consistent-hash ring."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserine.functions import hashes

VIRTUAL = 3


def ring(spark: SparkSession, nodes: list[str], virtual: int = VIRTUAL) -> DataFrame:
    """(position, node), ``virtual`` places a node."""
    names = spark.createDataFrame([(n,) for n in nodes], "node string").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(virtual - 1))))
    return names.select(hashes.ring_position(F.concat("node", F.lit("_virtual_"), "i")).alias("position"), "node")


def to_json(places: DataFrame) -> str:
    """The ring as a JSON object from position to node; it has nodes x virtual entries, whatever the keys."""
    return json.dumps({str(r["position"]): r["node"] for r in places.orderBy("position", "node").collect()})


def from_json(spark: SparkSession, text: str) -> DataFrame:
    """The ring that to_json() wrote."""
    return spark.createDataFrame([(int(position), node) for position, node in json.loads(text).items()], "position long, node string")


def assigned(keys: DataFrame, places: DataFrame) -> DataFrame:
    """The node of the first place at or after each key's position, around the end. Places are few (nodes x virtual)."""
    order = Window.orderBy("position", "node")
    ranges = places.select(F.lag("position", 1, -1).over(order).alias("low"), F.col("position").alias("high"), "node")
    last = places.agg(F.max("position").alias("low"), F.min_by("node", F.struct("position", "node")).alias("node"))
    ranges = ranges.unionByName(last.select("low", F.lit(2**63 - 1).alias("high"), "node"))
    at = keys.withColumn("position", hashes.ring_position(F.col("key")))
    return at.join(F.broadcast(ranges), (F.col("position") > F.col("low")) & (F.col("position") <= F.col("high"))).select("key", "position", "node")


def load(keys: DataFrame, places: DataFrame) -> DataFrame:
    """Keys on each node, those without any included."""
    n = assigned(keys, places).groupBy("node").agg(F.count("*").alias("n"))
    return places.select("node").distinct().join(n, "node", "left").select("node", F.coalesce("n", F.lit(0)).alias("n"))


def moved(keys: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Keys whose node changes."""
    a = assigned(keys, before).select("key", F.col("node").alias("old_node"))
    return a.join(assigned(keys, after).select("key", F.col("node").alias("new_node")), "key").filter("old_node <> new_node")
