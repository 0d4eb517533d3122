"""Quality of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserine.config import FIXED_MS, GRID, MS_PER_CANDIDATE
from tesserine.operators import ranking
from tesserine.sources import storage

KS = (1, 5, 10, 20)


def families(truth: DataFrame) -> DataFrame:
    """(query_id, relevant_id) for bases and, for their variants, the variants of the base."""
    member = truth.select(F.col("relevant_id").alias("member"), F.col("query_id").alias("base"))
    own = truth.join(member, truth["query_id"] == member["base"]).select(F.col("member").alias("query_id"), "relevant_id")
    return truth.unionByName(own)


def per_query(queries: DataFrame, results: DataFrame, truth: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """Precision and recall of every query at each k; both 0 for a query without relevant rows."""
    relevant = truth.groupBy("query_id").agg(F.countDistinct("relevant_id").alias("n_relevant"))
    hits = results.join(truth.withColumnRenamed("relevant_id", "image_id"), ["query_id", "image_id"], "left_semi").select("query_id", "rank")
    at = queries.select("query_id").withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    counted = at.join(hits, "query_id").filter("rank <= k").groupBy("query_id", "k").agg(F.count("*").alias("hits"))
    both = at.join(counted, ["query_id", "k"], "left").join(relevant, "query_id", "left")
    hits_ = F.coalesce("hits", F.lit(0))
    return both.select("query_id", "k", (hits_ / F.col("k")).alias("precision"), F.coalesce(hits_ / F.expr("nullif(n_relevant, 0)"), F.lit(0.0)).alias("recall"))


def macro(each: DataFrame) -> DataFrame:
    """A14."""
    return each.groupBy("k").agg(F.round(F.avg("precision"), 6).alias("precision"), F.round(F.avg("recall"), 6).alias("recall"))


def micro(queries: DataFrame, results: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    """Hits over all results asked for, and over all relevant rows."""
    hits = results.filter(F.col("rank") <= k).join(truth.withColumnRenamed("relevant_id", "image_id"), ["query_id", "image_id"], "left_semi").agg(F.count("*").alias("hits"))
    n = queries.agg((F.count("*") * k).alias("asked"))
    total = truth.join(queries, "query_id", "left_semi").agg(F.count("*").alias("relevant"))
    return hits.crossJoin(n).crossJoin(total).select("hits", (F.col("hits") / F.col("asked")).alias("precision"), (F.col("hits") / F.col("relevant")).alias("recall"))


def sweep(spark: SparkSession, rows: DataFrame, queries: DataFrame, truth: DataFrame, dim: int) -> DataFrame:
    """Every configuration of the grid, over rows that are written once, dealt over all tasks. Tables are prefixes of larger
    ones, so each number of bits is hashed once; the ten best of each query are ranked, all candidates are counted."""
    rows = storage.cut(spark, rows.repartition(2 * spark.sparkContext.defaultParallelism, "image_id"))
    grid = F.broadcast(spark.createDataFrame(GRID, "num_tables int, hash_size int"))
    wanted = rows.join(queries.withColumnRenamed("query_id", "image_id"), "image_id", "left_semi")
    each = ranking.by_configuration(spark, wanted, rows, GRID, dim, 10)
    best = Window.partitionBy("num_tables", "hash_size", "query_id").orderBy(F.desc_nulls_last("score"), "image_id")
    each = each.withColumn("rank", F.row_number().over(best)).join(truth.select("query_id", F.col("relevant_id").alias("image_id"), F.lit(1).alias("hit")), ["query_id", "image_id"], "left")
    relevant = truth.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    per = each.groupBy("num_tables", "hash_size", "query_id").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("rank") <= 1, F.col("hit"))).alias("h1"), F.sum(F.when(F.col("rank") <= 5, F.col("hit"))).alias("h5"), F.sum(F.when(F.col("rank") <= 10, F.col("hit"))).alias("h10"))
    every = queries.crossJoin(grid).join(per, ["num_tables", "hash_size", "query_id"], "left").join(relevant, "query_id", "left").na.fill(0)
    out = every.groupBy("num_tables", "hash_size").agg(F.round(F.avg("h1"), 6).alias("precision_at_1"), F.round(F.avg(F.col("h5") / F.col("n_relevant")), 6).alias("recall_at_5"), F.round(F.avg(F.col("h10") / 10), 6).alias("precision_at_10"), F.round(F.avg("n"), 6).alias("mean_candidates"))
    return out.withColumn("model_ms", F.round(FIXED_MS + F.col("mean_candidates") * MS_PER_CANDIDATE, 6))


def ordered(configs: DataFrame) -> DataFrame:
    """Configurations with their place by recall at 5, then by latency; there are as many as the grid has."""
    return configs.withColumn("place", F.row_number().over(Window.orderBy(F.desc("recall_at_5"), "model_ms", "num_tables", "hash_size")))


def pareto(configs: DataFrame) -> DataFrame:
    """Configurations that none beats in one of latency and recall and equals in the other."""
    a, b = configs.alias("a"), configs.alias("b")
    return a.join(b, F.expr("b.model_ms <= a.model_ms and b.recall_at_5 >= a.recall_at_5 and (b.model_ms < a.model_ms or b.recall_at_5 > a.recall_at_5)"), "left_anti")


def sensitivity(configs: DataFrame) -> DataFrame:
    """One parameter fixed, the other in order, with latency over that of the first."""
    by_tables = configs.filter("hash_size = 12").select(F.lit("num_tables").alias("varied"), F.col("num_tables").alias("value"), "recall_at_5", "model_ms")
    by_bits = configs.filter("num_tables = 10").select(F.lit("hash_size").alias("varied"), F.col("hash_size").alias("value"), "recall_at_5", "model_ms")
    first = F.first_value("model_ms").over(Window.partitionBy("varied").orderBy("value"))
    return by_tables.unionByName(by_bits).withColumn("speed_up", F.round(first / F.col("model_ms"), 6))


def best(configs: DataFrame) -> DataFrame:
    """The first of those with the highest recall at 5, in the order of the grid."""
    order = F.expr(" ".join(["case"] + [f"when num_tables = {t} and hash_size = {h} then {i}" for i, (t, h) in enumerate(GRID)] + ["end"]))
    return configs.orderBy(F.desc("recall_at_5"), order).limit(1)
