"""The engine as an object: build, search, search in batches, through a cache, and insert."""

from __future__ import annotations

import time
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.config import LSHConfig
from tesserine.operators import cache, lsh, ranking, updates
from tesserine.sources import storage


def one_of(**given) -> str:
    """The name of the one argument that is given; anything else raises."""
    named = [k for k, v in given.items() if v is not None]
    if len(named) != 1:
        raise ValueError(f"exactly one of {', '.join(given)} is needed")
    return named[0]


class Engine:
    """Searches a corpus (image_id, embedding) by its postings; with hashes (image_id, phash) also through a cache."""

    def __init__(self, spark: SparkSession, rows: DataFrame, config: LSHConfig, hashes: DataFrame | None = None, exclude_self: bool = False) -> None:
        self.spark, self.config, self.exclude_self = spark, config, exclude_self
        self.rows, self.hashes = storage.cut(spark, rows), hashes
        self.posted = storage.cut(spark, self._postings(self.rows))
        self.version = 1
        self.cache = cache.LRU(config.cache_max_size)
        self.counts = dict.fromkeys(("exact", "approximate", "miss", "bypass"), 0)
        self.log: list[tuple[int, float]] = []

    def _postings(self, rows: DataFrame) -> DataFrame:
        c = self.config
        return lsh.postings(rows, c.num_tables, c.hash_size, c.embedding_dim, c.random_seed)

    def batch_search(self, queries: DataFrame, top_k: int | None = None) -> DataFrame:
        """(query_id, rank, image_id, score) for queries (image_id, embedding), as one plan for any number; all candidates are scored, bucket by bucket."""
        c = self.config
        return ranking.in_buckets(queries, self.rows, top_k or c.top_k, c.num_tables, c.hash_size, c.embedding_dim, c.random_seed, self.exclude_self)

    def _lookup(self, query: DataFrame, top_k: int | None) -> DataFrame:
        """The same for a query alone, whose few candidates are looked up in the postings."""
        found = lsh.candidates(self._postings(query), self.posted, self.exclude_self)
        return ranking.top(ranking.scored(found, query, self.rows), top_k or self.config.top_k)

    def search(self, embedding: Iterable[float] | None = None, image_id: int | None = None, top_k: int | None = None) -> list[tuple[int, float]]:
        """The best (id, score), best first, for a vector or for an image of the corpus."""
        began = time.perf_counter()
        if one_of(embedding=embedding, image_id=image_id) == "image_id":
            query = self.rows.filter(F.col("image_id") == image_id)
            if query.isEmpty():
                raise KeyError(image_id)
        else:
            vector = [float(x) for x in embedding]
            if len(vector) != self.config.embedding_dim:
                raise ValueError(f"a vector of {self.config.embedding_dim} values is needed")
            query = self.spark.createDataFrame([(-1, vector)], "image_id long, embedding array<double>")
        found = [(r["image_id"], r["score"]) for r in sorted(self._lookup(query, top_k).collect(), key=lambda r: r["rank"])]
        self.log.append((len(found), 1000 * (time.perf_counter() - began)))
        return found

    def cached_search(self, embedding: Iterable[float] | None = None, image_id: int | None = None, top_k: int | None = None) -> list[tuple[int, float]]:
        """K4: a vector bypasses the cache; an image is looked up by its hash, then by near hashes, then searched. Entries are of one top_k and one version of the corpus."""
        if one_of(embedding=embedding, image_id=image_id) == "embedding":
            self.counts["bypass"] += 1
            return self.search(embedding=embedding, top_k=top_k)
        row = self.hashes.filter(F.col("image_id") == image_id).first() if self.hashes is not None else None
        if row is None:
            raise KeyError(image_id)
        key, tag = int(row["phash"]), (top_k or self.config.top_k, self.version)
        held = self.cache.get(key)
        if held is not None and held[0] == tag:
            self.counts["exact"] += 1
            return held[1]
        near = self.cache.nearest(key, self.config.cache_hamming_threshold)
        if near and self.cache.held[near[1]][0] == tag:
            self.counts["approximate"] += 1
            value = self.cache.get(near[1])
            self.cache.put(key, value)
            return value[1]
        self.counts["miss"] += 1
        found = self.search(image_id=image_id, top_k=top_k)
        self.cache.put(key, (tag, found))
        return found

    def warm_cache(self, ids: Iterable[int], top_k: int | None = None) -> list[int]:
        """K5: asks for some images; returns those that failed."""
        failed = []
        for i in ids:
            try:
                self.cached_search(image_id=i, top_k=top_k)
            except KeyError:
                failed.append(i)
        return failed

    def cache_stats(self) -> dict:
        """A20."""
        hits = self.counts["exact"] + self.counts["approximate"]
        total = hits + self.counts["miss"] + self.counts["bypass"]
        mean = sum(ms for _, ms in self.log) / len(self.log) if self.log else 0.0
        return {"total_queries": total, "cache_hits": hits, "cache_misses": self.counts["miss"], "exact_hits": self.counts["exact"], "approximate_hits": self.counts["approximate"], "cache_bypasses": self.counts["bypass"], "hit_rate_pct": round(100 * hits / total, 2) if total else 0.0, "current_cache_size": len(self.cache), "mean_search_latency_ms": round(mean, 2), "estimated_time_saved_ms": round(hits * mean, 2)}

    def search_stats(self) -> DataFrame:
        """Of the searches so far; zeros if there were none."""
        rows = self.spark.createDataFrame([(n, float(ms)) for n, ms in self.log], "n int, ms double")
        p = lambda q: F.coalesce(F.expr(f"percentile(ms, {q}D)"), F.lit(0.0))
        return rows.agg(F.count("*").alias("n"), F.coalesce(F.avg("ms"), F.lit(0.0)).alias("mean_ms"), p(0.5).alias("p50_ms"), p(0.95).alias("p95_ms"), p(0.99).alias("p99_ms"))

    def insert(self, batch: DataFrame) -> None:
        """Adds (image_id, embedding, line) or raises before anything changes; searches see it from the next on, cached results no more."""
        c = self.config
        added = storage.cut(self.spark, updates.insert(batch, self.rows, c.num_tables, c.hash_size, c.embedding_dim, all_or_nothing=True))
        self.rows = storage.cut(self.spark, self.rows.union(batch.select("image_id", "embedding")))
        self.posted = self.posted.union(added)
        self.version += 1


def same_results(a: DataFrame, b: DataFrame) -> bool:
    """Whether two results hold the same rows."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def sample(rows: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """N rows in the order of a hash of their id, the same in every process."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("image_id")).cast("binary")), "image_id").limit(n)


def benchmark_queries(rows: DataFrame, truth: DataFrame, n: int = 200, least: int = 10) -> DataFrame:
    """Query images of the ground truth if ``least`` of them are in the corpus, a sample otherwise."""
    known = rows.join(truth.select(F.col("query_id").alias("image_id")).distinct(), "image_id", "left_semi")
    return sample(known if known.count() >= least else rows, n)


def with_defaults(ids: DataFrame, rows: DataFrame, dim: int) -> DataFrame:
    """Vectors of some ids, zeros where there is none."""
    return ids.join(rows.select("image_id", "embedding"), "image_id", "left").select("image_id", F.coalesce("embedding", F.array_repeat(F.lit(0.0), dim)).alias("embedding"))


def failure_rates(described: DataFrame, limit: float = 0.05) -> DataFrame:
    """Images whose hashes or histogram are all zero, and whether their share is over the limit."""
    bad = (F.col("ahash") == 0) & (F.col("dhash") == 0) & (F.col("phash") == 0)
    return described.agg(F.count("*").alias("n"), F.count_if(bad).alias("zero_hashes"), F.count_if(F.forall("hist", lambda x: x == 0)).alias("zero_histograms")).withColumn("warning", F.greatest("zero_hashes", "zero_histograms") > limit * F.col("n"))
