"""Every query of the library by name: (spark, sf_dir) -> DataFrame over the whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine import engine
from tesserine.config import LOCAL, LSHConfig
from tesserine.functions import hashes, vectors
from tesserine.operators import balance, cache, codec, evaluate, extract, lsh, ranking, ring, updates
from tesserine.sources import storage, tables
from tesserine.streaming import live

T, H, DIM = LOCAL.num_tables, LOCAL.hash_size, LOCAL.embedding_dim
NODES = [f"table_{i}" for i in range(T)]
CAPACITY = 20

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _posted(rows: DataFrame, tables_: int = T, bits: int = H) -> DataFrame:
    return lsh.postings(rows, tables_, bits, DIM)


def _neighbours(rows: DataFrame) -> DataFrame:
    """Pairs of each image and the next."""
    a = rows.select(F.col("image_id").alias("a_id"), F.col("embedding").alias("a"))
    b = rows.select((F.col("image_id") - 1).alias("a_id"), F.col("image_id").alias("b_id"), F.col("embedding").alias("b"))
    return a.join(b, "a_id")


def _variant_search(spark, sf_dir, k: int = 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = tables.embeddings(spark, sf_dir)
    v, truth = tables.variants(e), tables.truth(e)
    bases = v.filter("variant = 0").select("image_id", "embedding")
    return bases.select(F.col("image_id").alias("query_id")), ranking.in_buckets(bases, tables.searched(e), k, T, H, DIM), truth


# --- index


@query
def lsh_keys(spark, d):
    return lsh.postings_by_column(spark, tables.embeddings(spark, d), T, H, DIM)


@query
def postings(spark, d):
    return _posted(tables.embeddings(spark, d))


@query
def bucket_lists(spark, d):
    found = lsh.buckets(_posted(tables.embeddings(spark, d)))
    return found.select("table_id", "bucket_key", "size", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query
def lsh_candidates(spark, d):
    e = tables.embeddings(spark, d)
    return lsh.pairs(e, e, T, H, DIM, F.col("query_id") != F.col("image_id")).select("query_id", "image_id")


@query
def candidate_counts(spark, d):
    p = _posted(tables.embeddings(spark, d), bits=12)
    return lsh.candidate_counts(p, p)


@query
def capped_candidates(spark, d):
    p = _posted(tables.embeddings(spark, d))
    return lsh.capped_in_buckets(p, p, 20, T)


@query
def capped_flat(spark, d):
    p = _posted(tables.embeddings(spark, d))
    return lsh.capped_flat_in_buckets(p, p, 15)


@query
def table_votes(spark, d):
    e = tables.embeddings(spark, d)
    return lsh.pairs(e, e, T, H, DIM, F.col("query_id") < F.col("image_id")).select(F.col("query_id").alias("a"), F.col("image_id").alias("b"), "votes")


@query
def distinct_keys(spark, d):
    return lsh.distinct_keys(_posted(tables.embeddings(spark, d)))


@query
def subsample_index(spark, d):
    return lsh.subsample(_posted(tables.embeddings(spark, d)))


@query
def expand_index(spark, d):
    """The tenfold corpus: the first values of each vector and its norm."""
    e = F.col("embedding")
    return lsh.expand(tables.embeddings(spark, d)).select("image_id", "copy", F.round(F.element_at(e, 1), 6).alias("first"), F.round(F.element_at(e, 64), 6).alias("last"), F.round(vectors.norm(e), 6).alias("norm"))


# --- search


@query
def search_topk(spark, d):
    e = tables.embeddings(spark, d)
    return ranking.in_buckets(e, e, 10, T, H, DIM)


@query
def search_unseen(spark, d):
    """Vectors that aren't in the corpus: the variants."""
    e = tables.embeddings(spark, d)
    v = tables.variants(e).filter("variant > 0").select("image_id", "embedding")
    return ranking.in_buckets(v, e, 10, T, H, DIM, exclude_self=False)


@query
def knn_exact(spark, d):
    """The stated query set, ids divisible by 50, against all rows."""
    e = tables.embeddings(spark, d)
    return ranking.nearest(spark, e.filter("image_id % 50 = 0"), e, 10)


@query
def batch_lookup(spark, d):
    """The rows of the ids divisible by 50; ids that aren't there give nothing."""
    own = tables.embeddings(spark, d).select("image_id")
    ids = own.filter(F.col("image_id") % tables.EVERY == 0).union(own.select(-1 - F.col("image_id")))
    return tables.point_lookup(tables.embeddings(spark, d), ids, "embedding").select("image_id", F.round(F.element_at("embedding", 1), 6).alias("first"))


@query
def path_map(spark, d):
    """The url of the page with an image's id, or unknown_id_N."""
    known = tables.table(spark, d, "pages").select(F.col("page_id").alias("image_id"), F.col("url").alias("path"))
    return tables.paths(tables.embeddings(spark, d).select("image_id"), known)


# --- functions


@query
def normalize_l2(spark, d):
    e = F.col("embedding")
    a, b = vectors.l2_normalize(e), vectors.clamp_normalize(e)
    return tables.embeddings(spark, d).select("image_id", F.round(vectors.norm(e), 6).alias("norm_before"), F.round(vectors.norm(a), 6).alias("norm_after"), F.round(F.element_at(a, 1), 6).alias("first"), F.round(F.element_at(b, 2), 6).alias("second"))


@query
def cosine_pairs(spark, d):
    p = _neighbours(tables.embeddings(spark, d))
    return p.select("a_id", "b_id", F.round(vectors.cosine(F.col("a"), F.col("b")), 6).alias("cosine"), F.round(vectors.cosine_eps(F.col("a"), F.col("b")), 6).alias("cosine_eps"))


@query
def perceptual_hashes(spark, d):
    return tables.features(tables.embeddings(spark, d)).select("image_id", "ahash", "dhash", "phash")


def _feature_pairs(spark, d):
    f = tables.features(tables.embeddings(spark, d))
    a = f.select(F.col("image_id").alias("a_id"), F.struct("ahash", "dhash", "phash", "hist").alias("a"))
    b = f.select((F.col("image_id") - 1).alias("a_id"), F.col("image_id").alias("b_id"), F.struct("ahash", "dhash", "phash", "hist").alias("b"))
    return a.join(b, "a_id")


@query
def hamming_pairs(spark, d):
    x, y = F.col("a.phash"), F.col("b.phash")
    return _feature_pairs(spark, d).select("a_id", "b_id", hashes.hamming(x, y).alias("distance"), hashes.similarity(x, y).alias("similarity"))


@query
def hash_sim3(spark, d):
    m = hashes.mean_hamming(F.col("a"), F.col("b"))
    return _feature_pairs(spark, d).select("a_id", "b_id", F.round(m, 6).alias("mean_distance"), F.round(1 - m / F.lit(64.0), 6).alias("similarity"))


@query
def hist_intersection(spark, d):
    return _feature_pairs(spark, d).select("a_id", "b_id", F.round(vectors.histogram_intersection(F.col("a.hist"), F.col("b.hist")), 6).alias("intersection"))


@query
def fused_similarity(spark, d):
    """Bases and their variants, and each base with the next."""
    e = tables.embeddings(spark, d)
    pairs = tables.truth(e).select("query_id", F.col("relevant_id").alias("image_id"))
    bases = pairs.select("query_id").distinct()
    pairs = pairs.unionByName(bases.select("query_id", (F.col("query_id") + 6).alias("image_id")))
    return ranking.fused(pairs, tables.features(tables.variants(e).select("image_id", "embedding")))


@query
def fused_topk(spark, d):
    e = tables.embeddings(spark, d)
    rows = tables.variants(e).select("image_id", "embedding")
    p = _posted(rows)
    bases = tables.variants(e).filter("variant = 0").select("image_id")
    found = lsh.candidates(p.join(bases, "image_id", "left_semi"), p)
    return ranking.top(ranking.fused(found, tables.features(rows)), 5)


@query
def approx_cache_probe(spark, d):
    """The hashes of variants against those of bases as a cache, last used in order of id."""
    v = tables.variants(tables.embeddings(spark, d))
    f = tables.features(v.select("image_id", "embedding")).select("image_id", "phash")
    held = f.join(v.filter("variant = 0").select("image_id"), "image_id").select(F.col("image_id").alias("entry_id"), "phash", F.col("image_id").alias("last_access"))
    asked = f.join(v.filter("variant > 0").select("image_id"), "image_id").select(F.col("image_id").alias("query_id"), "phash")
    return cache.probe(asked, held, 8)


# --- ring


def _ring_keys(spark, d):
    return tables.embeddings(spark, d).select(F.col("image_id").cast("string").alias("key"))


@query
def ring_positions(spark, d):
    return ring.ring(spark, NODES)


@query
def ring_assign(spark, d):
    return ring.assigned(_ring_keys(spark, d), ring.ring(spark, NODES))


@query
def ring_load(spark, d):
    return ring.load(_ring_keys(spark, d), ring.ring(spark, NODES))


@query
def ring_rebalance_moves(spark, d):
    return ring.moved(_ring_keys(spark, d), ring.ring(spark, NODES), ring.ring(spark, NODES[:-1]))


# --- balance


def _sizes(spark, d):
    return balance.sizes(_posted(tables.embeddings(spark, d)))


@query
def bucket_stats(spark, d):
    return balance.stats(_sizes(spark, d))


@query
def bucket_stats_rollup(spark, d):
    return balance.stats_rollup(_sizes(spark, d))


@query
def bucket_histogram(spark, d):
    return balance.histogram(_sizes(spark, d))


@query
def bucket_histogram_inclusive(spark, d):
    return balance.histogram_inclusive(_sizes(spark, d))


@query
def hotspots(spark, d):
    return balance.hotspots(_sizes(spark, d))


@query
def coldspots(spark, d):
    return balance.coldspots(_sizes(spark, d))


@query
def latency_model(spark, d):
    return balance.latency_model(_sizes(spark, d), T)


@query
def balance_report(spark, d):
    """Total hot buckets, and the aggregate of all tables as JSON."""
    sizes = _sizes(spark, d)
    n = balance.hotspots(sizes, most=1 << 30).agg(F.count("*").alias("total_hotspots"))
    return balance.stats_rollup(sizes).filter("table_id = -1").crossJoin(n).select("total_hotspots", F.to_json(F.struct("n_buckets", "total", "min", "max")).alias("aggregate"))


@query
def split_postings(spark, d):
    return balance.split(_posted(tables.embeddings(spark, d)))


@query
def split_stats(spark, d):
    stored = balance.split(_posted(tables.embeddings(spark, d)))
    return balance.stats(stored.groupBy("table_id", F.col("store_key").alias("bucket_key")).agg(F.count("*").alias("size")))


@query
def split_lookup_equiv(spark, d):
    """Matches by table on both layouts."""
    p = _posted(tables.embeddings(spark, d))
    plain, parted = lsh.matches(p, p), balance.split_matches(p, balance.split(p))
    a = plain.groupBy("table_id").agg(F.count("*").alias("n_plain"), F.sum(F.col("query_id") * 31 + F.col("image_id")).alias("sum_plain"))
    b = parted.groupBy("table_id").agg(F.count("*").alias("n_split"), F.sum(F.col("query_id") * 31 + F.col("image_id")).alias("sum_split"))
    return a.join(b, "table_id").select("table_id", "n_plain", "n_split", (F.col("sum_plain") == F.col("sum_split")).alias("equal"))


@query
def bucket_cohesion(spark, d):
    e = tables.embeddings(spark, d)
    return balance.cohesion(_posted(e), e)


# --- evaluation


@query
def variants(spark, d):
    e = F.col("embedding")
    return tables.variants(tables.embeddings(spark, d)).select("image_id", "base_id", "variant", F.round(F.element_at(e, 1), 6).alias("first"), F.round(F.element_at(e, 64), 6).alias("last"), F.round(vectors.norm(e), 6).alias("norm"))


@query
def ground_truth(spark, d):
    return tables.truth(tables.embeddings(spark, d))


@query
def truth_families(spark, d):
    return evaluate.families(tables.truth(tables.embeddings(spark, d)))


@query
def precision_recall_at_k(spark, d):
    queries, results, truth = _variant_search(spark, d)
    return evaluate.macro(evaluate.per_query(queries, results, truth))


@query
def precision_recall_by_query(spark, d):
    queries, results, truth = _variant_search(spark, d)
    return evaluate.per_query(queries, results, truth)


@query
def micro_pr(spark, d):
    return evaluate.micro(*_variant_search(spark, d))


def _sweep(spark, d):
    e = tables.embeddings(spark, d)
    v = tables.variants(e)
    return evaluate.sweep(spark, tables.searched(e), v.filter("variant = 0").select(F.col("image_id").alias("query_id")), tables.truth(e), DIM)


@query
def tradeoff(spark, d):
    return _sweep(spark, d)


@query
def pareto(spark, d):
    return evaluate.pareto(_sweep(spark, d)).select("num_tables", "hash_size", "recall_at_5", "model_ms")


@query
def sensitivity(spark, d):
    return evaluate.sensitivity(_sweep(spark, d))


@query
def best_config(spark, d):
    return evaluate.best(_sweep(spark, d)).select("num_tables", "hash_size", "recall_at_5")


# --- codec


@query
def f16_roundtrip(spark, d):
    """V5, V6: sums of what the code holds, by image."""
    back = codec.decode(codec.encode(tables.embeddings(spark, d)))
    return back.select("image_id", F.round(F.element_at("embedding", 1), 8).alias("first"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query
def f16_expression(spark, d):
    half = codec.rounded(tables.embeddings(spark, d))
    return half.select("image_id", F.round(F.element_at("half", 1), 8).alias("first"), F.round(F.aggregate("half", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query
def f16_error(spark, d):
    return codec.error(tables.embeddings(spark, d))


# --- cache


@query
def cache_replay_lru(spark, d):
    return cache.replay(spark, tables.query_log(spark, d), CAPACITY, chunk=1000)


@query
def cache_stats(spark, d):
    log = tables.query_log(spark, d)
    return cache.stats(cache.replay(spark, log, CAPACITY), log, CAPACITY, bypasses=3)


@query
def cache_two_pass(spark, d):
    """Two passes over all keys with room for all: the second hits throughout."""
    log = cache.two_passes(tables.query_log(spark, d))
    numbered = storage.numbered(spark, log, "turn", "key")
    room = max(1 << 20, numbered.count())
    replayed = cache.replay(spark, numbered.select("seq", "key"), room).join(numbered.select("seq", "turn"), "seq")
    return replayed.groupBy("turn").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))


@query
def cache_replay_approx(spark, d):
    """K3: the hash of an image is the key; images come in the order of the log."""
    log = tables.query_log(spark, d).select("seq", F.col("key").alias("image_id"))
    f = tables.features(tables.embeddings(spark, d)).select("image_id", "phash")
    return cache.replay_approximate(log.join(f, "image_id"), CAPACITY, 8)


@query
def latency_stats(spark, d):
    """By type of event and over all."""
    events = tables.table(spark, d, "events")
    p = lambda q: F.round(F.expr(f"percentile(value, {q}D)"), 6)
    return events.rollup("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99")).withColumn("event_type", F.coalesce("event_type", F.lit("all")))


# --- updates


@query
def insert_conflicts(spark, d):
    e = tables.embeddings(spark, d)
    return updates.conflicts(tables.insert_batch(e), e)


@query
def insert_batch(spark, d):
    e = tables.embeddings(spark, d)
    return updates.insert(tables.insert_batch(e), e, T, H, DIM)


@query
def insert_log(spark, d):
    e = tables.embeddings(spark, d)
    return updates.log(updates.insert(tables.insert_batch(e), e, T, H, DIM))


@query
def verify_insert(spark, d):
    """The lines inserted, and a line that was not, against the postings with the batch."""
    e = tables.embeddings(spark, d)
    b = tables.insert_batch(e)
    posted = _posted(e).union(updates.insert(b, e, T, H, DIM))
    asked = updates.accepted(b, e).select("image_id", "embedding").union(e.filter("image_id = 7").select(F.lit(-7).cast("long"), "embedding"))
    return updates.verify(asked, posted, T, H, DIM)


@query
def last_entries(spark, d):
    """The newest event of each user."""
    events = tables.table(spark, d, "events").select(F.col("user_id").alias("image_id"), F.struct("ts", "event_id").alias("ts"), F.col("event_type").alias("bucket_keys"))
    return updates.last_entries(events).select("image_id", F.col("ts.event_id").alias("event_id"), "bucket_keys")


@query
def already_processed(spark, d):
    """Images whose id isn't among the labelled documents."""
    done = tables.table(spark, d, "labels").select(F.col("doc_id").alias("image_id")).distinct()
    return updates.unprocessed(tables.embeddings(spark, d).select("image_id"), done)


@query
def pack_merge(spark, d):
    """U4: two packs that share ids; the second's rows stay."""
    e = tables.embeddings(spark, d)
    first = e.filter("image_id < 300").select("image_id", F.lit("first").alias("pack"))
    second = e.filter("image_id >= 200").select("image_id", F.lit("second").alias("pack"))
    return updates.merge_packs([first, second])


@query
def data_validation(spark, d):
    """Checks and whether they hold."""
    e = tables.embeddings(spark, d)
    p = _posted(e)
    counts = e.agg(F.count("*").alias("n"), F.countDistinct("image_id").alias("ids"), F.count_if(F.size("embedding") == DIM).alias("dims"), F.count_if(F.forall("embedding", lambda x: x == 0)).alias("zeros"), (F.max("image_id") - F.min("image_id") + 1).alias("span"))
    totals = p.groupBy("table_id").agg(F.count("*").alias("c")).agg(F.min("c").alias("low"), F.max("c").alias("high"))
    missing = e.select("image_id").join(p.select("image_id").distinct(), "image_id", "left_anti").agg(F.count("*").alias("missing"))
    one = counts.crossJoin(totals).crossJoin(missing)
    checks = {"ids_unique": "ids = n", "ids_dense": "span = n", "dimension": "dims = n", "zero_rate": "zeros <= 0.05 * n", "table_totals": "low = n and high = n", "id_sets_equal": "missing = 0"}
    each = F.array(*[F.struct(F.lit(k).alias("name"), F.expr(v).alias("passed")) for k, v in checks.items()])
    return one.select(F.explode(each).alias("x")).select("x.name", "x.passed")


@query
def config_roundtrip(spark, d):
    """The configuration through its JSON."""
    c = LSHConfig.from_json(LSHConfig().to_json())
    return spark.createDataFrame([(k, v) for k, v in sorted(vars(c).items())], "name string, value long")


@query
def ground_truth_json(spark, d):
    """The ground truth written as JSON and read back."""
    path = f"{_scratch(spark)}/truth"
    text = tables.truth_as_json(tables.truth(tables.embeddings(spark, d)))
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    return tables.ground_truth_json(spark, path)


def _scratch(spark) -> str:
    return f"{storage.shared_folder(spark)}/scratch/{uuid.uuid4().hex}"


@query
def postings_roundtrip(spark, d):
    """Postings written by table, a batch appended as a new version, read at the newest."""
    e = tables.embeddings(spark, d)
    shots = updates.Snapshots(spark, f"{_scratch(spark)}/postings")
    shots.append(_posted(e))
    shots.append(updates.insert(tables.insert_batch(e), e, T, H, DIM))
    return shots.read().groupBy("table_id").agg(F.count("*").alias("n"), F.countDistinct("image_id").alias("n_images"))


@query
def postings_by_table(spark, d):
    """Postings in a folder for each table, read back."""
    path = f"{_scratch(spark)}/tables"
    storage.write_postings(_posted(tables.embeddings(spark, d)), path)
    return spark.read.parquet(path).select("image_id", F.col("table_id").cast("int").alias("table_id"), F.col("bucket_key").cast("string").alias("bucket_key"))


@query
def feature_packs(spark, d):
    """Vectors and features in a folder for each pack, read back."""
    path = f"{_scratch(spark)}/features"
    storage.write_features(tables.features(tables.embeddings(spark, d)).withColumn("pack", F.pmod("image_id", F.lit(4))), path)
    back = spark.read.parquet(path)
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s + x), 6)
    return back.select("image_id", F.col("pack").cast("int").alias("pack"), "phash", total("hist").alias("mass"), F.round(F.element_at("embedding", 1), 6).alias("first"))


@query
def feature_upsert(spark, d):
    """Newer rows of the ids divisible by 50 are appended; reading takes the newest."""
    e = tables.embeddings(spark, d).withColumn("ingested", F.lit(0))
    newer = e.filter(F.col("image_id") % tables.EVERY == 0).withColumns({"embedding": F.reverse("embedding"), "ingested": F.lit(1)})
    return updates.latest(e.union(newer)).select("image_id", "ingested", F.round(F.element_at("embedding", 1), 6).alias("first"))


@query
def split_keys(spark, d):
    """Balanced tables and the keys that were split, written and read back."""
    path = f"{_scratch(spark)}/balanced"
    storage.write_split(storage.cut(spark, balance.split(_posted(tables.embeddings(spark, d)))), path)
    held = spark.read.parquet(f"{path}/postings").groupBy(F.col("table_id").cast("int").alias("table_id"), F.col("bucket_key").cast("string").alias("bucket_key")).agg(F.count("*").alias("stored"))
    return spark.read.parquet(f"{path}/split_keys").join(held, ["table_id", "bucket_key"]).select("table_id", "bucket_key", "size", "stored", "parts")


@query
def balance_by_table(spark, d):
    return balance.by_table(_sizes(spark, d))


@query
def report_json(spark, d):
    """The report of each table as JSON, read back."""
    path = f"{_scratch(spark)}/report"
    storage.write_report(balance.by_table(_sizes(spark, d)), path)
    return spark.read.schema("table_id int, n_buckets long, total long, max long, n_hot long, hot_share double").json(path)


@query
def curve_csv(spark, d):
    """Precision and recall by k as CSV, read back."""
    path = f"{_scratch(spark)}/curve"
    storage.write_curve(evaluate.macro(evaluate.per_query(*_variant_search(spark, d))), path)
    return spark.read.schema("k int, precision double, recall double").csv(path, header=True)


@query
def projections_roundtrip(spark, d):
    """The hyperplanes of the index written and read back."""
    path = f"{_scratch(spark)}/projections"
    lsh.projection_rows(spark, T, H, DIM).write.parquet(path)
    return spark.read.parquet(path).select("table_id", "bit", F.round(F.element_at("w", 1), 6).alias("first"), F.round(F.element_at("w", DIM), 6).alias("last"))


@query
def ring_roundtrip(spark, d):
    """Keys by a ring that went through its JSON."""
    return ring.load(_ring_keys(spark, d), ring.from_json(spark, ring.to_json(ring.ring(spark, NODES))))


@query
def sorted_configs(spark, d):
    """W8."""
    return evaluate.ordered(_sweep(spark, d)).select("place", "num_tables", "hash_size", "recall_at_5", "model_ms")


@query
def f16_similarity(spark, d):
    return codec.similarity(_neighbours(tables.embeddings(spark, d)))


@query
def sample_rows(spark, d):
    """A sample is the feature here: 50 ids in the order of a hash."""
    return engine.sample(tables.embeddings(spark, d), 50).select("image_id")


@query
def benchmark_queries(spark, d):
    """None of the truth's ids is in the corpus, so a sample of the corpus serves."""
    e = tables.embeddings(spark, d)
    return engine.benchmark_queries(e, tables.truth(e)).select("image_id")


@query
def test_store(spark, d):
    """Vectors of the documents' ids, zeros where there is no image."""
    ids = tables.table(spark, d, "documents").select(F.col("doc_id").alias("image_id"))
    return engine.with_defaults(ids, tables.embeddings(spark, d), DIM).select("image_id", F.round(vectors.norm(F.col("embedding")), 6).alias("norm"))


@query
def engine_batch(spark, d):
    """The engine object over the stated query set, its own id among the results."""
    e = tables.embeddings(spark, d)
    return engine.Engine(spark, e, LOCAL).batch_search(e.filter("image_id % 50 = 0"))


# --- without an exact SQL twin: streams, ordered state, components whose sign is free, images


@query
def pca_project(spark, d):
    """The share of variance of each of the first eight components."""
    _, explained = extract.principal_components(tables.embeddings(spark, d), 8)
    return spark.createDataFrame([(i, round(float(x), 6)) for i, x in enumerate(explained)], "component int, explained double")


@query
def stream_insert(spark, d):
    """ST2: the corpus as a stream of files into postings."""
    e = tables.embeddings(spark, d)
    where = _scratch(spark)
    e.repartition(3, "image_id").write.parquet(f"{where}/in")
    live.maintain_index(live.read(spark, e, f"{where}/in"), f"{where}/out", f"{where}/state", T, H, DIM).awaitTermination()
    return spark.read.parquet(f"{where}/out").select("image_id", F.col("table_id").cast("int").alias("table_id"), F.col("bucket_key").cast("string").alias("bucket_key"))


@query
def stream_search(spark, d):
    """ST1: the stated query set as a stream, each micro-batch one search."""
    e = storage.cut(spark, tables.embeddings(spark, d))
    where = _scratch(spark)
    e.filter("image_id % 50 = 0").repartition(2, "image_id").write.parquet(f"{where}/in")
    live.search(live.read(spark, e, f"{where}/in"), e, f"{where}/state", lambda rows, epoch: rows.write.mode("overwrite").parquet(f"{where}/out/epoch={epoch}"), T, H, DIM).awaitTermination()
    return spark.read.parquet(f"{where}/out").drop("epoch")


@query
def stream_cache(spark, d):
    """ST3: hits of the cache over the log as a stream in one batch."""
    log = tables.query_log(spark, d).select("seq", "key")
    where = _scratch(spark)
    log.write.parquet(f"{where}/in")
    live.cached(live.read(spark, log, f"{where}/in", files_a_batch=1 << 30), f"{where}/state", f"{where}/out", CAPACITY).awaitTermination()
    return spark.read.parquet(f"{where}/out").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))


@query
def stream_latency(spark, d):
    """ST4: hourly windows of the events as a stream."""
    events = tables.table(spark, d, "events").select("ts", "value")
    where = _scratch(spark)
    events.coalesce(1).write.parquet(f"{where}/in")
    name = f"latency_{uuid.uuid4().hex}"
    live.latency(live.read(spark, events, f"{where}/in")).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n", F.round("mean_ms", 6).alias("mean_ms"))


@query
def image_features(spark, d):
    """Hashes and histograms of vectors drawn as 8 x 8 images."""
    e = tables.embeddings(spark, d)
    pixel = F.transform("embedding", lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((x + 0.5) * 256))).cast("int"))
    drawn = e.select(F.col("image_id").cast("string").alias("path"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("channels"), F.unhex(F.array_join(F.transform(pixel, lambda v: F.lpad(F.hex(v), 2, "0")), "")).alias("data"))
    return extract.described(drawn).select("path", "ahash", "dhash", "phash", F.round(F.aggregate(F.col("hist").cast("array<double>"), F.lit(0.0), lambda s, x: s + x), 6).alias("mass"))
