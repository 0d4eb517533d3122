"""Operators on small frames, against plain Python."""

import bisect
import hashlib
from collections import OrderedDict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserine.config import LSHConfig
from tesserine.functions import hashes, vectors
from tesserine.operators import balance, cache, codec, evaluate, extract, lsh, ranking, ring, updates
from tesserine.sources import storage, tables
from tesserine.streaming import live


def frame(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "image_id long, embedding array<double>")


def test_config_needs_all_keys():
    assert LSHConfig.from_json(LSHConfig().to_json()) == LSHConfig()
    with pytest.raises(KeyError):
        LSHConfig.from_json("{}")


def test_projections_are_prefixes():
    assert np.array_equal(lsh.projections(3, 4, 8), lsh.projections(5, 4, 8)[:3])


def test_keys_agree_and_zero_vector_is_ones(spark):
    rng = np.random.default_rng(1)
    rows = frame(spark, [(0, np.zeros(8)), *[(i, rng.normal(size=8)) for i in range(1, 30)]])
    fast = {tuple(r) for r in lsh.postings(rows, 3, 5, 8).collect()}
    slow = {tuple(r) for r in lsh.postings_by_column(spark, rows, 3, 5, 8).collect()}
    assert fast == slow
    assert {k for i, _, k in fast if i == 0} == {"11111"}


def test_empty_corpus(spark):
    none = frame(spark, [])
    posted = lsh.postings(none, 2, 3, 4)
    assert lsh.candidates(posted, posted).count() == 0
    assert balance.stats(balance.sizes(posted)).count() == 0


@pytest.mark.parametrize("bits, most", [(3, 4096), (3, 5), (70, 4096)])
def test_pairs_are_candidates_with_votes_and_not_shuffled(spark, monkeypatch, bits, most):
    monkeypatch.setattr(lsh, "PART", most)
    rng = np.random.default_rng(10)
    v = rng.normal(size=(80, 4))
    v[40:50] = v[3]
    rows = frame(spark, list(enumerate(v)))
    posted = lsh.postings(rows, 4, bits, 4)
    got = lsh.pairs(rows.filter("image_id < 60"), rows, 4, bits, 4, F.col("query_id") != F.col("image_id"))
    assert sorted(map(tuple, got.select("query_id", "image_id").collect())) == sorted(map(tuple, lsh.candidates(posted.filter("image_id < 60"), posted).collect()))
    up = lsh.pairs(rows, rows, 4, bits, 4, F.col("query_id") < F.col("image_id"))
    assert sorted(map(tuple, up.collect())) == sorted(map(tuple, lsh.table_votes(posted).collect()))
    assert str(up._jdf.queryExecution().optimizedPlan()).rstrip().split("Join")[0].count("Aggregate") == 0


def test_votes_shuffle_no_pairs(spark):
    from tesserine.plans import queries as plans

    assert "Aggregate" not in plans.table_votes(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[0]


def test_caps(spark):
    rows = [(1, i, t) for t in range(2) for i in range(t * 3, t * 3 + 5)]
    found = spark.createDataFrame(rows, "query_id long, image_id long, table_id int")
    got = sorted(r["image_id"] for r in lsh.capped(found, 5, 2).collect())
    assert got == [0, 1, 2, 3, 4]  # two of each table (0, 1 and 3, 4), then the smallest other
    assert sorted(r["image_id"] for r in lsh.capped_flat(found.select("query_id", "image_id").distinct(), 3).collect()) == [0, 1, 2]


@pytest.mark.parametrize("cap", [1, 5, 9, 200])
def test_caps_in_buckets_equal_caps_of_pairs(spark, cap):
    rng = np.random.default_rng(11)
    rows = frame(spark, list(enumerate(rng.normal(size=(90, 4)))))
    posted = lsh.postings(rows, 3, 2, 4)
    some = posted.filter("image_id % 3 > 0")
    pairs = lsh.matches(some, posted).filter("query_id <> image_id")
    rows_of = lambda df: sorted(map(tuple, df.collect()))
    assert rows_of(lsh.capped_in_buckets(some, posted, cap, 3)) == rows_of(lsh.capped(pairs, cap, 3))
    assert rows_of(lsh.capped_flat_in_buckets(some, posted, cap)) == rows_of(lsh.capped_flat(pairs.select("query_id", "image_id").distinct(), cap))


@pytest.mark.parametrize("name", ["capped_candidates", "capped_flat"])
def test_caps_make_no_pairs(spark, name):
    """The join gives one row a posting; with pairs there were thousands of rows more."""
    from tesserine.plans import queries as plans

    e = tables.embeddings(spark, "/root/testdata/sf0.001")
    plan = plans.QUERIES[name](spark, "/root/testdata/sf0.001")
    joins = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in joins and e.count() * 20 >= plan.count() > 0


def test_exact_search_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(60, 8))
    rows = frame(spark, list(enumerate(v)))
    monkeypatch.setattr(ranking, "QUERY_BLOCK", 7)
    got = {}
    for r in ranking.nearest(spark, rows.filter("image_id < 20"), rows, 3).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["image_id"]))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in range(20):
        s = np.round(u @ u[q], 6)
        s[q] = -9
        assert [i for _, i in sorted(got[q])] == sorted(range(60), key=lambda i: (-s[i], i))[:3]


def test_k_over_the_number_of_rows_and_zero_query(spark):
    rows = frame(spark, [(0, [0, 0]), (1, [1, 0]), (2, [0, 1])])
    pairs = spark.createDataFrame([(0, 1), (0, 2)], "query_id long, image_id long")
    got = ranking.top(ranking.scored(pairs, rows, rows), 10).collect()
    assert [(r["rank"], r["image_id"], r["score"]) for r in sorted(got)] == [(1, 1, 0.0), (2, 2, 0.0)]


@pytest.mark.parametrize("exclude_self", [True, False])
def test_search_in_buckets_equals_scored_candidates(spark, monkeypatch, exclude_self):
    """Ties, copies, zero vectors, buckets in parts and blocks of few rows; no pair is shuffled."""
    rng = np.random.default_rng(7)
    v = rng.normal(size=(150, 6)).round(1)
    v[20:60], v[60:64] = v[3], 0
    rows = frame(spark, list(enumerate(v)))
    queries = rows.filter("image_id % 3 > 0")
    posted = lsh.postings(rows, 3, 2, 6)
    expected = ranking.top(ranking.scored(lsh.candidates(posted.filter("image_id % 3 > 0"), posted, exclude_self), rows, rows), 5)
    expected = sorted(tuple(r) for r in expected.collect())
    for most in (4096, 7):
        monkeypatch.setattr(lsh, "PART", most)
        got = ranking.in_buckets(queries, rows, 5, 3, 2, 6, exclude_self=exclude_self)
        assert sorted(tuple(r) for r in got.collect()) == expected
    from tesserine.plans import queries as plans

    assert "Join Inner" not in plans.search_topk(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["search_unseen", "precision_recall_at_k", "precision_recall_by_query", "micro_pr", "curve_csv", "engine_batch", "stream_search"])
def test_searches_go_by_bucket(spark, monkeypatch, name):
    """Pairs aren't joined with their vectors."""
    from tesserine.plans import queries as plans

    def joined(*_):
        raise AssertionError("pairs joined with vectors")

    monkeypatch.setattr(ranking, "scored", joined)
    assert plans.QUERIES[name](spark, "/root/testdata/sf0.001").columns


def test_exact_search_holds_a_block_of_products():
    """2048 queries and a batch of 10,000 rows had over a GB in one task."""
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    v = np.random.default_rng(13).normal(size=(10_000, 8))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(10_000)), pa.array(list(v))], ["image_id", "embedding"])
    tracemalloc.start()
    out = list(ranking._best(SimpleNamespace(value=(np.arange(2048), v[:2048])), 10, True)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(b.num_rows for b in out) == 20_480 and peak < 200e6


def test_sweep_equals_plain_python_and_joins_no_pairs(spark, monkeypatch):
    """Each configuration's counts and ranks, over blocks of queries, with copies among the rows."""
    monkeypatch.setattr(ranking, "QUERY_BLOCK", 5)
    monkeypatch.setattr(ranking, "scored", None)
    rng = np.random.default_rng(14)
    v = rng.normal(size=(120, 6))
    v[30:45] = v[2]
    rows = frame(spark, list(enumerate(v)))
    queries = spark.createDataFrame([(i,) for i in range(12)], "query_id long")
    truth = spark.createDataFrame([(i, j) for i in range(12) for j in (i + 12, 31, 50)], "query_id long, relevant_id long")
    grid = [(2, 3), (4, 3), (3, 2)]
    monkeypatch.setattr(evaluate, "GRID", grid)
    got = {(r["num_tables"], r["hash_size"]): r for r in evaluate.sweep(spark, rows, queries, truth, 6).collect()}
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    score = (unit @ unit.T).round(6)
    for t, h in grid:
        key = (np.einsum("nd,tbd->ntb", v, lsh.projections(t, h, 6).astype(float)) >= 0) @ (1 << np.arange(h))
        n, h1, h5, h10 = [], [], [], []
        for q in range(12):
            found = [i for i in range(120) if i != q and (key[q] == key[i]).any()]
            best = sorted(found, key=lambda i: (-score[q, i], i))
            hit = [i in (q + 12, 31, 50) for i in best]
            n.append(len(found))
            h1.append(sum(hit[:1])), h5.append(sum(hit[:5]) / 3), h10.append(sum(hit[:10]) / 10)
        r = got[t, h]
        assert np.allclose([r["mean_candidates"], r["precision_at_1"], r["recall_at_5"], r["precision_at_10"]], [np.mean(x) for x in (n, h1, h5, h10)], atol=1e-6)


@pytest.mark.parametrize("allowed", [True, False])
def test_best_over_blocks(monkeypatch, allowed):
    """Ids in any order, ties, copies, blocks of few rows, some pairs left out."""
    monkeypatch.setattr(ranking, "PAIRS", 60)
    monkeypatch.setattr(ranking, "SLICE", 16)
    rng = np.random.default_rng(8)
    v = rng.normal(size=(90, 3)).round(1)
    v[5:30], v[30] = v[2], 0
    ids, own = np.arange(12), rng.permutation(90)
    mask = rng.random((12, 90)) < 0.3 if allowed else np.ones((12, 90), bool)
    best = ranking.Best(ids, v[:12], 4)
    if allowed:
        for a in range(0, 90, 7):
            some = own[a : a + 7]
            best.add(some, v[some], best.unit @ ranking._unit(v[some]).T, mask[:, some])
    else:
        best.see(own, v[own], False)
    score = np.array([ranking._cosine(np.repeat(v[i : i + 1], 90, 0), v) for i in range(12)]).round(6)
    q, found, _ = best.found()
    for i in range(12):
        assert list(found[q == i]) == sorted(np.flatnonzero(mask[i]), key=lambda x: (-score[i, x], x))[:4]


def test_ring_equals_bisect(spark):
    places = ring.ring(spark, ["a", "b", "c"])
    at = sorted((int(hashlib.md5(f"{n}_virtual_{i}".encode()).hexdigest()[:8], 16), n) for n in "abc" for i in range(3))
    keys = spark.createDataFrame([(str(i),) for i in range(200)], "key string")
    for r in ring.assigned(keys, places).collect():
        h = int(hashlib.md5(r["key"].encode()).hexdigest()[:8], 16)
        assert r["node"] == at[bisect.bisect_left(at, (h, "")) % len(at)][1]


def test_histogram_gaps(spark):
    sizes = spark.createDataFrame([(0, str(i), s) for i, s in enumerate([1, 9, 10, 11, 50, 100, 1000, 1001])], "table_id int, bucket_key string, size long")
    got = {r["bin"]: r["n"] for r in balance.histogram(sizes).collect()}
    assert got["1-10"] == 2 and got["11-50"] == 1 and got["51-100"] == 0 and got["1000+"] == 1 and sum(got.values()) == 4
    assert sum(r["n"] for r in balance.histogram_inclusive(sizes).collect()) == 8


def test_split_keeps_matches(spark):
    posted = spark.createDataFrame([(i, 0, "1" if i < 40 else format(i, "b")) for i in range(60)], "image_id long, table_id int, bucket_key string")
    stored = balance.split(posted)
    assert stored.count() == 60 and stored.filter("store_key <> bucket_key").count() == 40
    assert sorted(map(tuple, balance.split_matches(posted, stored).collect())) == sorted(map(tuple, lsh.matches(posted, posted).collect()))


def test_hash_limit_is_strict(spark):
    pair = lambda d: spark.range(1).select(F.struct(F.lit(0).cast("long").alias("ahash"), F.lit(0).cast("long").alias("dhash"), F.lit(0).cast("long").alias("phash")).alias("a"), F.struct(*[F.lit((1 << d) - 1).cast("long").alias(k) for k in ("ahash", "dhash", "phash")]).alias("b"))
    assert pair(25).select(hashes.mean_hamming(F.col("a"), F.col("b"))).first()[0] == 25.0
    assert spark.range(1).select(hashes.hamming(F.lit(-1).cast("long"), F.lit(0).cast("long"))).first()[0] == 64


def test_lru_unit():
    lru = cache.LRU(5)
    for k in (10, 20, 30, 40, 50):
        lru.put(k, k)
    lru.get(10)
    lru.put(60, 60)
    assert lru.get(20) is None and lru.get(10) == 10 and len(lru) == 5
    with pytest.raises(ValueError):
        cache.LRU(0)
    base = 0xAABBCCDD11223344
    near = cache.LRU(5)
    near.put(base, 1)
    assert near.nearest(base ^ 0xF, 8)[0] == 4 and near.nearest(base ^ (0xFF << 32), 8)[0] == 8 and near.nearest(base ^ (0x1FF << 32), 8) is None


@pytest.mark.parametrize("chunk", [7, 50, 1000])
def test_replay_equals_simulation(spark, chunk):
    rng = np.random.default_rng(3)
    keys = rng.zipf(1.5, 300) % 40
    held, expected = OrderedDict(), []
    for k in keys:
        expected.append(k in held)
        held[k] = held.pop(k, None)
        if len(held) > 8:
            held.popitem(last=False)
    log = spark.createDataFrame([(i, int(k)) for i, k in enumerate(keys)], "seq long, key long")
    assert [r["hit"] for r in cache.replay(spark, log, 8, chunk).orderBy("seq").collect()] == expected


@pytest.mark.parametrize("capacity", [1 << 20, 15_000])
def test_replay_of_a_large_cache(spark, capacity):
    """Two passes over 20,000 keys, with room for all and for less: states don't go along with each access of a chunk."""
    n = 20_000
    log = spark.range(2 * n).select(F.col("id").alias("seq"), (F.col("id") % n).alias("key"))
    got = cache.replay(spark, log, capacity, 4000)
    assert "array" not in got._jdf.queryExecution().optimizedPlan().toString().lower() and "held" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.agg(F.count("*"), F.count_if("hit")).first() == (2 * n, n if capacity > n else 0)


def test_replay_goes_on_from_what_is_held(spark):
    rng = np.random.default_rng(9)
    keys = [int(k) for k in rng.zipf(1.4, 400) % 50]
    log = spark.createDataFrame(list(enumerate(keys)), "seq long, key long")
    whole = {r["seq"]: r["hit"] for r in cache.replay(spark, log, 8, 50).collect()}
    held, got = None, {}
    for low, high in [(0, 130), (130, 140), (140, 400)]:
        part = log.filter(F.col("seq").between(low, high - 1))
        got |= {r["seq"]: r["hit"] for r in cache.replay(spark, part, 8, 50, held).collect()}
        held = cache.last_keys(part, 8, held)
    assert got == whole


def test_approximate_replay_is_one_cache(spark):
    """Images with near hashes hit each other whatever their ids, and all share the capacity."""
    rng = np.random.default_rng(4)
    centres = [int(x) for x in rng.integers(0, 2**62, 12)]
    log = [(i, int(rng.integers(0, 1000)), centres[int(rng.integers(0, 12))] ^ int(rng.integers(0, 8))) for i in range(300)]
    held, expected = [], []  # the newest last
    for _, _, h in log:
        near = min(((h ^ x).bit_count(), -k) for k, x in enumerate(held)) if held else (99, 0)
        expected.append("exact" if near[0] == 0 else "approximate" if near[0] <= 8 else "miss")
        if near[0] <= 8:
            held.append(held.pop(-near[1]))
        if near[0]:
            held.append(h)
        del held[:-20]
    rows = spark.createDataFrame(log, "seq long, key long, phash long").repartition(5)
    assert [r["outcome"] for r in cache.replay_approximate(rows, 20, 8).orderBy("seq").collect()] == expected and len(set(expected)) == 3


def test_stream_cache_equals_replay(spark, tmp_path):
    """One cache over the micro-batches."""
    rng = np.random.default_rng(5)
    log = [(i, int(k)) for i, k in enumerate(rng.zipf(1.4, 300) % 60)]
    for part in (log[:170], log[170:]):
        spark.createDataFrame(part, "seq long, key long").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    frame = spark.createDataFrame(log, "seq long, key long")
    live.cached(live.read(spark, frame, f"file://{tmp_path}/in"), f"file://{tmp_path}/state", f"file://{tmp_path}/out", 8).awaitTermination()
    got = [(r["seq"], r["hit"]) for r in spark.read.parquet(f"file://{tmp_path}/out").orderBy("seq").collect()]
    assert got == [(r["seq"], r["hit"]) for r in cache.replay(spark, frame, 8, 1000).orderBy("seq").collect()]


def test_stream_cache_holds_a_chunk_at_most(spark, tmp_path, monkeypatch):
    """Files of one micro-batch in any order; 4000 accesses go to Python in chunks of 500 and not at once."""
    real = cache.replay
    monkeypatch.setattr(live.cache, "replay", lambda s, log, capacity, held=None: real(s, log, capacity, 500, held).withColumn("task", F.spark_partition_id()))
    rng = np.random.default_rng(12)
    log = [(i, int(k)) for i, k in enumerate(rng.zipf(1.3, 4000) % 90)]
    frame = spark.createDataFrame(log, "seq long, key long")
    frame.repartition(5, "key").write.parquet(f"file://{tmp_path}/in")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        live.cached(live.read(spark, frame, f"file://{tmp_path}/in", 1 << 30), f"file://{tmp_path}/state", f"file://{tmp_path}/out", 8).awaitTermination()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    out = spark.read.parquet(f"file://{tmp_path}/out")
    got = [(r["seq"], r["hit"]) for r in out.orderBy("seq").collect()]
    assert got == [(r["seq"], r["hit"]) for r in real(spark, frame, 8, 500).orderBy("seq").collect()] and len(got) == 4000
    assert out.select("task").distinct().count() > 1


def test_probe_equals_all_pairs(spark):
    rng = np.random.default_rng(4)
    held = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 50)]
    asked = [h ^ sum(1 << int(b) for b in rng.choice(62, int(rng.integers(0, 12)), replace=False)) for h in held]
    q = spark.createDataFrame(list(enumerate(asked)), "query_id long, phash long")
    e = spark.createDataFrame([(i, h, i) for i, h in enumerate(held)], "entry_id long, phash long, last_access long")
    far = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    expected = {}
    for i, a in enumerate(asked):
        best = min((far(a, h), -j) for j, h in enumerate(held))
        if best[0] <= 8:
            expected[i] = (-best[1], best[0])
    assert {r["query_id"]: (r["entry_id"], r["distance"]) for r in cache.probe(q, e, 8).collect()} == expected


def test_half_precision_equals_numpy(spark):
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(size=200), rng.normal(size=40) * 1e-6, [0.0, 1.0, -2.0]]).astype(np.float32)
    rows = frame(spark, [(0, v.astype(float))])
    got = rows.select(F.transform("embedding", vectors.half_precision).alias("h")).first()["h"]
    assert np.array_equal(np.array(got), v.astype(np.float16).astype(float))
    assert np.array_equal(np.array(codec.decode(codec.encode(rows)).first()["embedding"]), v.astype(np.float16).astype(float))


def test_inserts(spark):
    rng = np.random.default_rng(6)
    rows = frame(spark, [(i, rng.normal(size=64)) for i in range(30)])
    batch = tables.insert_batch(rows)
    assert sorted((r["line"], r["reason"]) for r in updates.conflicts(batch, rows).collect()) == [(20, "exists"), (21, "exists"), (22, "repeated")]
    with pytest.raises(ValueError):
        updates.insert(batch, rows, 2, 4, 64, all_or_nothing=True)
    added = updates.insert(batch, rows, 2, 4, 64)
    assert added.count() == 40
    assert updates.verify(updates.accepted(batch, rows).select("image_id", "embedding"), added, 2, 4, 64).filter("verified").count() == 20


def test_snapshots(spark, tmp_path):
    shots = updates.Snapshots(spark, f"file://{tmp_path}/index")
    with pytest.raises(FileNotFoundError):
        shots.read()
    assert shots.append(spark.range(3)) == 1 and shots.append(spark.range(3, 5)) == 2
    assert shots.read().count() == 5 and shots.read(1).count() == 3


def test_evaluation_edges(spark):
    queries = spark.createDataFrame([(1,), (2,)], "query_id long")
    results = spark.createDataFrame([(1, 1, 11), (1, 2, 99), (2, 1, 11)], "query_id long, rank int, image_id long")
    truth = spark.createDataFrame([(1, 11), (1, 12)], "query_id long, relevant_id long")
    got = {(r["query_id"], r["k"]): (r["precision"], r["recall"]) for r in evaluate.per_query(queries, results, truth).collect()}
    assert got[1, 1] == (1.0, 0.5) and got[1, 5] == (0.2, 0.5) and got[2, 1] == (0.0, 0.0)


def test_pareto_keeps_equal_points(spark):
    c = spark.createDataFrame([(1, 1, 0.5, 1.0), (2, 2, 0.5, 1.0), (3, 3, 0.4, 2.0), (4, 4, 0.9, 3.0)], "num_tables int, hash_size int, recall_at_5 double, model_ms double")
    assert sorted(r["num_tables"] for r in evaluate.pareto(c).collect()) == [1, 2, 4]


def test_numbered(spark):
    df = spark.range(500).repartition(7).withColumn("x", -F.col("id"))
    got = storage.numbered(spark, df, "x").collect()
    assert sorted((r["seq"], r["id"]) for r in got) == [(i, 499 - i) for i in range(500)]


def test_image_source(spark, tmp_path):
    import struct
    import zlib

    def png(pixels):
        raw = b"".join(b"\0" + row.tobytes() for row in pixels)
        chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")

    rgb = np.zeros((16, 16, 3), np.uint8)
    rgb[:, :, 0] = 255
    rgb[:8, :8, 2] = 200
    (tmp_path / "a.png").write_bytes(png(rgb))
    (tmp_path / "b.png").write_bytes(b"no image")
    found = extract.images(spark, f"file://{tmp_path}")
    assert extract.failures(found).count() == 1
    rows = {r["path"].rsplit("/", 1)[1]: r for r in extract.described(found).collect()}
    hist = np.array(rows["a.png"]["hist"]).reshape(4, 3, 8)
    assert hist[0, 0].argmax() == 6 and (hist[:, 2].argmax(axis=1) == 7).all() and np.allclose(hist.sum(axis=2), 1)
    assert not any(rows["b.png"]["hist"])
    assert [r["image_id"] for r in tables.image_files(spark, f"file://{tmp_path}", offset=5).orderBy("path").collect()] == [5, 6]
    assert extract.preprocess(rgb[:, :, ::-1]).shape == (3, 224, 224)
    extract.EXTRACTORS["mean"] = lambda images: np.array([i.mean(axis=(0, 1)) for i in images])
    assert extract.extracted(found, "mean").count() == 1
