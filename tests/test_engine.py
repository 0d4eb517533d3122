"""The engine object on a small corpus."""

import numpy as np
import pytest

from tesserine import engine
from tesserine.config import LSHConfig

CONFIG = LSHConfig(num_tables=4, hash_size=4, embedding_dim=8, top_k=3, cache_max_size=5)


@pytest.fixture(scope="module")
def built(spark):
    v = np.random.default_rng(1).normal(size=(40, 8))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "image_id long, embedding array<double>")
    hashes = spark.createDataFrame([(i, 0x0F0F << 40 if i == 0 else (0x0F0F << 40) ^ 3 if i == 1 else i * 0x0123456789ABCD) for i in range(40)], "image_id long, phash long")
    return engine.Engine(spark, rows, CONFIG, hashes), v


def test_search_and_cache(spark, built):
    e, v = built
    by_id, by_vector = e.search(image_id=7), e.search(embedding=v[7])
    assert by_id == by_vector and by_id[0] == (7, 1.0) and len(by_id) == 3
    for wrong in ({}, {"embedding": v[0], "image_id": 1}, {"embedding": v[0][:3]}):
        with pytest.raises(ValueError):
            e.search(**wrong)
    with pytest.raises(KeyError):
        e.search(image_id=999)
    first = e.cached_search(image_id=0)
    assert e.cached_search(image_id=0) == first == e.cached_search(image_id=1)  # the same hash, then one two bits away
    e.cached_search(embedding=v[3])
    assert e.warm_cache([5, 6, 999]) == [999]
    s = e.cache_stats()
    assert (s["exact_hits"], s["approximate_hits"], s["cache_bypasses"], s["cache_misses"], s["total_queries"]) == (1, 1, 1, 3, 6) and s["hit_rate_pct"] == 33.33
    assert e.search_stats().first()["n"] == len(e.log)


def test_no_candidate_is_left_out(spark):
    """One hot bucket of more rows than the cap of other searches, where the best have the largest ids."""
    near = [[1.0 + 0.05 * (59 - i), 1.0] for i in range(60)]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(near)], "image_id long, embedding array<double>")
    e = engine.Engine(spark, rows, LSHConfig(num_tables=2, hash_size=1, embedding_dim=2, top_k=3, max_candidates=10))
    assert [i for i, _ in e.search(embedding=[1.0, 1.0])] == [59, 58, 57]


def test_insert_is_seen_and_all_or_nothing(spark, built):
    e, v = built
    new = spark.createDataFrame([(100, v[9].tolist(), 0)], "image_id long, embedding array<double>, line long")
    e.cached_search(image_id=9)
    e.insert(new)
    assert {i for i, s in e.cached_search(image_id=9) if s == 1.0} == {9, 100}
    with pytest.raises(ValueError):
        e.insert(new)


def test_small_helpers(spark, built):
    e, _ = built
    assert engine.same_results(e.rows, e.rows) and not engine.same_results(e.rows, e.rows.limit(3))
    ids = spark.createDataFrame([(0,), (555,)], "image_id long")
    assert [any(r["embedding"]) for r in engine.with_defaults(ids, e.rows, 8).orderBy("image_id").collect()] == [True, False]
    truth = spark.createDataFrame([(i, 1) for i in range(12)], "query_id long, relevant_id long")
    assert engine.benchmark_queries(e.rows, truth, 5).filter("image_id < 12").count() == 5
    d = spark.createDataFrame([(0, 0, 0, [0.0]), (1, 2, 3, [1.0])], "ahash long, dhash long, phash long, hist array<double>")
    assert engine.failure_rates(d).first()["warning"]
