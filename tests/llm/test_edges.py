"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, through every operator and stage."""

import hashlib
import os
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tesserine.llm import class_lm, decontamination, near_duplicates, packing, personal_data, quality_classifier, quality_rules, resharding, secrets, shared, substrings

CLASHING = ["t", "words", "base", "wide", "found", "k", "rank", "salt", "shard", "block", "size", "content", "features", "quality", "kept", "spans", "id", "band", "h", "n", "__row", "__t"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
LONG = " ".join(f"word{i % 997}" for i in range(60_000))
PROSE = " ".join(f"plain{i % 83}x{i % 7} word{i}" for i in range(120))


@pytest.fixture(scope="module")
def odd(spark):
    texts = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "one"), (5, "x" * 300_000), (6, LONG), (7, PROSE), (7, PROSE), (8, PROSE), (None, PROSE), (None, None), (9, "a\x00b ퟿ é 日本 \U0001f600"), (10, "tie tie tie"), (11, "tie tie tie"), (12, "1" * 5000 + " " + "+1(" * 2000 + "@" * 500 + "%41" * 500 + "A" * 3000)]
    return spark.createDataFrame([(i, t, None, None, None, *["clash"] * len(CLASHING)) for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def none(odd):
    return odd.filter("false")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, "two words"), (4, PROSE[:300]), (None, "item without an id at all")], "item_id long, text string")


def test_near_duplicates(spark, odd, none):
    rows = near_duplicates.near_duplicates(spark, odd).collect()
    assert len(rows) == odd.count()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows if r["doc_id"] is not None}
    assert got[1] == (0, 1, True) and got[3] == (0, 3, True) and got[4] == (1, 4, True)
    assert got[7][1:] == (7, True) and got[8][1:] == (7, False) and got[11][1:] == (10, False)
    assert all(r["kept"] and r["component_id"] is None for r in rows if r["doc_id"] is None)
    assert near_duplicates.near_duplicates(spark, none).count() == 0


def test_substrings(spark, odd, none):
    rows = substrings.remove_repeats(spark, odd, 50).collect()
    assert len(rows) == odd.count()
    n = len(PROSE.split())
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append((r["n_words"], r["n_removed"]))
    assert got[1] == [(0, 0)] and got[7] == [(n, 0)] * 2 and got[8] == [(n, n)] and sorted(got[None]) == [(0, 0), (n, 0)]
    assert substrings.remove_repeats(spark, none, 50).count() == 0


def test_secrets(spark, odd, none):
    rows = secrets.secret_spans(odd).collect()
    assert len(rows) == odd.count() and all(r["base_sha256"] == hashlib.sha256(b"").hexdigest() for r in rows if r["doc_id"] in (1, 2, 3, 4))
    assert secrets.secret_spans(none).count() == 0


def test_language_model(spark, odd, none):
    rows = class_lm.scored(spark, odd).collect()
    assert len(rows) == odd.count() and all(r["score"] is not None and r["score"] == r["score"] for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1}
    assert class_lm.scored(spark, none).count() == 0
    held = class_lm.scored(spark, odd.filter(class_lm.held_out())).collect()
    assert held and all((r["n_known"], r["train_tokens"], r["score"]) == (0, 0, 0.0) for r in held)


def test_packing(spark, odd, none):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.packed(spark, odd, path).collect()
    assert sum(r["piece"] == 0 for r in rows) == odd.count()
    assert all(r["length"] == 1 for r in rows if r["doc_id"] in (1, 2, 3))
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows)
    assert all(b[1] == (a[1] + a[2] if a[0] == b[0] else 0) for a, b in zip(places, places[1:]))
    assert packing.packed(spark, none, path).count() == 0


def test_resharding(spark, odd, none):
    old = F.expr("pmod(crc32(cast(source as binary)), 4)")
    rows = resharding.resharded(spark, odd, old, 4, 3).collect()
    assert len(rows) == odd.count()
    for s in range(3):
        mine = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert mine == list(range(len(mine)))
    assert resharding.resharded(spark, none, old, 4, 3).count() == 0


def test_quality_rules(spark, odd, none):
    rows = quality_rules.judged(spark, odd).collect()
    assert len(rows) == odd.count() and all(r["base_failed"] and not r["kept"] for r in rows if r["doc_id"] in (1, 2, 3, 4, 10))
    assert all(r["kept"] for r in rows if r["doc_id"] in (7, 8))
    kept = quality_rules.kept(spark, odd)
    assert kept.columns == odd.columns and kept.filter("doc_id = 7").count() == 2
    assert quality_rules.judged(spark, none).count() == 0


def test_quality_classifier(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 13)] + [(None, 1, 0), (4, None, None), (4, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality_classifier.scored(spark, odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert quality_classifier.scored(spark, none, labels.filter("false")).count() == 0
    assert {round(r["score"], 9) for r in quality_classifier.scored(spark, odd, labels.filter("false")).collect()} == {0.5}


def test_personal_data(spark, odd, none):
    assert personal_data.personal_spans(spark, odd).count() == odd.count()
    out = personal_data.redacted(spark, odd)
    assert out.columns == odd.columns and out.count() == odd.count() and out.filter("doc_id = 1 and text is null").count() == 1
    assert personal_data.personal_spans(spark, none).count() == 0


def test_decontamination(spark, odd, none, benchmark):
    rows = decontamination.contaminated(spark, odd, benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == {(7, 4), (8, 4), (None, 4)}
    assert decontamination.contaminated(spark, none, benchmark).count() == 0
    assert decontamination.contaminated(spark, odd, benchmark.filter("false")).count() == 0


def test_stages(spark, odd, none, benchmark, tmp_path):
    folder = f"file://{tmp_path}"
    benchmark.write.parquet(f"{folder}/benchmark.parquet")
    for docs in (odd, none):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, folder)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert docs.columns == odd.columns
        assert "sequence_id" in docs.columns
        docs.collect()


def test_pipeline_keeps_clean_rows_and_drops_the_rest(spark):
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("needs the test tables")
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    judged = {r["doc_id"] for r in quality_rules.judged(spark, docs).filter("kept").collect()}
    rest = docs.filter(F.col("doc_id").isin(sorted(judged)))
    single = {r["doc_id"] for r in near_duplicates.near_duplicates(spark, rest, shingle=5).filter("kept").collect()}
    leaks = {r["doc_id"] for r in decontamination.contaminated(spark, rest, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert got == single - leaks


def test_cut_gives_freed_native_memory_back(spark):
    """Deflaters keep their state in native memory; the blocks of those that ended lie below one that is still there."""
    if not shared.trim(spark):
        pytest.skip("the JVM can't trim its native heap")
    jvm = spark.sparkContext._jvm
    smaps = f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/smaps_rollup"

    def resident():
        with open(smaps) as f:
            return int(re.search(r"\nRss:\s+(\d+)", f.read())[1]) / 1024

    shared.cut(spark, spark.range(10))
    made = [jvm.java.util.zip.Deflater() for _ in range(1500)]
    for x in made[:-1]:
        x.end()
    before = resident()
    shared.cut(spark, spark.range(10))
    assert resident() < before - 60
    made[-1].end()
