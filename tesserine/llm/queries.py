"""The operators of this subpackage as queries over a folder of tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.llm import class_lm, decontamination, packing, personal_data, quality_classifier, quality_rules, resharding, shared
from tesserine.llm.near_duplicates import near_duplicates
from tesserine.llm.secrets import secret_spans
from tesserine.llm.substrings import remove_repeats


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(spark, shared.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark, shared.documents(spark, sf_dir), length=50, digest=True)


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, shared.documents(spark, sf_dir), shingle=4, similarity=80)


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(shared.documents(spark, sf_dir))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.scored(spark, shared.documents(spark, sf_dir))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.packed(spark, shared.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the old layout: 32 shards by source, of very unequal sizes
    old = F.expr("pmod(crc32(cast(coalesce(source, '') as binary)), 32)")
    placed = resharding.resharded(spark, shared.documents(spark, sf_dir), old, olds=32, news=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judged(spark, shared.documents(spark, sf_dir))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.scored(spark, shared.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = personal_data.personal_spans(spark, shared.documents(spark, sf_dir))
    kinds = personal_data.KINDS[: personal_data.BASE]
    return spans.select(
        "doc_id",
        *[F.expr(f"cast(size(filter(base, x -> x.kind = {k})) as long)").alias(f"n_{kind}") for k, kind in enumerate(kinds)],
        F.expr(f"sha2({personal_data.joined('base')}, 256)").alias("base_sha256"),
        F.expr(personal_data.joined("found")).alias("spans"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_benchmark_decontamination": op1_benchmark_decontamination,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_secret_scans": op3_secret_scans,
        "op4_lm_scoring": op4_lm_scoring,
        "op5_best_fit_packing": op5_best_fit_packing,
        "op6_sharding": op6_sharding,
        "op7_quality_rules": op7_quality_rules,
        "op8_quality_classifier": op8_quality_classifier,
        "op9_pii": op9_pii,
        "op10_minhash_near_dedup": op10_minhash_near_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_quality_rules": quality_rules.sql()}
