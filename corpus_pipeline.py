"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``docs``. run() writes each stage's result to the shared
folder as Parquet and reads it again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.llm import decontamination, near_duplicates, packing, personal_data, quality_rules, shared


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules reject go; null, blank and short texts (under 50 words) are among them. Rows are judged one by one."""
    return quality_rules.kept(spark, docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, 0.8) the document with the smallest doc_id stays.

    Rows that share a doc_id but not a text are documents of their own; equal rows stay or go together, and so do rows without a doc_id or words, which stay."""
    return _without(docs, near_duplicates.near_duplicates(spark, docs, shingle=5, similarity=80, apart=True).filter("not kept"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go, verbatim or edited; null and blank texts stay, and so do all if the benchmark is empty. A null doc_id goes by its text."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, decontamination.contaminated(spark, docs, benchmark))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` but for the rows with a doc_id and text (by its hash) in ``gone``."""
    keys = gone.select(F.col("doc_id").alias("__gone_id"), F.col("content").alias("__gone_text")).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__gone_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__gone_text"))
    return docs.join(keys, same, "left_anti").select(*[f"`{c}`" for c in docs.columns])


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; a null text stays null. All rows stay."""
    return personal_data.redacted(spark, docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens in sequences of 4096: a row for each piece of a document. A null or blank text is the end id alone; repeated rows are packed each."""
    return packing.packed(spark, docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("pii", redact), ("packing", pack)]

#: The stages compare sketches, align and train, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = shared.cut(spark, stage(spark, docs, sf_dir))
    return docs
