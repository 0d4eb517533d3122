"""Half-precision storage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.functions import vectors
from tesserine.operators.lsh import matrix


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        halves = matrix(batch.column(1)).astype(np.float32).astype("<f2")
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h.tobytes() for h in halves], pa.binary())], ["image_id", "code"])


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [np.frombuffer(c.as_buffer(), "<f2").astype(np.float64).tolist() for c in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.list_(pa.float64()))], ["image_id", "embedding"])


def encode(rows: DataFrame) -> DataFrame:
    """V5: (image_id, code), two bytes a value."""
    return rows.select("image_id", "embedding").mapInArrow(_encode, "image_id long, code binary")


def decode(codes: DataFrame) -> DataFrame:
    """V6."""
    return codes.select("image_id", "code").mapInArrow(_decode, "image_id long, embedding array<double>")


def rounded(rows: DataFrame) -> DataFrame:
    """V5 and V6 as expressions: (image_id, embedding, half)."""
    return rows.select("image_id", "embedding", F.transform("embedding", vectors.half_precision).alias("half"))


def error(rows: DataFrame) -> DataFrame:
    """L2 and cosine error of the round trip."""
    both = rounded(rows)
    l2 = F.sqrt(F.aggregate(F.zip_with("embedding", "half", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    cos = F.abs(1 - vectors.cosine(F.col("embedding"), F.col("half")))
    each = both.select(l2.alias("l2"), cos.alias("cos"))
    return each.agg(F.count("*").alias("n"), F.round(F.avg("l2"), 8).alias("mean_l2"), F.round(F.max("l2"), 8).alias("max_l2"), F.round(F.expr("percentile(l2, 0.99D)"), 8).alias("p99_l2"), F.round(F.avg("cos"), 8).alias("mean_cosine_error"))


def similarity(pairs: DataFrame) -> DataFrame:
    """(a_id, b_id, half, error): the cosine of two vectors as stored in half precision, and how far it is from that of the vectors (a, b)."""
    half = lambda c: F.transform(c, vectors.half_precision)
    stored, true = vectors.cosine(half(F.col("a")), half(F.col("b"))), vectors.cosine(F.col("a"), F.col("b"))
    return pairs.select("a_id", "b_id", F.round(stored, 6).alias("half"), F.round(F.abs(stored - true), 6).alias("error"))
