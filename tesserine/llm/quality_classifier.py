"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of 64 words. Every passage of the whole text is
encoded: shares of kinds of characters and words, through a learned layer. Gated
attention (tanh and sigmoid branches) weighs the passages of a document, and the
weighted sum is scored. Everything is learned from document labels alone, by Adam on
a bounded sample of labelled rows: the SAMPLE ones with the smallest hash of
their doc_id. All rows are scored, whole.

Edge cases: a null or blank text is one passage without words and is scored too.
A null doc_id has no label and counts as the empty text for the split. Repeated
rows are scored each; repeated labels count once, the higher one. Labels of null
are left out; without labels, or with one kind only, the score is the share of
label 1, or 0.5. Only doc_id and text are inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.llm import shared
from tesserine.llm.words import U, mix, row_of, words

PASSAGE, SAMPLE, HIDDEN, ATTENTION, STEPS, RATE, DECAY = 64, 3000, 16, 8, 250, 0.02, 1e-4
_KINDS = {"upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": "0123456789", "shout": "!", "symbol": "#*$%&|<>", "other": "\"'()+,-./:;=?@[]^_`{}~\\"}
FEATURES = 15


def held_out() -> Column:
    """Rows whose labels aren't learned from."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def encode(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of each passage of each row of text, and where each row's passages begin."""
    w = words(data, offsets)
    n = np.diff(w.rows)
    count = np.maximum(1, -(-n // PASSAGE))
    starts = np.concatenate([[0], np.cumsum(count)])
    total = int(starts[-1])
    row = row_of(w.rows)
    place = starts[row] + (np.arange(len(row)) - w.rows[row]) // PASSAGE
    out = np.zeros((total, FEATURES))
    if not len(row):
        return out, starts

    def summed(x: np.ndarray) -> np.ndarray:
        return np.bincount(place, weights=x, minlength=total)

    def per_word(chosen: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(chosen[data])])
        return c[w.ends] - c[w.starts]

    size = w.ends - w.starts
    m, chars = np.maximum(1, summed(np.ones(len(row)))), np.maximum(1, summed(size))
    by = {}
    for kind, letters in _KINDS.items():
        chosen = np.zeros(256, np.int64)
        chosen[[ord(c) for c in letters]] = 1
        by[kind] = per_word(chosen)
    high = np.zeros(256, np.int64)
    high[128:] = 1
    _, first = np.unique(mix(w.hashes + place.astype(np.uint64) * U(0x9E3779B97F4A7C15)), return_index=True)
    again = np.zeros(len(row))
    again[1:] = (w.hashes[1:] == w.hashes[:-1]) & (place[1:] == place[:-1])
    new = np.zeros(len(row))
    new[first] = 1
    values = [summed(by["upper"]) / chars, summed(by["digit"]) / chars, summed(by["shout"]) / m, summed(by["symbol"]) / m, summed(by["other"]) / m, summed(per_word(high)) / chars, chars / m / 10, summed(new) / m]
    values += [summed(again) / m, summed(size <= 3) / m, summed(size >= 14) / m, summed(by["symbol"] > 0) / m, summed(by["upper"] >= 2) / m, summed(by["shout"] > 0) / m, np.log(m) / 4]
    return np.stack(values, axis=1), starts


class Model(NamedTuple):
    shift: np.ndarray
    scale: np.ndarray
    weights: dict


def _forward(w: dict, f: np.ndarray, starts: np.ndarray) -> dict:
    doc = row_of(starts)
    h = np.tanh(f @ w["W"] + w["b"])
    a, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
    s = (a * g) @ w["w"]
    e = np.exp(s - np.maximum.reduceat(s, starts[:-1])[doc])
    alpha = e / np.add.reduceat(e, starts[:-1])[doc]
    z = np.add.reduceat(alpha[:, None] * h, starts[:-1])
    p = 1 / (1 + np.exp(-np.clip(z @ w["u"] + w["c"], -30, 30)))
    return {"doc": doc, "h": h, "a": a, "g": g, "alpha": alpha, "z": z, "p": p}


def fit(features: np.ndarray, starts: np.ndarray, labels: np.ndarray) -> Model:
    """Gated attention and classifier learned together, full batch, with a fixed seed."""
    if not len(labels) or labels.min() == labels.max():
        rate = (labels.sum() + 1) / (len(labels) + 2)
        rng_shapes = {"W": (FEATURES, HIDDEN), "b": HIDDEN, "V": (HIDDEN, ATTENTION), "U": (HIDDEN, ATTENTION), "w": ATTENTION, "u": HIDDEN}
        return Model(np.zeros(FEATURES), np.ones(FEATURES), {k: np.zeros(v) for k, v in rng_shapes.items()} | {"c": np.log(rate / (1 - rate))})
    shift, scale = features.mean(0), features.std(0) + 1e-6
    f = (features - shift) / scale
    rng = np.random.default_rng(7)
    w = {"W": rng.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)), "U": rng.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)), "w": rng.normal(0, ATTENTION**-0.5, ATTENTION), "u": rng.normal(0, HIDDEN**-0.5, HIDDEN), "c": np.zeros(())}
    one, two = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
    for step in range(1, STEPS + 1):
        r = _forward(w, f, starts)
        doc, h, a, g, alpha = r["doc"], r["h"], r["a"], r["g"], r["alpha"]
        d = (r["p"] - labels) / len(labels)
        dz = d[:, None] * w["u"]
        dalpha = (dz[doc] * h).sum(1)
        ds = alpha * (dalpha - np.add.reduceat(alpha * dalpha, starts[:-1])[doc])
        branch = ds[:, None] * w["w"]
        da, dg = branch * g * (1 - a * a), branch * a * g * (1 - g)
        dh = (alpha[:, None] * dz[doc] + da @ w["V"].T + dg @ w["U"].T) * (1 - h * h)
        grads = {"W": f.T @ dh, "b": dh.sum(0), "V": h.T @ da, "U": h.T @ dg, "w": (a * g).T @ ds, "u": r["z"].T @ d, "c": d.sum()}
        for k in w:
            gradient = grads[k] + DECAY * w[k]
            one[k] = 0.9 * one[k] + 0.1 * gradient
            two[k] = 0.999 * two[k] + 0.001 * gradient**2
            w[k] = w[k] - RATE * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.999**step)) + 1e-8)
    return Model(shift, scale, w)


def score(model: Model, features: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the score, and of each passage its attention."""
    r = _forward(model.weights, (features - model.shift) / model.scale, starts)
    return r["p"], r["alpha"]


def _steps(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        data, offsets = shared.text_buffers(batch.column(column))
        for low, high in shared.steps(offsets):
            at = offsets[low : high + 1]
            yield batch.slice(low, high - low), *encode(data[at[0] : at[-1]], at - at[0])


def _encoded(batches):
    for batch, features, starts in _steps(batches, 1):
        values = features.astype(np.float32)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([values[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:])], pa.binary())], ["doc_id", "quality", "features"])


def _scored(model):
    def run(batches):
        for batch, features, starts in _steps(batches, 1):
            p, alpha = score(model.value, features, starts)
            top = [int(np.argmax(alpha[a:b])) * PASSAGE for a, b in zip(starts[:-1], starts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(np.diff(starts), pa.int64()), pa.array(top, pa.int64())], ["doc_id", "score", "n_passages", "top_word"])

    return run


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    chosen = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("double").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    found = sorted((r["doc_id"], r["quality"], bytes(r["features"])) for r in rows.select("doc_id", "text", "quality").mapInArrow(_encoded, "doc_id long, quality double, features binary").collect())
    bags = [np.frombuffer(x[2], np.float32).reshape(-1, FEATURES).astype(float) for x in found]
    starts = np.concatenate([[0], np.cumsum([len(b) for b in bags])]).astype(np.int64)
    return fit(np.concatenate(bags) if bags else np.zeros((0, FEATURES)), starts, np.array([x[1] for x in found], float))


def scored(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_passages, top_word) for each row; top_word: where the passage with most attention begins."""
    model = spark.sparkContext.broadcast(train(spark, docs, labels, sample))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(_scored(model), "doc_id long, score double, n_passages long, top_word long")
    return out.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "n_passages", "top_word")
