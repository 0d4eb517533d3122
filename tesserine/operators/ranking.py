"""Re-ranking and exact search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserine.config import HASH_LIMIT, WEIGHTS
from tesserine.functions import hashes, vectors
from tesserine.operators import lsh
from tesserine.operators.lsh import matrix

#: Query vectors that are broadcast at once.
QUERY_BLOCK = 2048
#: Products of queries and rows that are held at once, and pairs that are scored at once.
PAIRS, SLICE = 1 << 21, 1 << 16
#: Half of the last place of a score, and what products may differ from a cosine.
HALF, SLACK = 5e-7, 1e-9


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    na, nb = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
    ok = (na >= vectors.TINY) & (nb >= vectors.TINY)
    return np.where(ok, (a * b).sum(1) / np.where(ok, na * nb, 1.0), 0.0)


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            score = np.round(_cosine(matrix(batch.column(2)), matrix(batch.column(3))), 6) + 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], ["query_id", "image_id", "score"])


def scored(pairs: DataFrame, queries: DataFrame, rows: DataFrame) -> DataFrame:
    """(query_id, image_id, score), the cosine to six places, for batches of pairs."""
    q = queries.select(F.col("image_id").alias("query_id"), F.col("embedding").alias("q"))
    full = pairs.join(rows.select("image_id", "embedding"), "image_id").join(q, "query_id").select("query_id", "image_id", "q", "embedding")
    return full.mapInArrow(_scored, "query_id long, image_id long, score double")


def top(scores: DataFrame, k: int) -> DataFrame:
    """The k best of each query, ties by id; Spark keeps k rows of a query in each task before the shuffle."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "image_id")
    return scores.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "image_id", "score")


def nearest(spark: SparkSession, queries: DataFrame, rows: DataFrame, k: int, exclude_self: bool = True) -> DataFrame:
    """Exact search of a stated query set against all rows. Queries are broadcast in blocks; each batch of rows keeps its k best."""
    return top(_by_blocks(spark, queries, rows, lambda sent: _best(sent, k, exclude_self), "query_id long, image_id long, score double"), k)


def _by_blocks(spark: SparkSession, queries: DataFrame, rows: DataFrame, run, schema: str) -> DataFrame:
    """run(broadcast ids and vectors of a block of queries) over batches of all rows, for each block."""
    n = queries.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    found = None
    for b in range(blocks):
        block = sorted((r["image_id"], r["embedding"]) for r in queries.filter(F.expr(f"pmod(xxhash64(image_id), {blocks}) = {b}")).collect())
        sent = spark.sparkContext.broadcast((np.array([x[0] for x in block], np.int64), np.array([x[1] for x in block], float)))
        part = rows.select("image_id", "embedding").mapInArrow(run(sent), schema)
        found = part if found is None else found.union(part)
    return found


def by_configuration(spark: SparkSession, queries: DataFrame, rows: DataFrame, grid: list[tuple[int, int]], dim: int, k: int, seed: int = 42) -> DataFrame:
    """(num_tables, hash_size, query_id, image_id, score, n) of the candidates of a stated query set in each configuration of an index.

    Parts of the k best, each with its score, and of the number of candidates, n, which are summed. Blocks of queries go to all
    rows; which tables a pair shares is read off the keys of both, so no pair and no posting is shuffled.
    """
    planes = {bits: lsh.projections(max(t for t, h in grid if h == bits), bits, dim, seed) for bits in sorted({h for _, h in grid})}
    schema = "num_tables int, hash_size int, query_id long, image_id long, score double, n long"
    return _by_blocks(spark, queries, rows, lambda sent: _in_grid(sent, grid, planes, k), schema)


def _in_grid(sent, grid: list[tuple[int, int]], planes: dict[int, np.ndarray], k: int):
    def codes(v: np.ndarray, bits: int) -> np.ndarray:
        """A row of numbers a table; keys of up to 63 bits."""
        p = planes[bits]
        signs = (v @ p.reshape(-1, p.shape[2]).astype(np.float64).T >= 0).reshape(len(v), p.shape[0], bits)
        kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.int64) if bits <= 8 * np.dtype(t).itemsize)
        return np.ascontiguousarray((signs @ (1 << np.arange(bits, dtype=np.int64))).astype(kind).T)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = sent.value
        if not len(ids):
            return
        best, n, mine = {c: Best(ids, q, k) for c in grid}, {c: np.zeros(len(ids), np.int64) for c in grid}, {bits: codes(q, bits) for bits in planes}
        unit, step = _unit(q), max(1, PAIRS // len(ids))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                some = batch.slice(at, step)
                own, e = some.column(0).to_numpy(zero_copy_only=False), matrix(some.column(1))
                near, others = unit @ _unit(e).T, ids[:, None] != own[None, :]
                for bits in planes:
                    theirs, shared = codes(e, bits), np.zeros(near.shape, bool)
                    for t in range(len(theirs)):
                        shared |= mine[bits][t][:, None] == theirs[t][None, :]
                        if (c := (t + 1, bits)) in best:
                            allowed = shared & others
                            n[c] += allowed.sum(1)
                            best[c].add(own, e, near, allowed)
        for tables, bits in grid:
            asked, own, score = best[tables, bits].found()
            none = len(asked)
            column = [np.concatenate([asked, ids]), pa.array([*own.tolist(), *[None] * len(ids)], pa.int64()), pa.array([*score.tolist(), *[None] * len(ids)], pa.float64()), pa.array([*[None] * none, *n[tables, bits].tolist()], pa.int64())]
            one = lambda x: pa.array(np.full(none + len(ids), x, np.int32))
            yield pa.RecordBatch.from_arrays([one(tables), one(bits), pa.array(column[0], pa.int64()), *column[1:]], ["num_tables", "hash_size", "query_id", "image_id", "score", "n"])

    return run


def _best(sent, k: int, exclude_self: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = sent.value
        if not len(ids):
            return
        best = Best(ids, q, k)
        for batch in batches:
            if batch.num_rows:
                best.see(batch.column(0).to_numpy(zero_copy_only=False), matrix(batch.column(1)), exclude_self)
        yield from best.rows()

    return run


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.sqrt((v * v).sum(1))[:, None]
    return np.where(n >= vectors.TINY, v / np.where(n >= vectors.TINY, n, 1.0), 0.0)


class Best:
    """The k best rows of each query, ties by id, over blocks of rows; holds k rows a query and PAIRS products.

    A matrix product of unit vectors tells which rows may be among the k; only those get the cosine by which they are ranked.
    """

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int) -> None:
        self.ids, self.q, self.k, self.unit = ids, q, k, _unit(q)
        self.score, self.own = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
        self.newest = np.iinfo(np.int64).min

    def see(self, own: np.ndarray, e: np.ndarray, exclude_self: bool) -> None:
        step = max(1, PAIRS // len(self.ids))
        for at in range(0, len(own), step):
            some, rows = own[at : at + step], e[at : at + step]
            near = self.unit @ _unit(rows).T
            if exclude_self:
                near[self.ids[:, None] == some[None, :]] = -np.inf
            self.add(some, rows, near)

    def add(self, own: np.ndarray, e: np.ndarray, near: np.ndarray, allowed: np.ndarray | None = None) -> None:
        """A block of rows and its products with the queries; only ``allowed`` pairs count, and none of -inf."""
        edge, m = self.score[:, -1], len(own)
        bar = edge + (HALF if own.min() > self.newest else -HALF) - SLACK  # a tie with the last one held only helps a smaller id
        self.newest = max(self.newest, int(own.max()))
        unfilled = np.flatnonzero(np.isneginf(edge)) if m > self.k else ()
        if len(unfilled) and allowed is not None:
            unfilled = unfilled[allowed[unfilled].sum(1) > self.k]
        if len(unfilled):
            of = near[unfilled] if allowed is None else np.where(allowed[unfilled], near[unfilled], -np.inf)
            bar[unfilled] = np.partition(of, m - self.k, axis=1)[:, m - self.k] - 2 * HALF - SLACK
        chosen = near >= np.maximum(bar, -2.0)[:, None]
        i, j = np.nonzero(chosen if allowed is None else chosen & allowed)
        if not len(i):
            return
        score = np.concatenate([np.round(_cosine(self.q[i[a : a + SLICE]], e[j[a : a + SLICE]]), 6) + 0.0 for a in range(0, len(i), SLICE)])
        touched = np.unique(i)
        of = np.concatenate([np.repeat(touched, self.k), i])
        score, own = np.concatenate([self.score[touched].ravel(), score]), np.concatenate([self.own[touched].ravel(), own[j]])
        order = np.lexsort((own, -score, of))
        starts = np.searchsorted(of[order], touched)
        keep = order[(starts[:, None] + np.arange(self.k)).ravel()]
        self.score[touched], self.own[touched] = score[keep].reshape(-1, self.k), own[keep].reshape(-1, self.k)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        real = np.isfinite(self.score)
        return np.repeat(self.ids, real.sum(1)), self.own[real], self.score[real]

    def rows(self) -> Iterator[pa.RecordBatch]:
        q, own, score = self.found()
        for a in range(0, len(q), SLICE):
            yield _batch(q[a : a + SLICE], own[a : a + SLICE], score[a : a + SLICE])


def _batch(q: np.ndarray, own: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(own, pa.int64()), pa.array(score, pa.float64())], ["query_id", "image_id", "score"])


def in_buckets(queries: DataFrame, rows: DataFrame, k: int, tables: int, bits: int, dim: int, seed: int = 42, exclude_self: bool = True) -> DataFrame:
    """W1, W2, W4 for query sets of any size: (query_id, rank, image_id, score), the k best of all candidates of each query.

    No pair leaves the task that makes it. The vectors of a bucket meet in one place, about lsh.PART queries with all rows in
    the order of their ids, and each query keeps its k best there; the best of all its buckets are among those.
    """
    hot = lsh.parts(lsh.postings(queries, tables, bits, dim, seed))
    q, r = lsh.dealt(lsh.postings_with_vectors(queries, tables, bits, dim, seed), lsh.postings_with_vectors(rows, tables, bits, dim, seed), hot)
    columns, cell = ["image_id", "embedding", "table_id", "bucket_key", "part"], ["table_id", "bucket_key", "part"]
    both = q.select(*columns, F.lit(0).alias("side")).union(r.select(*columns, F.lit(1)))
    met = both.repartition(*cell).sortWithinPartitions(*cell, "side", "image_id").mapInArrow(_in_cells(k, exclude_self), "query_id long, image_id long, score double")
    return top(met.repartition("query_id").groupBy("query_id", "image_id").agg(F.max("score").alias("score")), k)


def _in_cells(k: int, exclude_self: bool):
    """Sorted rows (image_id, embedding, table_id, bucket_key, part, side): of each cell first its queries, then its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, asked, best, out, held = None, [], None, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            own, e, side = batch.column(0).to_numpy(zero_copy_only=False), matrix(batch.column(1)), batch.column(5).to_numpy()
            keys = batch.column(3).dictionary_encode()
            marks = np.stack([batch.column(2).to_numpy(), keys.indices.to_numpy(), batch.column(4).to_numpy(), side])
            starts = np.concatenate([[0], np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(0)) + 1, [batch.num_rows]])
            for a, b in zip(starts[:-1], starts[1:]):
                now = (marks[0, a], keys.dictionary[int(marks[1, a])].as_py(), marks[2, a])
                if now != cell:
                    if best is not None:
                        out.append(best.found())
                        held += len(out[-1][0])
                    cell, asked, best = now, [], None
                    if held >= SLICE:
                        yield _batch(*map(np.concatenate, zip(*out)))
                        out, held = [], 0
                if not side[a]:
                    asked.append((own[a:b], e[a:b]))
                elif asked:
                    best = best or Best(*map(np.concatenate, zip(*asked)), k)
                    best.see(own[a:b], e[a:b], exclude_self)
        if best is not None:
            out.append(best.found())
        if out:
            yield _batch(*map(np.concatenate, zip(*out)))

    return run


def fused(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """(query_id, image_id, mean_hamming, score). Pairs too far apart in hashes score 0 before any vector is looked at."""
    columns = ["embedding", "ahash", "dhash", "phash", "sift", "orb", "hist"]
    a = features.select(F.col("image_id").alias("query_id"), F.struct(*columns).alias("a"))
    b = features.select("image_id", F.struct(*columns).alias("b"))
    both = pairs.select("query_id", "image_id").join(a, "query_id").join(b, "image_id")
    x, y = F.col("a"), F.col("b")
    far = hashes.mean_hamming(x, y)
    w = WEIGHTS
    score = (
        w["cnn"] * vectors.cosine(x["embedding"], y["embedding"])
        + w["hash"] * (1 - F.col("mean_hamming") / F.lit(64.0))
        + w["sift"] * vectors.cosine(x["sift"], y["sift"])
        + w["orb"] * vectors.cosine(x["orb"], y["orb"])
        + w["hist"] * vectors.histogram_intersection(x["hist"], y["hist"])
    )
    out = both.withColumn("mean_hamming", far).withColumn("score", F.when(F.col("mean_hamming") > HASH_LIMIT, F.lit(0.0)).otherwise(F.round(score, 6)))
    return out.select("query_id", "image_id", F.round("mean_hamming", 6).alias("mean_hamming"), "score")
