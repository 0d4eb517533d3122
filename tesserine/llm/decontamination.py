"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters and digits, A-Z as a-z. Seeds are the 4-word grams of
the test items (an item with fewer words is one seed). Every seed joins passages to
items, however frequent it is: a copy in thousands of documents leaves only frequent
seeds. A passage that a common phrase brings is left out when a bound on its score,
from the words that the two have in common, is below the threshold; hits of an
item that lie near each other are one passage, which Smith-Waterman aligns with
the item (match 2, mismatch -1, gap -1). The score is the share of the best
possible one, so copies with words changed, left out or put in are found; from
THRESHOLD on a document counts as contaminated.

The benchmark is taken in blocks of a bounded number of words, each broadcast;
the corpus is read for each block, so neither side has to fit in memory.

Edge cases: null and blank texts hold nothing and null item texts are no items; an
empty benchmark finds nothing. Repeated rows and repeated items are compared each
and reported by their ids; a null doc_id is reported as null. Extra columns are
not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.llm import shared
from tesserine.llm.words import PUNCTUATION, TERMS, U, grams, mix, row_of, words

SEED_WORDS, THRESHOLD = 4, 0.5
MATCH, MISMATCH, GAP = 2, -1, 1
#: Words of a block of items, on average.
BLOCK_WORDS = 2_000_000
_TABLE = 1 << 22


class Items(NamedTuple):
    ids: list
    words: list  #: of each item, hashes
    seeds: np.ndarray  #: sorted and distinct
    begin: np.ndarray  #: where the places of each seed begin
    item: np.ndarray  #: of each place of a seed
    at: np.ndarray  #: and the word
    table: np.ndarray  #: which low bits of a hash some seed has


def prepare(items: list[tuple]) -> Items:
    """Items (id, text) with their seeds."""
    texts = pa.array([t for _, t in items], pa.string())
    data, offsets = shared.text_buffers(texts)
    w = words(data, offsets, lower=True, breaks=PUNCTUATION)
    keys, at = grams(w.hashes, w.rows, SEED_WORDS)
    row = row_of(w.rows)[at]
    n = np.diff(w.rows)
    short = np.flatnonzero((n > 0) & (n < SEED_WORDS))
    keys, row, at = np.concatenate([keys, _whole(w.hashes, w.rows, short)]), np.concatenate([row, short]), np.concatenate([at - w.rows[row], np.zeros(len(short), np.int64)])
    order = np.lexsort((at, row, keys))
    keys, row, at = keys[order], row[order], at[order]
    seeds, begin = np.unique(keys, return_index=True)
    table = np.zeros(_TABLE, bool)
    table[(seeds & U(_TABLE - 1)).astype(np.int64)] = True
    return Items([i for i, _ in items], [w.hashes[a:b] for a, b in zip(w.rows[:-1], w.rows[1:])], seeds, np.append(begin, len(keys)), row, at, table)


def _whole(hashes: np.ndarray, rows: np.ndarray, short: np.ndarray) -> np.ndarray:
    out = np.zeros(len(short), np.uint64)
    for k in range(SEED_WORDS - 1):
        has = rows[short] + k < rows[short + 1]
        out[has] += hashes[rows[short[has]] + k] * TERMS[48 + k]
    return mix(out)


def _hits(items: Items, hashes: np.ndarray, rows: np.ndarray, shortest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of words where a seed begins, and which."""
    found_at, found_seed = [], []
    kinds = [grams(hashes, rows, SEED_WORDS)]
    if shortest:  # items of one to three words, as whole sequences
        for n in range(1, SEED_WORDS):
            at = np.flatnonzero(np.arange(len(hashes)) + n <= np.repeat(rows[1:], np.diff(rows)))
            out = np.zeros(len(at), np.uint64)
            for k in range(n):
                out += hashes[at + k] * TERMS[48 + k]
            kinds.append((mix(out), at))
    for keys, at in kinds:
        likely = np.flatnonzero(items.table[(keys & U(_TABLE - 1)).astype(np.int64)])
        if len(likely):
            k = np.searchsorted(items.seeds, keys[likely])
            k[k == len(items.seeds)] = 0
            real = items.seeds[k] == keys[likely]
            found_at.append(at[likely[real]])
            found_seed.append(k[real])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found_at]), np.concatenate([none, *found_seed])


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int, int]:
    """Smith-Waterman over words: score, matching words, and the aligned stretch of the passage."""
    m, n = len(item), len(passage)
    ramp = np.arange(n + 1) * GAP
    table = np.zeros((m + 1, n + 1), np.int32)
    for i in range(m):
        same = np.where(passage == item[i], MATCH, MISMATCH)
        row = np.maximum(table[i] - GAP, 0)
        row[1:] = np.maximum(row[1:], table[i, :-1] + same)
        table[i + 1] = np.maximum.accumulate(row + ramp) - ramp  # gaps along the passage
    best = int(table.max())
    if not best:
        return 0, 0, 0, 0
    i, j = map(int, np.argwhere(table == best)[0])
    end, matches = j, 0
    while i and j and table[i, j]:
        hit = passage[j - 1] == item[i - 1]
        if table[i, j] == table[i - 1, j - 1] + (MATCH if hit else MISMATCH):
            matches += int(hit)
            i, j = i - 1, j - 1
        elif table[i, j] == table[i - 1, j] - GAP:
            i -= 1
        else:
            j -= 1
    return best, matches, j, end


def _steps(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        data, offsets = shared.text_buffers(batch.column(1))
        for low, high in shared.steps(offsets):
            at = offsets[low : high + 1]
            yield list(zip(batch.column(0).slice(low, high - low).to_pylist(), batch.column(2).slice(low, high - low).to_pylist())), words(data[at[0] : at[-1]], at - at[0], lower=True, breaks=PUNCTUATION)


def _bound(item: np.ndarray, passage: np.ndarray) -> int:
    """What no alignment of the two scores above: on either side, a word that the other lacks costs 1 and any other gives MATCH."""
    own = np.sort(item)
    at = np.searchsorted(own, passage)
    at[at == len(own)] = 0
    most = MATCH * len(item)
    for has in (own[at] == passage, np.isin(item, passage)):
        total = np.concatenate([[0], np.cumsum(np.where(has, MATCH, -1))])
        most = min(most, int((total - np.minimum.accumulate(total)).max()))
    return most


def _tiles(low: int, high: int, size: int, threshold: float) -> Iterator[tuple[int, int]]:
    """A long passage in pieces; every stretch that an alignment from ``threshold`` on can span lies within one."""
    span = int(np.ceil(size * (3 - MATCH * max(0.0, threshold))))
    while high - low > 8 * span:
        yield low, low + 4 * span
        low += 3 * span
    yield low, high


def _aligned(sent, threshold: float):
    def run(batches):
        items: Items = sent.value
        shortest = any(0 < len(w) < SEED_WORDS for w in items.words)
        sizes = np.array([len(x) for x in items.words], np.int64)
        for ids, w in _steps(batches):
            at, seed = _hits(items, w.hashes, w.rows, shortest)
            many = items.begin[seed + 1] - items.begin[seed]
            place = np.repeat(items.begin[seed] - np.concatenate([[0], np.cumsum(many)[:-1]]) if len(seed) else seed, many) + np.arange(many.sum())
            item, inner, at = items.item[place], items.at[place], np.repeat(at, many)
            row = row_of(w.rows)[at] if len(at) else at
            begins = at - inner
            order = np.lexsort((begins, item, row))
            row, item, begins = row[order], item[order], begins[order]
            # hits of one item in one text whose diagonals lie near each other
            size = sizes[item]
            far = (np.diff(row) != 0) | (np.diff(item) != 0) | (np.diff(begins) > size[1:])
            first = np.flatnonzero(np.concatenate([[len(row) > 0], far]))
            last = np.append(first[1:], len(row))[: len(first)] - 1
            lows = np.maximum(w.rows[row[first]], begins[first] - size[first] // 2)
            highs = np.minimum(w.rows[row[first] + 1], begins[last] + size[first] + size[first] // 2 + 1)
            out: dict[tuple[int, int], tuple] = {}
            for r, i, begin, end in zip(row[first].tolist(), item[first].tolist(), lows.tolist(), highs.tolist()):
                n = len(items.words[i])
                for low, high in _tiles(begin, end, n, threshold):
                    if _bound(items.words[i], w.hashes[low:high]) < threshold * MATCH * n:
                        continue
                    best, matches, start, stop = align(items.words[i], w.hashes[low:high])
                    score = best / (MATCH * n)
                    if score >= threshold and score > out.get((r, i), (0,))[0]:
                        out[r, i] = (score, matches, int(low + start - w.rows[r]), int(low + stop - w.rows[r]))
            found = [(ids[r][0], items.ids[i], len(items.words[i]), *v, ids[r][1]) for (r, i), v in sorted(out.items())]
            columns = list(zip(*found)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "item_id", "item_words", "score", "n_matches", "start_word", "end_word", "content"])

    return run


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, item_words, score, n_matches, start_word, end_word, content), content being the text's hash: the best alignment of each document and item from ``threshold`` on."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("content"))
    tests = benchmark.filter("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = tests.agg(F.coalesce(F.sum(F.size(F.split("text", r"\s+"))), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_WORDS))
    schema = "doc_id long, item_id long, item_words long, score double, n_matches long, start_word long, end_word long, content long"
    found = None
    for b in range(blocks):
        items = sorted(((r["item_id"], r["text"]) for r in tests.filter(F.expr(f"pmod(xxhash64(text), {blocks}) = {b}")).collect()), key=lambda x: (x[0] is None, x[0], x[1]))
        part = rows.mapInArrow(_aligned(spark.sparkContext.broadcast(prepare(items)), threshold), schema)
        found = part if found is None else found.union(part)
    return found
