"""Best-fit packing of tokenised documents into sequences of a fixed length, in bulk.

Documents become pieces of 1 to ``size`` tokens. Packing is bulk-synchronous. At first
as many sequences are open as the tokens fill. In a round all pieces without a place
and all gaps are range-sorted together, the largest first, and each piece meets its
successor, the smallest gap that holds it and is still free: a gap opens a bracket, a
piece closes one, and brackets that match are a piece and its gap. Each task sweeps its
own range; what is left open or unmatched there is matched between ranges by its rank,
for which only the two numbers of each range go to the driver. A gap of more than
twice the longest piece offers itself several times, at an equal part of its size. Gaps
are then updated, and the next round takes what conflicts left. Pieces longer than
every gap open new sequences. In two or three rounds the longest piece halves, so the number
of rounds depends on ``size`` and not on the data. Equal lengths may be a third of all
rows: ranges are cut by size and row, so they fall into many tasks.

Tokens are those of the tokenizer file on the whole text (see word_ids).

Edge cases: a null or blank text is the end id alone. Repeated rows are packed
each; a null doc_id is packed too. An empty table gives no sequences. Extra
columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.llm import shared
from tesserine.llm.word_ids import WordIds

SIZE, END_ID = 4096, 1
#: Bytes of text that are tokenised at once.
TOKENISED = 4 << 20
#: Gaps and pieces in a range, on average.
RANGE_ROWS = 500_000


_loaded: dict[str, WordIds] = {}  # the tokenizer stays with a worker; its words go with the task


def _pieces(path: str, size: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _loaded:
            _loaded[path] = WordIds(path, END_ID)
        tokenizer = _loaded[path]
        for batch in batches:
            data, offsets = shared.text_buffers(batch.column(1))
            for low, high in shared.steps(offsets, TOKENISED):
                at = offsets[low : high + 1]
                ids, starts = tokenizer.batch(data[at[0] : at[-1]], at - at[0])
                n = np.diff(starts)
                row = np.repeat(np.arange(high - low), -(-n // size))
                piece = np.arange(len(row)) - np.repeat(np.cumsum(-(-n // size)) - -(-n // size), -(-n // size))
                start = piece * size
                length = np.minimum(n[row] - start, size)
                begin = starts[row] + start
                crc = [zlib.crc32(ids[a : a + b]) for a, b in zip(begin.tolist(), length.tolist())]
                columns = [batch.column(0).slice(low, high - low).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])
        tokenizer.clear()

    return run


def pieces(docs: DataFrame, path: str, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) and, with_ids, the ids: each document's tokens in pieces of ``size``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_pieces(path, size, with_ids), "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sweeps a range of gaps and pieces (size, is_piece, id, m), the largest first and gaps before pieces of their size.

    Gives matched rows (id, seq, length); pieces left (seq is null) with their rank k; and gaps left (id is null) with m places
    from the rank k on, counted from the gap that comes next."""
    part = TaskContext.get().partitionId()
    gaps: list[list[int]] = []
    unmatched = 0
    for batch in batches:
        ids, seqs, lengths, ranks = [], [], [], []
        for size, is_piece, row, m in zip(*(c.to_pylist() for c in batch.columns)):
            if not is_piece:
                gaps.append([row, m])
                continue
            ids.append(row)
            lengths.append(size)
            if gaps:
                seqs.append(gaps[-1][0])
                ranks.append(None)
                gaps[-1][1] -= 1
                if not gaps[-1][1]:
                    gaps.pop()
            else:
                seqs.append(None)
                ranks.append(unmatched)
                unmatched += 1
        yield _swept(ids, seqs, lengths, ranks, [None] * len(ids), part)
    gaps.reverse()
    before = 0
    for low in range(0, len(gaps), 10_000):
        some = gaps[low : low + 10_000]
        ranks = []
        for _, m in some:
            ranks.append(before)
            before += m
        yield _swept([None] * len(some), [seq for seq, _ in some], [None] * len(some), ranks, [m for _, m in some], part)


def _swept(ids: list, seqs: list, lengths: list, ranks: list, many: list, part: int) -> pa.RecordBatch:
    columns = [pa.array(x, pa.int64()) for x in (ids, seqs, lengths, ranks, many, [part] * len(ids))]
    return pa.RecordBatch.from_arrays(columns, ["id", "seq", "length", "k", "m", "part"])


def between(ranges: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int]]]:
    """What ranges left over, matched: of (range, pieces, places) in order, (range, rank from, to, range of the gaps, what to add to the rank) and the places used of each range."""
    stack: list[list[int]] = []
    plan, used = [], {}
    for part, pieces_left, places in ranges:
        k = 0
        while k < pieces_left and stack:
            q, free, at = stack[-1]
            n = min(pieces_left - k, free)
            plan.append((part, k, k + n, q, at - k))
            used[q] = at + n
            k += n
            stack[-1][1:] = [free - n, at + n]
            if n == free:
                stack.pop()
        if places:
            stack.append([part, places, 0])
    return plan, sorted(used.items())


def sweep(spark: SparkSession, left: DataFrame, gaps: DataFrame, longest: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """A round: (id, seq, length) of the pieces that found their gap, and the pieces (id, length) left; ``rows``: how many rows there are."""
    times = F.greatest(F.lit(1), F.expr(f"gap div {longest}"))
    items = gaps.withColumn("m", times.cast("long")).select(F.expr("gap div m").alias("size"), F.lit(False).alias("is_piece"), F.col("seq").alias("id"), "m")
    items = items.union(left.select(F.col("length").alias("size"), F.lit(True), "id", F.lit(1).cast("long")))
    order = [F.desc("size"), F.asc("is_piece"), F.asc("id")]
    swept = items.repartitionByRange(max(1, -(-rows // RANGE_ROWS)), *order).sortWithinPartitions(*order).mapInArrow(match, "id long, seq long, length long, k long, m long, part long")
    swept = shared.cut(spark, swept)
    counts = swept.filter("k is not null").groupBy("part").agg(F.expr("count_if(m is null)").alias("pieces"), F.coalesce(F.sum("m"), F.lit(0)).alias("places")).collect()
    plan, used = between(sorted((r["part"], r["pieces"], r["places"]) for r in counts))
    if not plan:  # nothing is matched between ranges
        return swept.filter("k is null").select("id", "seq", "length"), swept.filter("k is not null and m is null").select("id", "length")
    plan = F.broadcast(spark.createDataFrame(plan, "p long, low long, high long, q long, shift long"))
    used = F.broadcast(spark.createDataFrame(used, "p long, used long"))
    pieces_left = swept.filter("k is not null and m is null").join(plan, F.expr("part = p and k >= low and k < high"), "left").select("id", "length", "q", (F.col("k") + F.col("shift")).alias("at"))
    places = swept.filter("m is not null").join(used, F.expr("part = p and k < used")).select("seq", F.col("part").alias("q"), F.explode(F.expr("sequence(k, least(k + m, used) - 1)")).alias("at"))
    matched = swept.filter("k is null").select("id", "seq", "length").union(pieces_left.join(places, ["q", "at"]).select("id", "seq", "length"))
    return shared.cut(spark, matched), pieces_left.filter("q is null").select("id", "length")


def packed(spark: SparkSession, docs: DataFrame, path: str, size: int = SIZE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece."""
    cut = shared.cut(spark, pieces(docs, path, size).withColumn("id", F.monotonically_increasing_id()))

    def extent(rows: DataFrame):
        return rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens"), F.max("length").alias("longest"), F.min("length").alias("shortest"), F.expr(f"count_if(2 * length > {size})").alias("halves")).first()

    left = cut.select("id", "length")
    now = extent(left)
    count = opened = -(-now["tokens"] // size)
    gaps = spark.range(opened).select(F.col("id").alias("seq"), F.lit(size).cast("long").alias("gap"))
    placed, turn = None, 0
    while now["n"]:
        matched, left = sweep(spark, left, gaps, now["longest"], now["n"] + count)
        part = matched.select("id", "seq", F.lit(turn).alias("turn"))
        placed = part if placed is None else placed.union(part)
        turn += 1
        now = extent(left)
        if not now["n"]:
            break
        taken = matched.groupBy("seq").agg(F.sum("length").alias("taken"))
        gaps = shared.cut(spark, gaps.join(taken, "seq", "left").select("seq", (F.col("gap") - F.coalesce("taken", F.lit(0))).alias("gap")).filter(F.col("gap") >= now["shortest"]))
        count, widest = gaps.agg(F.count("*"), F.coalesce(F.max("gap"), F.lit(0))).first()
        if now["longest"] > widest:
            long = extent(left.filter(F.col("length") > widest))
            new = max(-(-long["tokens"] // size), long["halves"])
            gaps = gaps.union(spark.range(opened, opened + new).select(F.col("id").alias("seq"), F.lit(size).cast("long").alias("gap")))
            opened, count = opened + new, count + new
    if placed is None:
        placed = left.select("id", F.lit(0).cast("long").alias("seq"), F.lit(0).alias("turn"))
    both = cut.join(placed, "id")
    return both.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("seq").alias("sequence_id"), F.expr("sum(length) over (partition by seq order by turn, id rows unbounded preceding) - length").alias("offset"))


def sequences(spark: SparkSession, docs: DataFrame, path: str, size: int = SIZE) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, for a writer of training files."""
    places = packed(spark, docs, path, size).select("doc_id", "piece", "ids_crc32", "sequence_id", "offset")
    places = places.withColumn("copy", F.expr("row_number() over (partition by doc_id, piece, ids_crc32 order by sequence_id, offset)"))
    ids = pieces(docs, path, size, with_ids=True).withColumn("copy", F.expr("row_number() over (partition by doc_id, piece, ids_crc32 order by start)"))
    both = places.alias("p").join(ids.alias("i"), F.expr("p.doc_id <=> i.doc_id and p.piece = i.piece and p.ids_crc32 = i.ids_crc32 and p.copy = i.copy"))
    return both.groupBy("sequence_id").agg(F.expr("flatten(transform(array_sort(collect_list(struct(offset, ids))), x -> x.ids))").alias("ids"))
