"""Substring dedup: suffix automata of reference shards, matching statistics of streamed documents.

A window is ``length`` consecutive words. A word goes if a window that covers it
also stands in a document with a smaller doc_id.

1. Every window has an anchor, the smallest hash among its 25-word runs; equal
   windows have equal anchors. Anchors that stand in one document only can't
   belong to a repeat; a bitmap of bounded size holds the others.
2. Consecutive windows with one anchor are a passage. Equal passages are one
   class, by 128 bits of hash: those in documents after the class's first go whole, without
   meeting an automaton, and only what stands in its first document is looked at further.
   However often a passage is copied, one of it is left.
3. Windows of these passages are grouped by their hash, partially before the
   shuffle. The first document of a window that several hold is its reference.
4. References, as maximal runs, are dealt into shards of a bounded number of
   windows by anchor; a generalised suffix automaton over words is made of each
   shard, which knows for every state the smallest document. The passages left
   are streamed through their shard's automaton: their matching statistics,
   restricted to smaller documents, give the maximal spans of ``length`` words
   and more. The automaton compares words, so for these passages window hashes only route. A shard
   with much to stream is salted: its automaton stands on several tasks. A shard with too many
   references, as around one common run of words, is split, and all its passages visit each part.
5. The spans of a document are united and its other words kept.

Edge cases: a null or blank text has no words. A row whose doc_id is null
neither removes nor loses words. Rows that share a doc_id count as one document
for others, and each is cut by itself: spans belong to the doc_id and the text's hash. Extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.llm import shared
from tesserine.llm.words import U, Words, inside, minimizers, mix, row_of, runs, words

ANCHOR_WORDS = 25
#: Reference windows in a shard, and windows that a task streams through one automaton, on average.
SHARD_WINDOWS, STREAM_WINDOWS = 4_000, 200_000
#: Reference windows in a part of a shard, on average at most.
MOST_WINDOWS = 50_000


class Automaton:
    """A generalised suffix automaton over words; texts come in ascending order of their document."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.low = [-1], [0], [-(2**63)]

    def _state(self, length: int, low: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        self.low.append(low)
        return len(self.link) - 1

    def _split(self, p: int, word: bytes, q: int) -> int:
        """The state of the strings that ``p`` and ``word`` make, apart from longer ones of ``q``."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.low[q])
        self.next[clone] = dict(self.next[q])
        self.link[clone] = self.link[q]
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, text: list[bytes], doc: int) -> None:
        last = 0
        for word in text:
            if (q := self.next[last].get(word)) is not None:
                last = self._split(last, word, q)
                continue
            here, p = self._state(self.length[last] + 1, doc), last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = here
                p = self.link[p]
            if p >= 0:
                self.link[here] = self._split(p, word, self.next[p][word])
            last = here

    def spans(self, text: list[bytes], doc: int, least: int) -> list[tuple[int, int]]:
        """Maximal spans of ``text``, each word in a match of ``least`` words or more with a smaller document."""
        nexts, link, length, low = self.next, self.link, self.length, self.low
        found: list[tuple[int, int]] = []
        v = n = 0
        for i, word in enumerate(text):
            while v and word not in nexts[v]:
                v = link[v]
                n = length[v]
            if word in nexts[v]:
                v = nexts[v][word]
                n += 1
            if n >= least:
                u, m = v, n
                while m >= least and low[u] >= doc:
                    u = link[u]
                    m = length[u]
                if m >= least:
                    if found and found[-1][1] >= i + 1 - m:
                        found[-1] = (min(found[-1][0], i + 1 - m), i + 1)
                    else:
                        found.append((i + 1 - m, i + 1))
        return found


def _windows(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words, the first word of each window, the word where its anchor begins, and the anchors' hashes."""
    n = min(ANCHOR_WORDS, length)
    w = words(data, offsets)
    at = inside(w.rows, length)
    keys = runs(w.hashes, n)
    anchor = minimizers(keys, length - n + 1)[at] if len(at) else at
    return w, at, anchor, mix(keys[anchor]) if len(at) else keys[:0]  # smallest hashes begin with zeros: mixed again


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of rows (doc_id, text, c): ids, hashes of texts, and the texts."""
    for batch in batches:
        ids, c = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(2).to_numpy(zero_copy_only=False)
        data, offsets = shared.text_buffers(batch.column(1))
        for low, high in shared.steps(offsets):
            at = offsets[low : high + 1]
            yield ids[low:high], c[low:high], data[at[0] : at[-1]], at - at[0]


def _anchors(length: int):
    def run(batches):
        for ids, _, data, offsets in _pieces(batches):
            w, at, anchor, keys = _windows(data, offsets, length)
            if len(at):
                new = np.ones(len(at), bool)
                new[1:] = anchor[1:] != anchor[:-1]
                doc = ids[row_of(w.rows)[at[new]]]
                order = np.lexsort((keys[new], doc))
                doc, keys = doc[order], keys[new][order]
                once = np.ones(len(doc), bool)
                once[1:] = (doc[1:] != doc[:-1]) | (keys[1:] != keys[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(keys[once].view(np.int64)), pa.array(doc[once])], ["a", "doc_id"])

    return run


def _passages(length: int, anchors, only=None):
    """Runs of windows with one shared anchor: two hashes, the anchor's, the document, first word and windows; with ``only``, of the places in that bitmap, with the text instead."""

    def run(batches):
        for ids, texts, data, offsets in _pieces(batches):
            w, at, anchor, keys = _windows(data, offsets, length)
            take = shared.passes(anchors.value, keys)
            if not take.any():
                continue
            at, anchor, keys = at[take], anchor[take], keys[take]
            row = row_of(w.rows)[at]
            new = np.ones(len(at), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(at)) - 1
            doc, c, place = ids[row[first]], texts[row[first]], at[first] - w.rows[row[first]]
            if only is None:
                whole = runs(w.hashes, length)
                n = last - first + 1  # the first and the last window overlap: together they are the passage
                yield pa.RecordBatch.from_arrays([pa.array(whole[at[first]].view(np.int64)), pa.array(mix(whole[at[last]] + n.astype(np.uint64)).view(np.int64)), pa.array(doc), pa.array(c), pa.array(place.astype(np.int32)), pa.array(n.astype(np.int32))], ["h", "g", "doc_id", "c", "at", "n"])
                continue
            wanted = shared.passes(only.value, _place(doc, c, place))
            first, last, doc, c, place = first[wanted], last[wanted], doc[wanted], c[wanted], place[wanted]
            begin, end = w.starts[at[first]], w.ends[at[last] + length - 1]
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array((keys[first] & U(0xFFFFFFFF)).astype(np.uint32).view(np.int32)), pa.array(doc), pa.array(c), pa.array(place.astype(np.int32)), pa.array([raw[x:y] for x, y in zip(begin.tolist(), end.tolist())], pa.binary())], ["a", "doc_id", "c", "at", "text"]
            )

    return run


def _place(doc: np.ndarray, c: np.ndarray, at: np.ndarray) -> np.ndarray:
    return mix(mix(doc.astype(np.int64).view(np.uint64)) + c.astype(np.int32).view(np.uint32) * U(1 << 32) + at.astype(np.uint64))


def _places(batches):
    for batch in batches:
        keys = _place(*(c.to_numpy() for c in batch.columns))
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], ["k"])


def _passage_windows(length: int):
    """All windows of passages (a, doc_id, c, at, text, copied)."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(4).cast(pa.large_binary())
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
            a, doc, c, place, copied = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2, 3, 5))
            for low, high in shared.steps(offsets):
                w = words(data[offsets[low] - offsets[0] : offsets[high] - offsets[0]], offsets[low : high + 1] - offsets[low])
                at = inside(w.rows, length)
                row = row_of(w.rows)[at]
                yield pa.RecordBatch.from_arrays([pa.array(runs(w.hashes, length)[at].view(np.int64)), pa.array(a[low + row]), pa.array(doc[low + row]), pa.array(c[low + row]), pa.array((place[low + row] + at - w.rows[row]).astype(np.int32)), pa.array(copied[low + row])], ["w", "a", "doc_id", "c", "at", "copied"])

    return run


def _references(length: int):
    """Of a passage and the windows in it that are references, the maximal runs of those."""

    def run(batches):
        for batch in batches:
            out = []
            for a, doc, c, at, text, firsts in zip(*(c.to_pylist() for c in batch.columns)):
                parts = text.split()
                own = np.array(sorted({x - at for x in firsts if at <= x <= at + len(parts) - length}))
                if len(own):
                    for run_ in np.split(own, np.flatnonzero(np.diff(own) > 1) + 1):
                        out.append((a, doc, c, at + int(run_[0]), b" ".join(parts[run_[0] : run_[-1] + length])))
            yield pa.RecordBatch.from_pylist([dict(zip(("a", "doc_id", "c", "at", "text"), x)) for x in out], pa.schema([("a", pa.int32()), ("doc_id", pa.int64()), ("c", pa.int32()), ("at", pa.int32()), ("text", pa.binary())]))

    return run


def _matched(length: int):
    """Streams passages through the automaton of their shard, whose references come first."""

    def run(batches):
        now, automaton, pool = None, Automaton(), {}
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for shard, part, salt, stream, doc, c, at, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (shard, part, salt) != now:
                    now, automaton, pool = (shard, part, salt), Automaton(), {}
                parts = text.split()
                if not stream:
                    automaton.add([pool.setdefault(x, x) for x in parts], doc)
                    continue
                for low, high in automaton.spans(parts, doc, length):
                    for values, x in zip(out, (doc, c, at + low, at + high)):
                        values.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *[pa.array(x, pa.int32()) for x in out[1:]]], ["doc_id", "c", "start", "end"])

    return run


def _content() -> Column:
    """What tells rows of one doc_id apart."""
    return F.hash(F.col("text").cast("string")).alias("c")


def repeated_spans(spark: SparkSession, docs: DataFrame, length: int = 50) -> DataFrame:
    """(doc_id, c, start, end), c being the hash of the text: spans of words, end exclusive, that stand in a document with a smaller doc_id; they may overlap."""
    texts = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _content())
    anchors = shared.cut(spark, texts.mapInArrow(_anchors(length), "a long, doc_id long").groupBy("a").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).filter("x < y").select("a"))
    passing = spark.sparkContext.broadcast(shared.bitmap(anchors, "a", anchors.count()))
    shared.drop(spark, anchors)
    passages = shared.cut(spark, texts.mapInArrow(_passages(length, passing), "h long, g long, doc_id long, c int, at int, n int"))
    # classes are a table of their own, so that the join can split the class that holds a third of all passages
    classes = shared.cut(spark, passages.groupBy("h", "g").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("h", "g", "first"))
    placed = shared.cut(spark, passages.join(classes, ["h", "g"], "left").select("doc_id", "c", "at", "n", F.coalesce(F.col("doc_id") == F.col("first"), F.lit(True)).alias("own"), F.col("first").isNotNull().alias("copied")))
    shared.drop(spark, passages, classes)
    copies = placed.filter("not own").select("doc_id", "c", F.col("at").alias("start"), F.expr(f"at + n + {length - 1}").alias("end"))
    own = placed.filter("own").select("doc_id", "c", "at", "copied")
    places = own.select("doc_id", "c", "at").mapInArrow(_places, "k long")
    only = spark.sparkContext.broadcast(shared.bitmap(places, "k", own.count()))
    kinds = "a int, doc_id long, c int, at int, text binary"
    del classes, passages
    left = shared.cut(spark, texts.mapInArrow(_passages(length, passing, only), kinds).join(own.distinct(), ["doc_id", "c", "at"]).select("a", "doc_id", "c", "at", "text", "copied"))
    firsts = left.mapInArrow(_passage_windows(length), "w long, a int, doc_id long, c int, at int, copied boolean").withColumn("place", F.struct("doc_id", "c", "at"))
    firsts = firsts.groupBy("w", "a").agg(F.min("place").alias("first"), F.max("doc_id").alias("last"), F.max("copied").alias("copied"), F.count("*").alias("n")).filter("copied or first.doc_id < last")
    firsts = shared.cut(spark, firsts.select("a", "first.doc_id", "first.c", "first.at", "n"))
    shards = max(1, -(-firsts.count() // SHARD_WINDOWS))
    salts = shared.cut(spark, firsts.groupBy(F.expr(f"pmod(hash(a), {shards})").alias("shard")).agg(F.expr(f"cast(ceil(sum(n) / {STREAM_WINDOWS}) as int)").alias("salts"), F.expr(f"cast(ceil(count(*) / {MOST_WINDOWS}) as int)").alias("parts")))
    held = left.join(firsts.groupBy("doc_id", "c", "a").agg(F.collect_list("at").alias("firsts")), ["doc_id", "c", "a"]).select("a", "doc_id", "c", "at", "text", "firsts").mapInArrow(_references(length), kinds)
    shard = F.expr(f"pmod(hash(a), {shards})").alias("shard")
    held = held.select("*", shard).join(salts, "shard").select("shard", F.expr("cast(pmod(xxhash64(doc_id, at), parts) as int)").alias("part"), F.explode(F.expr("sequence(0, salts - 1)")).alias("salt"), F.lit(False).alias("stream"), "doc_id", "c", "at", "text")
    streamed = left.select("*", shard).join(salts, "shard").select("shard", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), F.expr("cast(pmod(xxhash64(doc_id), salts) as int)").alias("salt"), F.lit(True).alias("stream"), "doc_id", "c", "at", "text")
    together = held.union(streamed).repartition(shared.partitions(spark), "shard", "part", "salt").sortWithinPartitions("shard", "part", "salt", "stream", "doc_id")
    spans = shared.cut(spark, copies.union(together.mapInArrow(_matched(length), "doc_id long, c int, start int, end int")))
    shared.drop(spark, placed, left, firsts, salts)
    return spans


def _kept(batches):
    """Of a text and its spans, the words that stay."""
    for batch in batches:
        out = []
        for doc, text, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            all_words = text.as_buffer().to_pybytes().split() if text.is_valid else []
            kept, n = all_words, 0
            if spans:
                stays = np.ones(len(all_words), bool)
                for x in spans:
                    stays[x["start"] : x["end"]] = False
                kept = [all_words[i] for i in np.flatnonzero(stays)]
                n = len(all_words) - len(kept)
            out.append((doc, len(all_words), n, b" ".join(kept)))
        columns = list(zip(*out)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])


def _digested(batches):
    for batch in _kept(batches):
        digests = [hashlib.sha256(x.as_buffer()).hexdigest() for x in batch.column(3)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def remove_repeats(spark: SparkSession, docs: DataFrame, length: int = 50, digest: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) for each row; with ``digest``, kept_sha256 in place of the text."""
    spans = repeated_spans(spark, docs, length)
    spans = spans.groupBy("doc_id", "c").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    with_spans = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _content()).join(spans, ["doc_id", "c"], "left").select("doc_id", "text", "spans")
    if digest:
        return with_spans.mapInArrow(_digested, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    return with_spans.mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept_text string")
