"""Class-based language model: exchange clustering, class transitions and word emissions.

1. Texts are tokenised once. A chunk of them is kept as its distinct words and, for
   every token, which of these it is.
2. Exchange, first on the SEEDS most frequent words: their bigrams are counted over
   all training rows, and one word at a time moves to the class that raises the
   likelihood of the class bigrams most, until nothing moves. All other words are one
   type there and the end of a text another, each a class of its own. Every other
   training word, however rare, begins in the class that its neighbours' classes suit best.
3. Exchange of the whole vocabulary, seeds too, in rounds: of every word the classes of
   all its neighbours are counted, and the exact gain of the likelihood is found for each class it
   could move to alone. A share of the words, drawn anew each round, moves at once; the likelihood is
   then counted over all texts. A round that lowers it is undone and the share
   halves. It ends when nothing moves or a round adds next to nothing.
4. Words are dealt over slices of their hashes. Chunks send a slice the counts of its
   words and get their classes back, so nothing that grows with the vocabulary is broadcast or
   brought to the driver, and the plan is the same at every size.
5. A text's probability is the product of P(class | class before) * P(word | class) over
   its words and one end. Transitions are interpolated with class frequencies; emissions
   take DISCOUNT off every count for the unknown word, which any class can emit: its
   probability is summed over the classes, and what follows it is mixed from what
   follows them. So all adds to one after every class and after the unknown word.

Edge cases: a null or blank text is its end alone. A null doc_id counts as the
empty text for the split. Repeated rows are scored each. Without training rows
every token is unknown, with probability one. Only doc_id and text are looked at.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.llm import shared
from tesserine.llm.words import U, mix, words

SEEDS, SWEEPS, ROUNDS = 1000, 8, None
#: Classes of words; then the end's, and that of words without a class.
CLASSES = 47
END, OTHER = CLASSES, CLASSES + 1
STATES = CLASSES + 2
#: Slots of a word's counts: the classes before it, those after it, and the word itself.
LOOP = 2 * STATES
WIDTH = LOOP + 1
END_HASH = U(0x9D39247E33776D41)
END_KEY = int(END_HASH.view(np.int64))
#: Bytes of text in a chunk; words of a chunk that are proposed as seeds; words of chunks in a slice of the hashes.
CHUNK, PROPOSED, SLICE = 2 << 20, 4096, 400_000
#: Words or counts whose gains are found at once, and counts up to which these are looked up.
PORTION, STEPS = 8192, 32
#: The exchange ends if a round adds less than this to the likelihood of a token (in nats), or if it falls though so few may move.
LEAST_RISE, LEAST_SHARE = 5e-3, 0.1
#: The share of words that may move in a round, to begin with; it halves when the likelihood falls, as words that move together are in each other's way.
FIRST_SHARE = 0.5
#: Weight of the class frequencies in transitions, and what is taken off each count for the unknown word.
ALPHA, DISCOUNT = 5.0, 0.5
_ENCODED = "chunk long, ids array<long>, train binary, starts binary, keys binary, low binary, high binary"


def held_out() -> Column:
    """Rows that the model doesn't learn from."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0


class Chunk(NamedTuple):
    number: int
    ids: pa.Array
    train: np.ndarray  #: whether a row is learned from
    starts: np.ndarray  #: of each row's tokens, and their number
    keys: np.ndarray  #: the distinct words' hashes, the most frequent first
    at: np.ndarray  #: of each token, its place in keys

    def learned(self) -> np.ndarray:
        """Which tokens are learned from."""
        return np.repeat(self.train, np.diff(self.starts))

    def before(self, of_tokens: np.ndarray, end: int) -> np.ndarray:
        """Of each token what is said of the one before; the end before a row's first."""
        out = np.empty_like(of_tokens)
        out[1:] = of_tokens[:-1]
        out[self.starts[:-1]] = end
        return out


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of each row's words, A-Z as a-z, and of its end; and where each row's begin."""
    w = words(data, offsets, lower=True)
    n, rows = len(w.hashes), len(offsets) - 1
    hashes = np.full(n + rows, END_HASH)
    hashes[np.arange(n) + np.repeat(np.arange(rows), np.diff(w.rows))] = w.hashes
    return hashes, w.rows + np.arange(rows + 1)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, train) as chunks."""
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        data, offsets = shared.text_buffers(batch.column(1))
        train = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
        for low, high in shared.steps(offsets, CHUNK):
            found, sizes = [], []
            for a, b in shared.steps(offsets[low : high + 1]):  # hashing takes some 50 bytes for each byte of text
                at = offsets[low + a : low + b + 1]
                hashes, starts = tokens(data[at[0] : at[-1]], at - at[0])
                found.append(hashes)
                sizes.append(np.diff(starts))
            starts = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            keys, back, n = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            back = place[back]
            parts = [train[low:high], starts.astype(np.int64), keys[order], (back & np.uint32(0xFFFF)).astype(np.uint16), (back >> np.uint32(16)).astype(np.uint16)]
            ids = pa.ListArray.from_arrays(pa.array([0, high - low], pa.int32()), batch.column(0).slice(low, high - low).cast(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), ids, *[pa.array([x.tobytes()], pa.binary()) for x in parts]], ["chunk", "ids", "train", "starts", "keys", "low", "high"])
            number += 1


def _chunks(batch: pa.RecordBatch) -> Iterator[Chunk]:
    kinds = (bool, np.int64, np.uint64, np.uint16, np.uint16)
    for k in range(batch.num_rows):
        train, starts, keys, low, high = (np.frombuffer(batch.column(c + 2)[k].as_buffer(), kind) for c, kind in enumerate(kinds))
        yield Chunk(batch.column(0)[k].as_py(), batch.column(1)[k].values, train, starts, keys, low.astype(np.int64) | high.astype(np.int64) << 16)


def _per_chunk(make: Callable[[Chunk], tuple[list, list[str]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in _chunks(batch):
                columns, names = make(chunk)
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names)

    return run


def _proposed(chunk: Chunk):
    """The most frequent words of a chunk, counted where they are learned from."""
    n = np.bincount(chunk.at[chunk.learned()], minlength=len(chunk.keys))
    top = np.argsort(-n, kind="stable")[:PROPOSED]
    top = top[(n[top] > 0) & (chunk.keys[top] != END_HASH)]
    return [chunk.keys[top].view(np.int64), n[top]], ["k", "n"]


class Lookup(NamedTuple):
    """A bounded number of words with a class each."""

    keys: np.ndarray  #: sorted
    classes: np.ndarray

    def of(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), OTHER, np.int64)
        if len(self.keys):
            at = np.searchsorted(self.keys, keys)
            at[at == len(self.keys)] = 0
            out = np.where(self.keys[at] == keys, self.classes[at], OTHER)
        out[keys == END_HASH] = END
        return out


def _seed_pairs(sent, size: int):
    """Bigrams of seeds, the end and all others: a seed's type is its place, then come those two."""

    def make(chunk: Chunk):
        kinds = sent.value.of(chunk.keys)  # here, a seed's class is its type
        kinds = np.where(kinds == END, size - 2, np.where(kinds == OTHER, size - 1, kinds - STATES))[chunk.at]
        codes, n = np.unique((chunk.before(kinds, size - 2) * size + kinds)[chunk.learned()], return_counts=True)
        return [codes, n], ["k", "n"]

    return make


def exchange(bigrams: np.ndarray, classes: int, alone: int = 1, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of each type: the last ``alone`` have the last classes to themselves, and each other goes where it raises the likelihood most."""
    size = len(bigrams)
    own = np.zeros(size, np.int64)
    order = np.argsort(-(bigrams.sum(0) + bigrams.sum(1))[: size - alone], kind="stable")
    own[order] = np.arange(size - alone) % (classes - alone)
    own[size - alone :] = np.arange(classes - alone, classes)
    member = np.zeros((size, classes))
    member[np.arange(size), own] = 1
    out, into = bigrams @ member, bigrams.T @ member
    table = member.T @ out

    def f(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1e-300))

    for _ in range(sweeps):
        moved = 0
        for w in order:
            a, loop = own[w], bigrams[w, w]
            o, i = out[w].copy(), into[w].copy()
            o[a] -= loop
            i[a] -= loop
            table[a] -= o
            table[:, a] -= i
            table[a, a] -= loop
            rows, cols = table.sum(1), table.sum(0)
            on = table.diagonal()
            gain = (f(table + o) - f(table)).sum(1) - (f(on + o) - f(on))
            gain += (f(table + i[:, None]) - f(table)).sum(0) - (f(on + i) - f(on))
            gain += f(on + o + i + loop) - f(on)
            rows, cols = rows + i, cols + o  # w's neighbours count in their classes wherever w goes
            gain -= f(rows + o.sum() + loop) - f(rows) + f(cols + i.sum() + loop) - f(cols)
            gain[classes - alone :] = -np.inf
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            table[b] += o
            table[:, b] += i
            table[b, b] += loop
            if b != a:
                moved += 1
                own[w] = b
                out[:, a] -= bigrams[:, w]
                out[:, b] += bigrams[:, w]
                into[:, a] -= bigrams[w]
                into[:, b] += bigrams[w]
        if not moved:
            break
    return own


def _counted(slices: int, seeds):
    """Chunks, with what _settled() says of their words or with ``seeds`` alone, as the counts of each slice of the words' hashes, and the class bigrams in a row of slice -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(STATES * STATES, np.int64)
        for batch in batches:
            for k, chunk in enumerate(_chunks(batch)):
                own = seeds.value.of(chunk.keys).astype(np.int8) if seeds else _known(chunk, batch.column(7)[k])[0]
                yield _sliced(chunk, own, slices, pairs)
        if pairs.any():
            yield _rows([(-1, -1, b"", b"", b"", b"", b"", pairs.tobytes())], _COUNTS_NAMES, (pa.int32(), pa.int64(), *[pa.binary()] * 6))

    return run


def _rows(rows: list[tuple], names: list[str], kinds: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)], names)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pairs = np.zeros(STATES * STATES, np.int64)
    for batch in batches:
        for x in batch.column(0).to_pylist():
            pairs += np.frombuffer(x, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array([pairs.tobytes()], pa.binary())], ["pairs"])


def _sliced(chunk: Chunk, own: np.ndarray, slices: int, pairs: np.ndarray) -> pa.RecordBatch:
    """How often a word that is learned from stands after each class (slots from 0), before it (from STATES) and after itself (LOOP); class bigrams are added to ``pairs``."""
    order = np.argsort(chunk.keys)
    rank = np.empty(len(order), np.int32 if len(order) * WIDTH < 2**31 else np.int64)
    rank[order] = np.arange(len(order)) * WIDTH
    of, learned = own[chunk.at], chunk.learned()
    before = chunk.before(of, END)
    pairs += np.bincount(before[learned].astype(np.int32) * STATES + of[learned], minlength=STATES * STATES)
    after = np.full(len(of), END, np.int8)
    after[:-1] = of[1:]
    after[chunk.starts[1:] - 1] = END
    at, again = rank[chunk.at], chunk.before(chunk.at, -1) == chunk.at
    codes = np.concatenate([(at + before)[learned], (at + after + np.int32(STATES))[learned], at[again & learned] + np.int32(LOOP)])
    del at, before, after, again, of
    codes.sort()
    new = np.flatnonzero(np.diff(codes, prepend=-1))
    n = np.diff(np.append(new, len(codes)))
    codes = codes[new]
    sizes = np.bincount(codes // WIDTH, minlength=len(order))
    slots, first = (codes % WIDTH).astype(np.uint8), np.concatenate([[0], np.cumsum(sizes)])
    keys, own, sizes = chunk.keys[order], own[order].astype(np.int8), sizes.astype(np.uint8)
    ends = np.searchsorted(((keys >> U(32)) * U(slices)) >> U(32), np.arange(slices + 1))
    rows = []
    for k in np.flatnonzero(np.diff(ends)).tolist():
        a, b = int(ends[k]), int(ends[k + 1])
        m = n[first[a] : first[b]]
        m = m.astype(np.min_scalar_type(int(m.max(initial=0))))
        rows.append((k, chunk.number, *[x.tobytes() for x in (keys[a:b], own[a:b], sizes[a:b], slots[first[a] : first[b]], m)], b""))
    return _rows(rows, _COUNTS_NAMES, (pa.int32(), pa.int64(), *[pa.binary()] * 6))


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def gains(word: np.ndarray, slot: np.ndarray, n: np.ndarray, own: np.ndarray, table: np.ndarray) -> np.ndarray:
    """What the likelihood of the class bigrams gains, for each word and class, if the word alone leaves its own class for it; exact, and 0 for the own one.

    Counts (word, slot, n) are in the order of the words; ``table`` holds them too."""
    size = len(own)
    dense = np.zeros((size, WIDTH))
    dense[word, slot] = n
    loop = dense[:, LOOP]
    mine = np.arange(size), own
    o, i = dense[:, STATES : 2 * STATES], dense[:, :STATES]
    o[mine] -= loop  # neighbours but for the word itself
    i[mine] -= loop
    o_all, i_all = o.sum(1) + loop, i.sum(1) + loop
    # of each count, what it adds to each class's cell, and what it took from the own one
    plain = slot != LOOP
    word, slot = word[plain], slot[plain]
    n = dense[word, slot]
    cells = np.concatenate([table, table.T])  # by slot, then class
    steps = np.stack([_f(cells + k) - _f(cells) for k in range(STEPS)])
    small, gain = n < STEPS, np.zeros((size, STATES))
    for mask, added in ((small, lambda at: steps[n[at].astype(np.int64), slot[at]]), (~small, lambda at: _f(cells[slot[at]] + n[at, None]) - _f(cells[slot[at]]))):
        where = np.flatnonzero(mask)
        for low in range(0, len(where), PORTION):
            at = where[low : low + PORTION]
            new = np.flatnonzero(np.diff(word[at], prepend=-1))
            gain[word[at][new]] += np.add.reduceat(added(at), new)
    whole = cells[slot, own[word]]
    stay = np.bincount(word, weights=_f(whole) - _f(np.maximum(whole - n, 0)), minlength=size)
    # the cells that meet the own class, which the word leaves, and those within a class, which take all at once
    out, into, on = table[:, own].T, table[own], table.diagonal()
    o_own, i_own = o[mine][:, None], i[mine][:, None]
    gain += _f(np.maximum(out - i, 0) + o_own) - _f(np.maximum(out - i, 0)) - _f(out + o_own) + _f(out)
    gain += _f(np.maximum(into - o, 0) + i_own) - _f(np.maximum(into - o, 0)) - _f(into + i_own) + _f(into)
    gain += _f(on + o + i + loop[:, None]) - _f(on + o) - _f(on + i) + _f(on)
    here, rows, cols = table[own, own], table.sum(1), table.sum(0)
    stay += _f(here) - _f(np.maximum(here - o[mine] - i[mine] - loop, 0)) - 2 * _f(here) + _f(np.maximum(here - o[mine], 0)) + _f(np.maximum(here - i[mine], 0))
    gain -= _f(rows + o_all[:, None]) - _f(rows) + _f(cols + i_all[:, None]) - _f(cols)
    stay -= _f(rows[own]) - _f(np.maximum(rows[own] - o_all, 0)) + _f(cols[own]) - _f(np.maximum(cols[own] - i_all, 0))
    gain -= stay[:, None]
    gain[mine] = 0
    return gain


def _placed(word: np.ndarray, slot: np.ndarray, n: np.ndarray, own: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The classes where words begin that have none: by what each neighbour adds in the first order of the counts."""
    t = table + 0.1
    with np.errstate(divide="ignore"):
        gain = np.concatenate([np.log(t / t.sum(0)), np.log(t / t.sum(1, keepdims=True)).T])[:, :CLASSES]
    gain[:, table.sum(1)[:CLASSES] == 0] = -1e9  # a class without words stays empty
    out = own.copy()
    for low in range(0, len(own), PORTION):
        high = min(low + PORTION, len(own))
        a, b = np.searchsorted(word, [low, high])
        dense = np.zeros((high - low, WIDTH))
        dense[word[a:b] - low, slot[a:b]] = n[a:b]
        free = low + np.flatnonzero(own[low:high] == OTHER)
        out[free] = (dense[free - low, :LOOP] @ gain).argmax(axis=1)
    return out


def _best(word: np.ndarray, slot: np.ndarray, n: np.ndarray, own: np.ndarray, total: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class of the greatest gain for each word, and whether it is one; words seen once between the same classes are looked at together."""
    alike = np.arange(len(own))
    once = np.flatnonzero(total == 1)
    first = np.searchsorted(word, once)
    _, at, back = np.unique((own[once] * WIDTH + slot[first]) * WIDTH + slot[np.minimum(first + 1, len(slot) - 1)], return_index=True, return_inverse=True)
    alike[once] = once[at][back]
    asked = np.flatnonzero((alike == np.arange(len(own))) & (total > 0))
    place = np.full(len(own), -1)
    place[asked] = np.arange(len(asked))
    mine = place[word] >= 0
    word, slot, n, own = place[word[mine]], slot[mine], n[mine], own[asked]
    best, better = np.zeros(len(asked) + 1, np.int64), np.zeros(len(asked) + 1, bool)
    empty = np.flatnonzero(table.sum(1)[:CLASSES] == 0)  # an empty class gains from any word alone, and would get all of them
    for low in range(0, len(asked), PORTION):
        high = min(low + PORTION, len(asked))
        a, b = np.searchsorted(word, [low, high])
        gain = gains(word[a:b] - low, slot[a:b], n[a:b], own[low:high], table)[:, :CLASSES]
        gain[:, empty] = -np.inf
        best[low:high] = gain.argmax(axis=1)
        better[low:high] = gain[np.arange(high - low), best[low:high]] > 1e-6
    return best[place[alike]], better[place[alike]]


def _settled(sent):
    """Counts in the order of their slices, one of these at a time, as (chunk, slice, classes, n): where words go, and how often they are learned from; and a row for the slice with its words, of chunk -1.

    ``share`` of the words may move; None places words that have no class, and with 0 all stay and their counts are told."""

    def flush(held: list) -> pa.RecordBatch:
        table, share, salt = sent.value
        keys, own, sizes, slots = (np.concatenate([np.frombuffer(r[c], kind) for r in held]) for c, kind in ((2, np.uint64), (3, np.int8), (4, np.uint8), (5, np.uint8)))
        n = np.concatenate([np.frombuffer(r[6], f"u{max(1, len(r[6]) // max(1, len(r[5])))}").astype(np.uint32) for r in held])
        keys, back = np.unique(keys, return_inverse=True)
        of_chunks, own = own, np.empty(len(keys), np.int64)
        own[back] = of_chunks
        codes = (np.repeat(back * WIDTH, sizes) + slots) << 32 | n  # a plain sort is far faster than one of places
        codes.sort()
        n = codes & 0xFFFFFFFF
        codes >>= 32
        new = np.flatnonzero(np.diff(codes, prepend=-1))
        n = np.add.reduceat(n, new) if len(new) else n
        codes = codes[new]
        word, slot = codes // WIDTH, codes % WIDTH
        total = np.bincount(word, weights=np.where(slot < STATES, n, 0), minlength=len(keys)).astype(np.int64)
        to, gained = own.copy(), 0
        if share is None:
            to = np.where(total > 0, _placed(word, slot, n, own, table), own)
            gained = int((to != own).sum())
        elif share:
            turn = mix(keys + U(salt * 0x9E3779B97F4A7C15 & (2**64 - 1))) >> U(32) < U(int(share * 2**32))
            best, better = _best(word, slot, n, own, total, table)
            moves = (total > 0) & (own < CLASSES) & turn & better
            to[moves] = best[moves]
            gained = int((to != own).sum())
        rows, at = [], 0
        for r in held:
            size = len(r[3])
            here = back[at : at + size]
            at += size
            rows.append((r[1], r[0], to[here].astype(np.int8).tobytes(), b"" if share != 0 else _narrow(total[here]), b"", 0))
        known = np.flatnonzero(total)
        rows.append((-1, held[0][0], to[known].astype(np.int8).tobytes(), _narrow(total[known]), keys[known].tobytes(), gained))
        return _rows(rows, ["chunk", "slice", "classes", "n", "keys", "moved"], (pa.int64(), pa.int32(), *[pa.binary()] * 3, pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if held and held[0][0] != row[0]:
                    yield flush(held)
                    held = []
                held.append(row)
        if held:
            yield flush(held)

    return run


def _narrow(n: np.ndarray) -> bytes:
    return n.astype(np.uint32 if n.max(initial=0) < 2**32 else np.int64).tobytes()


def _wide(raw, size: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint32 if len(raw) == 4 * size else np.int64)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of slices as rows (k, n, class)."""
    for batch in batches:
        for classes, n, keys in zip(*[c.to_pylist() for c in batch.columns]):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(keys, np.int64)), pa.array(_wide(n, len(classes)).astype(np.int64)), pa.array(np.frombuffer(classes, np.int8))], ["k", "n", "class"])


def bound_to(encoded: DataFrame, settled: DataFrame) -> DataFrame:
    """Chunks with what _settled() says of their words: ``parts``, each of (slice, classes, n)."""
    return encoded.join(settled.filter("chunk >= 0").groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("slice", "classes", "n"))).alias("parts")), "chunk", "left")


def _known(chunk: Chunk, parts) -> tuple[np.ndarray, np.ndarray | None]:
    """The class and, if it is told, the count of each of a chunk's words; words that aren't in the vocabulary are OTHER and have none."""
    found = parts.as_py()
    order = np.argsort(chunk.keys)
    own = np.empty(len(order), np.int8)
    own[order] = np.frombuffer(b"".join(x["classes"] for x in found), np.int8)
    if not any(x["n"] for x in found):
        return own, None
    n = np.empty(len(order), np.int64)
    n[order] = np.concatenate([_wide(x["n"], len(x["classes"])) for x in found])
    return own, n


class Emissions(NamedTuple):
    mass: np.ndarray  #: words counted in each class, and ends
    variety: np.ndarray  #: distinct words of each class
    total: int  #: N
    distinct: int  #: V

    def unknown(self) -> np.ndarray:
        """P(unknown word | class)."""
        return np.where(self.mass > 0, DISCOUNT * self.variety / np.maximum(self.mass, 1), 0.0)


def moves(table: np.ndarray, e: Emissions) -> np.ndarray:
    """log10 P(class | class before), by the one before; OTHER is the unknown word."""
    if not e.total:
        return np.zeros((STATES, STATES))
    t = table[:OTHER, :OTHER].astype(float)
    after = (t + ALPHA * t.sum(0) / t.sum()) / (t.sum(1, keepdims=True) + ALPHA)
    unknown = e.unknown()
    share = DISCOUNT * e.variety
    after = np.concatenate([after, (share / max(share.sum(), 1e-300) @ after)[None] if share.sum() else after[END:]])
    with np.errstate(divide="ignore"):
        return np.maximum(np.log10(np.concatenate([after, (after @ unknown)[:, None]], axis=1)), -30)


def _scored(sent):
    """Chunks with the classes and counts of their words as rows with their scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, e = sent.value
        for batch in batches:
            for k, chunk in enumerate(_chunks(batch)):
                own, n = _known(chunk, batch.column(7)[k])
                base = np.log10((n + 0.1) / (e.total + 0.1 * (e.distinct + 1)))
                emitted = np.where(own < END, np.log10(np.maximum(n - DISCOUNT, DISCOUNT) / np.maximum(e.mass[np.minimum(own, END)], 1)), 0.0)
                of = own[chunk.at]
                before = chunk.before(of, END)
                known, base, emitted, moved = (np.add.reduceat(x, chunk.starts[:-1]) for x in ((n > 0).astype(np.int64)[chunk.at], base[chunk.at], emitted[chunk.at], table[before, of]))
                yield pa.RecordBatch.from_arrays([chunk.ids, *[pa.array(x) for x in (np.diff(chunk.starts), known, base, moved + emitted)]], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return run


def _table(counted: DataFrame, size: int) -> np.ndarray:
    """Counts (k, n) of pairs of ``size`` kinds, added up."""
    out = np.zeros(size * size)
    for r in counted.groupBy("k").agg(F.sum("n").alias("n")).collect():
        out[r["k"]] = r["n"]
    return out.reshape(size, size)


def seed_classes(spark: SparkSession, encoded: DataFrame, seeds: int = SEEDS) -> Lookup:
    """Where the exchange begins: the most frequent words with their classes."""
    top = encoded.mapInArrow(_per_chunk(_proposed), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "k").limit(seeds).collect()
    keys = np.sort(np.array([r["k"] for r in top], np.int64).view(np.uint64))
    size = len(keys) + 2
    types = spark.sparkContext.broadcast(Lookup(keys, STATES + np.arange(len(keys))))
    bigrams = _table(encoded.mapInArrow(_per_chunk(_seed_pairs(types, size)), "k long, n long"), size)
    own = exchange(bigrams, STATES, alone=2)
    return Lookup(keys, own[: len(keys)])


class Clusters(NamedTuple):
    slices: DataFrame  #: what _settled() says of all words
    table: np.ndarray  #: class bigrams
    likelihoods: list[float]  #: after each round that is kept

    def words(self) -> DataFrame:
        return self.slices.filter("chunk < 0").select("classes", "n", "keys").mapInArrow(_listed, "k long, n long, class byte")


def _let_go(spark: SparkSession) -> None:
    """Shuffle files that nothing refers to any more go."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def likelihood(table: np.ndarray) -> float:
    """Of the class bigrams and the words given their classes, but for what no exchange changes."""
    return float(_f(table).sum() - _f(table.sum(0)).sum() - _f(table.sum(1)).sum())


def exchanged(spark: SparkSession, encoded: DataFrame, rounds: int | None = ROUNDS, seeds: int = SEEDS) -> Clusters:
    """Exchange of the whole vocabulary, in rounds until the likelihood rises no more, or ``rounds`` of them."""
    known = spark.sparkContext.broadcast(seed_classes(spark, encoded, seeds))
    size = encoded.agg(F.sum(F.octet_length("keys"))).first()[0] or 0
    slices = 1 + size // 8 // SLICE

    def counts(settled: DataFrame | None) -> tuple[DataFrame, np.ndarray]:
        bound = encoded if settled is None else bound_to(encoded, settled)
        out = shared.cut(spark, bound.mapInArrow(_counted(slices, known if settled is None else None), _COUNTS))
        del bound
        _let_go(spark)
        (row,) = out.filter("slice < 0").select("pairs").repartition(1).mapInArrow(_summed, "pairs binary").collect()
        return out, np.frombuffer(row["pairs"], np.int64).astype(float).reshape(STATES, STATES)

    def settle(counted: DataFrame, table: np.ndarray, share: float | None, salt: int) -> DataFrame:
        rows = counted.filter("slice >= 0").drop("pairs").repartition(min(slices, shared.partitions(spark)), "slice").sortWithinPartitions("slice")
        return shared.cut(spark, rows.mapInArrow(_settled(spark.sparkContext.broadcast((table, share, salt))), _SETTLED))

    kept, (counted, table) = None, counts(None)
    share, done, reached = FIRST_SHARE, 0, []
    while rounds is None or done < rounds:
        done += 1
        settled = settle(counted, table, share if reached else None, done)
        gc.collect()
        shared.drop(spark, counted)
        moved = settled.agg(F.sum("moved")).first()[0] or 0
        counted, now = counts(settled)
        value = likelihood(now)
        if reached and value < reached[-1]:  # words that moved together were in each other's way
            shared.drop(spark, counted)
            shared.drop(spark, settled)
            share /= 2
            counted, table = counts(kept)
            if share < LEAST_SHARE:
                break
            continue
        if kept is not None:
            shared.drop(spark, kept)
        kept, table = settled, now
        risen = value - reached[-1] if reached else np.inf
        reached.append(value)
        if not moved or risen < LEAST_RISE * now.sum():
            break
    final = settle(counted, table, 0.0, 0)
    shared.drop(spark, counted, *([] if kept is None else [kept]))
    return Clusters(final, table, reached)


def clustered(spark: SparkSession, encoded: DataFrame, rounds: int | None = 1, seeds: int = SEEDS) -> DataFrame:
    """(k, n, class) of every word that is learned from, and of the end; after one round all words have their places and none has moved on."""
    return exchanged(spark, encoded, rounds, seeds).words()


_COUNTS = "slice int, chunk long, keys binary, own binary, sizes binary, slots binary, n binary, pairs binary"
_COUNTS_NAMES = ["slice", "chunk", "keys", "own", "sizes", "slots", "n", "pairs"]
_SETTLED = "chunk long, slice int, classes binary, n binary, keys binary, moved long"


def emissions(vocabulary: DataFrame) -> Emissions:
    mass, variety = np.zeros(OTHER), np.zeros(OTHER)
    total = distinct = 0
    for r in vocabulary.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        mass[r["class"]], variety[r["class"]] = r["n"], 0 if r["class"] == END else r["v"]
        total, distinct = total + r["n"], distinct + r["v"]
    return Emissions(mass, variety, total, distinct)


def scored(spark: SparkSession, docs: DataFrame, rounds: int | None = ROUNDS, seeds: int = SEEDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), (~held_out()).alias("train"))
    encoded = shared.cut(spark, rows.mapInArrow(_encode, _ENCODED))
    found = exchanged(spark, encoded, rounds, seeds)
    e = emissions(found.words())
    sent = spark.sparkContext.broadcast((moves(found.table, e), e))
    out = bound_to(encoded, found.slices).mapInArrow(_scored(sent), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(e.total).cast("long").alias("train_tokens"), "base_score", "score")
