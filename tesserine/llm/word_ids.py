"""Token ids of texts under a byte-level BPE with word ends, for whole batches at once.

The vocabulary's rules: NFC, lower case, then pre-tokens, which are runs of letters,
single digits, runs of other characters, and a few endings after an apostrophe. A
pre-token's bytes are merged pair by pair, always the pair of least rank and of those
the leftmost.

Texts of ASCII and of the letters of Latin-1 are cut into pre-tokens with array
operations. A word with anything else (an apostrophe, other scripts, control
characters, what may be a special token) is one segment and goes to the tokenizer
itself. Segments are looked up by their hashes among those that the task knows; new
ones of up to LONGEST bytes are merged together, a matrix of symbols for each number
of symbols, so that a merge of all of them is one step.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np

from tesserine.llm.words import BREAK, BYTE_CODE, U, mix, powers

#: Segments that a task remembers at most, and bytes of those that are merged in matrices.
MOST_SEGMENTS, LONGEST = 1_000_000, 40
NONE = np.int32(2**31 - 1)

_LETTER, _DIGIT, _OTHER = 1, 2, 3
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[BREAK] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes that array operations don't cut: control characters, the apostrophe, and of those from 128 on all but 0xC3 and what may follow it.
_ODD = np.zeros(256, bool)
_ODD[:32] = True
_ODD[[39, 127]] = True
_ODD[192:] = True
_ODD[195] = False
_ODD[BREAK] = False
_FOLLOWS = (np.arange(256) >= 128) & (np.arange(256) < 192) & ~np.isin(np.arange(256), (0x97, 0xB7))
_CAPITAL = (np.arange(256) >= 128) & (np.arange(256) < 0x9F)


def byte_letters() -> list[str]:
    """Byte-level vocabularies write each byte as a letter: printable ones as themselves, the others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Merges:
    """The vocabulary's pairs as sorted keys."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        ids, end = model["vocab"], model["end_of_word_suffix"]
        letters = byte_letters()
        self.inner = np.array([ids[x] for x in letters], np.int32)
        self.last = np.array([ids[x + end] for x in letters], np.int32)
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int32)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs; NONE for those that aren't merged."""
        keys = a.astype(np.int64) << 32 | b
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, self.ranks[at], NONE)

    def merged(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of segments of bytes, one after the other, and how many each has."""
        n = np.zeros(len(starts), np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        none = np.zeros(0, np.int64)
        rows, symbols, ranks = none, np.zeros((0, 0), np.int32), np.zeros((0, 0), np.int32)
        for size in range(int(sizes.max(initial=0)), 0, -1):
            new = np.flatnonzero(sizes == size)
            raw = data[starts[new][:, None] + np.arange(size)]
            fresh = self.inner[raw]
            fresh[:, -1] = self.last[raw[:, -1]]
            if len(rows):
                symbols = np.concatenate([symbols, fresh])
                ranks = np.concatenate([ranks, self.rank(fresh[:, :-1], fresh[:, 1:])])
                rows = np.concatenate([rows, new])
            else:
                rows, symbols, ranks = new, fresh, self.rank(fresh[:, :-1], fresh[:, 1:])
            if not len(rows):
                continue
            if size == 1:
                n[rows] = 1
                done.append((rows, symbols))
                break
            at = ranks.argmin(axis=1)
            each = np.arange(len(rows))
            best = ranks[each, at]
            ends = best == NONE
            n[rows[ends]] = size
            done.append((rows[ends], symbols[ends]))
            go = ~ends
            rows, symbols, ranks, at, best = rows[go], symbols[go], ranks[go], at[go], best[go]
            each = np.arange(len(rows))
            symbols[each, at] = self.made[best]
            place = np.arange(size - 1)
            symbols = np.take_along_axis(symbols, place + (place > at[:, None]), axis=1)
            if size > 2:
                place = place[:-1]
                ranks = np.take_along_axis(ranks, place + (place >= at[:, None]), axis=1)
                left, right = at > 0, at < size - 2
                i, j = each[left], at[left]
                ranks[i, j - 1] = self.rank(symbols[i, j - 1], symbols[i, j])
                i, j = each[right], at[right]
                ranks[i, j] = self.rank(symbols[i, j], symbols[i, j + 1])
            else:
                ranks = np.zeros((len(rows), 0), np.int32)
        begin = np.concatenate([[0], np.cumsum(n)])
        out = np.zeros(begin[-1], np.uint32)
        for which, ids in done:
            if len(which):
                out[begin[which][:, None] + np.arange(ids.shape[1])] = ids
        return out, n


class WordIds:
    """Token ids of rows of text, segments remembered by their hashes."""

    def __init__(self, path: str, end_id: int) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.merges, self.end_id = Tokenizer.from_file(path), Merges(path), end_id
        self.letters = byte_letters()
        self.clear()

    def clear(self) -> None:
        self.keys, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids = np.array([self.end_id], np.uint32)  # entry 0 is the end of a text
        self.start, self.size = np.zeros(1, np.int64), np.ones(1, np.int64)

    def _of(self, segment: bytes, whole: bool) -> list[int]:
        if whole:
            return self.tokenizer.encode(unicodedata.normalize("NFC", segment.decode("utf-8", "replace")), add_special_tokens=False).ids
        return [x.id for x in self.tokenizer.model.tokenize("".join(self.letters[b] for b in segment))]

    def _learn(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, whole: np.ndarray) -> None:
        """Adds new segments, given by their sorted hashes."""
        sizes = ends - starts
        short = ~whole & (sizes <= LONGEST)
        ids, n = self.merges.merged(data, starts[short], sizes[short])
        count = np.zeros(len(keys), np.int64)
        count[short] = n
        others = [self._of(data[a:b].tobytes(), w) for a, b, w in zip(starts[~short].tolist(), ends[~short].tolist(), whole[~short].tolist())]
        count[~short] = [len(x) for x in others]
        begin = np.zeros(len(keys), np.int64)
        begin[short] = np.cumsum(n) - n
        begin[~short] = len(ids) + np.cumsum(count[~short]) - count[~short]
        place = len(self.start) + np.arange(len(keys))
        self.start, self.size = np.concatenate([self.start, len(self.ids) + begin]), np.concatenate([self.size, count])
        self.ids = np.concatenate([self.ids, ids, np.array([i for x in others for i in x], np.uint32)])
        at = np.searchsorted(self.keys, keys)
        self.keys, self.place = np.insert(self.keys, at, keys), np.insert(self.place, at, place)

    def batch(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of rows of text, each row's with the end id last, and where each row begins."""
        if len(self.keys) > MOST_SEGMENTS:
            self.clear()
        lower, starts, ends, whole = segments(data, offsets)
        rows = np.searchsorted(starts, offsets)
        up, down = powers(len(data) + 1)
        sums = np.empty(len(data) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(BYTE_CODE[lower] * up[: len(data)], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * down[starts] + ((ends - starts) * 2 + whole).astype(np.uint64))
        known, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, known)
        at[at == len(self.keys)] = 0
        new = self.keys[at] != known if len(self.keys) else np.ones(len(known), bool)
        if new.any():
            f = first[new]
            self._learn(known[new], lower, starts[f], ends[f], whole[f])
            at = np.searchsorted(self.keys, known)
        n = len(offsets) - 1
        entry = np.zeros(len(starts) + n, np.int64)
        if len(starts):
            entry[np.arange(len(starts)) + np.repeat(np.arange(n), np.diff(rows))] = self.place[at][back]
        size = self.size[entry]
        begin = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.arange(begin[-1]) + np.repeat(self.start[entry] - begin[:-1], size)]
        return ids, begin[rows + np.arange(n + 1)]


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes in lower case, the segments' first bytes and ends, and which are whole words for the tokenizer (their bytes stay as they are)."""
    size = len(data)
    none = np.zeros(0, np.int64)
    if not size:
        return data, none, none, none.astype(bool)
    kind = _KIND[data]
    odd = _ODD[data]
    lead = np.zeros(size, bool)
    lead[1:] = data[:-1] == 0xC3
    high = (data >= 128) & (data < 192)
    if high.any():
        odd |= high & ~(lead & _FOLLOWS[data])
    odd[:-1] |= (data[:-1] == 60) & (data[1:] == 124)  # a special token may begin with <|
    cut = np.zeros(size + 1, bool)
    cut[offsets] = True
    word = kind > 0
    first = word.copy()
    first[1:] &= ~word[:-1] | cut[1:-1]
    starts = np.flatnonzero(first)
    last = word.copy()
    last[:-1] &= ~word[1:] | cut[1:-1]
    ends = np.flatnonzero(last) + 1
    if not len(starts):
        return data, none, none, none.astype(bool)
    odds = np.concatenate([[0], np.cumsum(odd, dtype=np.int64)])
    slow = odds[ends] > odds[starts]
    inside = np.zeros(size + 1, np.int8)
    inside[starts[slow]] += 1
    inside[ends[slow]] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
    lower = _LOWER[data]
    if high.any():
        lower[lead & _CAPITAL[data] & (data != 0x97)] += 32
    lower = np.where(inside, data, lower)
    begins = first
    begins[1:] |= word[1:] & ~inside[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT))
    starts = np.flatnonzero(begins)
    stops = last
    stops[:-1] |= begins[1:] & word[:-1]
    return lower, starts, np.flatnonzero(stops) + 1, inside[starts]
