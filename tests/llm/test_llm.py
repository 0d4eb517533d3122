"""Operators of the llm subpackage against brute force, exact round trips and held-out accuracy."""

import base64
import bz2
import collections
import functools
import gzip
import hashlib
import lzma
import math
import os
import re
import time
import urllib.parse
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tesserine.llm import class_lm, decontamination, near_duplicates, packing, personal_data, quality_classifier, quality_rules, queries, resharding, secrets, shared, substrings
from tesserine.llm.word_ids import WordIds

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def split(text, lower=False):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW) if lower else text or "")


@pytest.fixture(scope="module")
def docs(spark):
    return shared.documents(spark, SF)


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def of_texts(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


# --- substring dedup


def remove_by_hand(texts, length):
    first, out = {}, {}
    for i in sorted(texts):
        w = split(texts[i])
        for j in range(len(w) - length + 1):
            first.setdefault(tuple(w[j : j + length]), i)
    for i, t in texts.items():
        w = split(t)
        gone = [False] * len(w)
        for j in range(len(w) - length + 1):
            if first[tuple(w[j : j + length])] < i:
                gone[j : j + length] = [True] * length
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


def test_substrings(spark, docs, texts):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substrings.remove_repeats(spark, docs, 50).collect()}
    assert got == remove_by_hand(texts, 50)


def test_substrings_salted_shards(spark, monkeypatch):
    """A passage in all documents, within and across shards of a few windows."""
    monkeypatch.setattr(substrings, "SHARD_WINDOWS", 3)
    monkeypatch.setattr(substrings, "STREAM_WINDOWS", 5)
    monkeypatch.setattr(substrings, "MOST_WINDOWS", 4)
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(400)]
    hot = " ".join(rng.choice(words, 30))
    texts = {i: " ".join([*rng.choice(words, 15), *([hot] if i % 2 else [hot, hot]), *rng.choice(words, int(rng.integers(0, 25)))]) for i in range(40)}
    texts[40] = texts[7]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substrings.remove_repeats(spark, of_texts(spark, list(texts.items())), 20).collect()}
    assert got == remove_by_hand(texts, 20)


def test_automaton_matches_all_substrings():
    rng = np.random.default_rng(2)
    texts = [[bytes([97 + c]) for c in rng.integers(0, 3, 30)] for _ in range(8)]
    a = substrings.Automaton()
    for doc, t in enumerate(texts):
        a.add(t, doc)
    for doc, t in enumerate(texts):
        seen = {tuple(u[i : i + 4]) for d, u in enumerate(texts) if d < doc for i in range(27)}
        hit = [False] * 30
        for i in range(27):
            if tuple(t[i : i + 4]) in seen:
                hit[i : i + 4] = [True] * 4
        got = [False] * 30
        for low, high in a.spans(t, doc, 4):
            got[low:high] = [True] * (high - low)
        assert got == hit


# --- near duplicates


def components_by_hand(sets, similarity=80):
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= similarity * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


def shingles(text, n):
    w = split(text, True)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def test_near_duplicates(spark, docs, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates.near_duplicates(spark, docs).collect()}
    sets = {i: shingles(t, 4) for i, t in texts.items()}
    parts = components_by_hand(sets)
    assert got == {i: (len(sets[i]), parts[i], parts[i] == i) for i in sets}


def test_rows_with_one_doc_id(spark):
    """As one document they link what either is linked with; apart, each text has its own group."""
    a, u = (" ".join(f"{x}{k}" for k in range(30)) for x in "au")
    rows = of_texts(spark, [(1, a), (5, a), (5, u), (7, u), (9, "alone")])
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates.near_duplicates(spark, rows).collect())
    assert got == [(1, 1, True), (5, 1, False), (5, 1, False), (7, 1, False), (9, 9, True)]
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates.near_duplicates(spark, rows, apart=True).collect())
    assert got == [(1, 1, True), (5, 1, False), (5, 5, True), (7, 5, False), (9, 9, True)]


@pytest.mark.parametrize("members", [near_duplicates.MEMBERS, 5])
def test_near_duplicates_in_families(spark, monkeypatch, members):
    """Edits of edits: centres miss links that the rest has to find; with few members a task, centres are dealt over several."""
    monkeypatch.setattr(near_duplicates, "MEMBERS", members)
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(3000)]
    rows, k = {}, 0
    for _ in range(4):
        base = list(rng.choice(words, 80))
        chain = [base]
        for _ in range(35):
            t = list(chain[int(rng.integers(len(chain)))])
            for _ in range(int(rng.integers(1, 4))):
                t[int(rng.integers(len(t)))] = str(rng.choice(words))
            chain.append(t)
        for t in chain:
            rows[k] = " ".join(t)
            k += 1
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates.near_duplicates(spark, of_texts(spark, list(rows.items()))).collect()}
    assert got == components_by_hand({i: shingles(t, 4) for i, t in rows.items()})


def test_sketch_estimates_and_fills():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 2**63, 300, dtype=np.uint64)
    b = np.concatenate([a[:240], rng.integers(0, 2**63, 60, dtype=np.uint64)])
    one = a[:1]
    s = near_duplicates.sketch(np.concatenate([a, b, one]), np.array([0, 300, 600, 601, 601]))
    assert (s[:3] != near_duplicates.EMPTY).all() and (s[3] == near_duplicates.EMPTY).all()
    assert abs((s[0] == s[1]).mean() - 240 / 360) < 0.15


# --- secrets


def test_base_secrets(texts):
    patterns = [r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"AKIA[A-Z0-9]+", r"[0-9a-f]+"]
    more = ["PassWord: abcdefghijkl, token=short", "AKIA1234567890ABCD AKIA123", "x" * 50 + "deadbeefdeadbeef0", "api_key='QWERTYUIOP12' APIKEY = zzzzzzzzzzzz"]
    for t in [*texts.values(), *more]:
        found = [[(m.start(), k, m.end()) for m in re.finditer(p, t or "") if len(m[1] if k == 0 else m[0]) >= least] for k, (p, least) in enumerate(zip(patterns, (12, 18, 16)))]
        assert secrets.secrets(t or "")[0] == sorted(sum(found, []))


def test_decoded_layers():
    s = 'password = "abcdefghijkl1234"'
    b = lambda x: base64.b64encode(x).decode()
    for e in (b(s.encode()), b(gzip.compress(s.encode())), b(b(s.encode()).encode()), urllib.parse.quote(b(zlib.compress(s.encode()))), "".join(f"\\u{ord(c):04x}" for c in s), urllib.parse.quote(urllib.parse.quote(s)), "".join(f"&#{ord(c)};" for c in s)):
        t = "à hello " + e + " and more"
        base, spans = secrets.secrets(t)
        assert not base and any(k == 0 and 8 <= a < z <= 8 + len(e) for a, k, z in spans), e
    assert secrets.secrets("%41" * 5 + "%zz%")[1] == []


def test_repeated_encoded_secrets():
    """Each place of the same encoded secret has its span, at any depth; a layer that holds itself ends."""
    s = 'password = "abcdefghijkl1234"'
    b = lambda x: base64.b64encode(x.encode()).decode()
    for e in (b(s), b(b(s)), b(f"one {b(s)} two {b(s)}"), urllib.parse.quote(f"{b(s)} ,")):
        t = f"{e} and\n{e}, {e}"
        base, spans = secrets.secrets(t)
        starts = [m.start() for m in re.finditer(re.escape(e), t)]
        assert not base and len(starts) == 3
        assert all(any(k == 0 and at <= a < z <= at + len(e) for a, k, z in spans) for at in starts), e
    assert [k for _, k, _ in secrets.secrets(f"{b(s)} {b('AKIA' + 'Z' * 16 + ' ' + b(s))}")[1]] == [0, 0, 1]


@pytest.mark.parametrize("pack", [gzip.compress, zlib.compress, bz2.compress, lzma.compress])
def test_compressed_layers_are_read_to_their_end(pack):
    """Secrets beyond 16 MB and across the ends of chunks, after characters of several bytes, plain or encoded again."""
    s = 'password = "abcdefghijkl1234"'
    for secret in (s, base64.b64encode(gzip.compress(s.encode())).decode(), urllib.parse.quote(s)):
        for fill in ("é, " * 4_400_000, "x\n" * (secrets.CHUNK // 2 - 8)):
            t = "see " + base64.b64encode(pack(f"{fill}{secret}\n{'é, ' * 700_000}".encode())).decode()
            assert secrets.secrets(t)[1] == [(4, 0, len(t.rstrip("=")) + t.count("="))]
    if pack is not zlib.compress:
        t = base64.b64encode(pack(b"first member, ") + pack(s.encode())).decode()
        assert [k for _, k, _ in secrets.secrets(t)[1]] == [0]


@pytest.mark.parametrize("pack", [gzip.compress, zlib.compress, bz2.compress, lzma.compress])
def test_what_was_compressed_again_is_unfolded(pack, monkeypatch):
    """Compressed layers in compressed layers, small and over a chunk, whatever bytes stand around a secret; a layer that unfolds to itself ends."""
    s = b'password = "abcdefghijkl1234"'
    noise = np.random.default_rng(3).integers(0, 256, secrets.CHUNK * 3 // 2, dtype=np.uint8).tobytes()
    kinds = lambda data: [k for _, k, _ in secrets.secrets(base64.b64encode(data).decode())[1]]
    for other in (gzip.compress, zlib.compress, bz2.compress, lzma.compress):
        assert kinds(pack(other(s))) == kinds(pack(other(pack(b64 := base64.b64encode(other(pack(s))))))) == [0], b64
    assert kinds(pack(pack(noise + b"\n" + s + b"\n" + noise))) == [0]
    assert kinds(pack(b"caf\xe9 \0\0\0\0" + s)) == kinds(b"caf\xe9 \0\0\0\0" + s) == kinds(b"x^2, " + s) == [0]
    assert kinds(pack(b"a member, ") + s) == [0]
    monkeypatch.setattr(secrets, "_chunks", lambda source: iter([source.read()]))
    assert kinds(pack(s)) in ([], [0])


def test_large_dictionaries_are_read():
    s = b'password = "abcdefghijkl1234"'
    assert [k for _, k, _ in secrets.secrets(base64.b64encode(lzma.compress(s, preset=9)).decode())[1]] == [0]


def test_cycles_of_layers_end(monkeypatch):
    monkeypatch.setattr(secrets, "_held", lambda data: ({data[0] % 3}, {bytes([(data[0] + 1) % 3])}))
    assert secrets._kinds({b"\x00"}) == {bytes([k]): {0, 1, 2} for k in range(3)}


# --- language model


def plain_score(words_of, train, class_of):
    """The model with dictionaries: classes of words are given, everything else is counted here."""
    c, pairs = collections.Counter(), collections.Counter()
    for i in train:
        c.update(words_of[i])
        kinds = [class_lm.END, *[class_of[x] for x in words_of[i]]]
        pairs.update(zip(kinds, kinds[1:]))
    mass, variety, into, out = (collections.Counter() for _ in range(4))
    for x, n in c.items():
        mass[class_of[x]] += n
        variety[class_of[x]] += x is not None
    for (a, b), n in pairs.items():
        out[a] += n
        into[b] += n
    total = sum(pairs.values())
    kinds = sorted(mass)

    def after(a, b):
        if a == "unknown":
            return sum(variety[x] * after(x, b) for x in kinds) / sum(variety.values())
        return (pairs[a, b] + class_lm.ALPHA * into[b] / total) / (out[a] + class_lm.ALPHA)

    @functools.lru_cache(None)
    def given(a, x):
        if x not in c:
            return sum(after(a, k) * class_lm.DISCOUNT * variety[k] / mass[k] for k in kinds)
        return after(a, class_of[x]) * (1 if x is None else (c[x] - class_lm.DISCOUNT) / mass[class_of[x]])

    def score(tokens):
        at, total = class_lm.END, 0.0
        for x in tokens:
            total += math.log10(given(at, x))
            at = class_of[x] if x in c else "unknown"
        return total

    return score, given, c


def word_classes(spark, docs, tokens, rounds=1):
    """The operator's classes by word."""
    rows = docs.select("doc_id", "text", (~class_lm.held_out()).alias("train"))
    found = {r["k"]: r["class"] for r in class_lm.clustered(spark, shared.cut(spark, rows.mapInArrow(class_lm._encode, class_lm._ENCODED)), rounds).collect()}
    out = {}
    for x in tokens:
        data = np.frombuffer((x or "").encode(), np.uint8)
        k = class_lm.END_KEY if x is None else int(class_lm.tokens(data, np.array([0, len(data)]))[0][0].view(np.int64))
        if k in found:
            out[x] = found[k]
    return out


@pytest.mark.parametrize("rounds", [1, 2])
def test_language_model(spark, docs, texts, rounds):
    got = {r["doc_id"]: r for r in class_lm.scored(spark, docs, rounds=rounds).collect()}
    w = {i: [*split(t, True), None] for i, t in texts.items()}
    train = [i for i in texts if zlib.crc32(str(i).encode()) % 10]
    class_of = word_classes(spark, docs, {x for i in train for x in w[i]}, rounds)
    score, _, c = plain_score(w, train, class_of)
    assert set(class_of) == set(c) and len(set(class_of.values())) > 20
    n, v = sum(c.values()), len(c)
    for i, r in got.items():
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i not in train, len(w[i]), sum(x in c for x in w[i]), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w[i]), rel_tol=1e-9)
        assert math.isclose(r["score"], score(w[i]), rel_tol=1e-9)
    for held in (False, True):
        rows = [r for r in got.values() if r["held_out"] == held]
        assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_chunks_are_hashed_in_small_steps(monkeypatch):
    """Whatever the size of a chunk, words are hashed a step at a time, as hashing takes far more memory than the text."""
    monkeypatch.setattr(class_lm, "TaskContext", type("", (), {"get": staticmethod(lambda: type("", (), {"partitionId": lambda self: 0})())}))
    texts, seen, tokens = [f"a b{i % 7} {'c ' * (i % 5)}" + "ddd " * 20_000 for i in range(20)], [], class_lm.tokens
    monkeypatch.setattr(class_lm, "tokens", lambda data, offsets: seen.append(len(data)) or tokens(data, offsets))
    batch = pa.RecordBatch.from_arrays([pa.array(range(20)), pa.array(texts), pa.array([True] * 20)], ["doc_id", "text", "train"])
    (chunk,) = [c for b in class_lm._encode(iter([batch])) for c in class_lm._chunks(b)]
    assert max(seen) <= shared.STEP_BYTES < sum(seen) < class_lm.CHUNK
    data, offsets = shared.text_buffers(batch.column(1))
    hashes, starts = tokens(data, offsets)
    assert (chunk.keys[chunk.at] == hashes).all() and (chunk.starts == starts).all()


def test_model_is_a_distribution(spark):
    """After every class and after the unknown word, all words, the end and the unknown word add to one."""
    rng = np.random.default_rng(5)
    docs = of_texts(spark, [(i, " ".join(rng.choice(["aa", "bb", "cc", "dd", "ee"], 30))) for i in range(20)])
    w = {r["doc_id"]: [*split(r["text"], True), None] for r in docs.collect()}
    train = [i for i in w if zlib.crc32(str(i).encode()) % 10]
    class_of = word_classes(spark, docs, {x for i in train for x in w[i]})
    _, given, c = plain_score(w, train, class_of)
    for a in {*class_of.values(), "unknown"}:
        assert math.isclose(sum(given(a, x) for x in c) + given(a, "zz"), 1, rel_tol=1e-9)
    table = class_lm.moves(np.ones((class_lm.STATES, class_lm.STATES)), class_lm.Emissions(np.full(class_lm.OTHER, 10.0), np.full(class_lm.OTHER, 2.0), 480, 94))
    assert np.allclose((10 ** table[:, : class_lm.OTHER]).sum(axis=1), 1)


def test_gains_are_those_of_the_likelihood():
    """The gain of each word and class is what the likelihood of the bigrams rises by if that word alone moves."""
    rng = np.random.default_rng(8)
    size, rows = 40, 300
    text = [rng.integers(0, size, 12) for _ in range(rows)]
    own = np.append(np.arange(size) % 5 + np.where(np.arange(size) % 11 == 0, 3, 0), class_lm.END)
    b = np.zeros((size + 1, size + 1))
    for t in text:
        t = np.concatenate([[size], np.where(rng.random(12) < 0.2, 7, t), [size]])
        np.add.at(b, (t[:-1], t[1:]), 1)

    def table(of):
        m = np.eye(class_lm.STATES)[of]
        return m.T @ b @ m

    m = np.eye(class_lm.STATES)[own]
    counts = np.concatenate([b.T @ m, b @ m, np.diag(b)[:, None]], axis=1)[:size]
    word, slot = np.nonzero(counts)
    got = class_lm.gains(word, slot, counts[word, slot].astype(np.int64), own[:size], table(own))
    before = class_lm.likelihood(table(own))
    for w in range(size):
        for c in (0, 1, 4, 6, 20):
            to = own.copy()
            to[w] = c
            assert math.isclose(got[w, c], class_lm.likelihood(table(to)) - before, rel_tol=1e-9, abs_tol=1e-6)


def test_every_word_is_exchanged(spark):
    """Seeds that a first assignment put wrong, and all words beside them, go on moving until the likelihood rises no more."""
    rng = np.random.default_rng(14)
    texts = [(i, " ".join(f"{'abc'[j % 3]}{int(rng.zipf(1.3)) % 400}" for j in range(90))) for i in range(150)]
    encoded = shared.cut(spark, of_texts(spark, texts).withColumn("train", F.lit(True)).mapInArrow(class_lm._encode, class_lm._ENCODED))
    once, found = (class_lm.exchanged(spark, encoded, rounds, seeds=12) for rounds in (1, None))
    assert found.likelihoods == sorted(found.likelihoods) and len(found.likelihoods) > 1
    assert found.likelihoods[0] == once.likelihoods[0] < found.likelihoods[-1] == class_lm.likelihood(found.table)
    assert {r["k"] for r in found.words().collect()} == {r["k"] for r in once.words().collect()}


def test_rare_words_join_the_class_of_words_used_alike(spark):
    """Two kinds of words alternate; words of one occurrence, far too rare to be seeds, are told apart by their neighbours."""
    rng = np.random.default_rng(13)
    rows, kind = [], {}
    for i in range(120):
        t = []
        for j in range(60):
            name = f"{'ab'[j % 2]}{rng.integers(20)}" if rng.random() < 0.9 else f"{rng.choice(['x', 'y'])}{i}q{j}"
            kind[name] = j % 2
            t.append(name)
        rows.append((i, " ".join(t)))
    docs = of_texts(spark, rows)
    encoded = shared.cut(spark, docs.select("doc_id", "text", F.lit(True).alias("train")).mapInArrow(class_lm._encode, class_lm._ENCODED))
    of = {r["k"]: r["class"] for r in class_lm.clustered(spark, encoded, seeds=40).collect()}
    key = {x: int(class_lm.tokens(np.frombuffer(x.encode(), np.uint8), np.array([0, len(x)]))[0][0].view(np.int64)) for x in kind}
    seeds = [collections.Counter(of[key[x]] for x in kind if x[0] in "ab" and kind[x] == b) for b in (0, 1)]
    assert not set(seeds[0]) & set(seeds[1])
    rare = [x for x in kind if x[0] in "xy"]
    assert len(rare) > 500 and sum(of[key[x]] in seeds[kind[x]] for x in rare) > 0.95 * len(rare)


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(6)
    kind = rng.integers(0, 3, 31)
    b = rng.poisson(np.where((kind[:, None] + 1) % 3 == kind[None, :], 20, 1)).astype(float)
    own = class_lm.exchange(b, 4)

    def likelihood(of):
        m = np.eye(4)[of]
        t = m.T @ b @ m
        f = lambda x: (x[x > 0] * np.log(x[x > 0])).sum()
        return f(t) - f(t.sum(0)) - f(t.sum(1))

    start = np.append(np.arange(30) % 3, 3)
    assert likelihood(own) > likelihood(start) and len(set(zip(own[:-1], kind[:-1]))) == 3


# --- packing


def test_packing(spark, docs, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = packing.packed(spark, docs, path).collect()
    ids = {i: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for i, t in texts.items()}
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted((i, p, p * 4096, len(x[p * 4096 : p * 4096 + 4096]), zlib.crc32(x[p * 4096 : p * 4096 + 4096].tobytes())) for i, x in ids.items() for p in range(-(-len(x) // 4096)))
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by) <= 1.002 * -(-sum(map(len, ids.values())) // 4096) + 2
    whole = packing.sequences(spark, docs, path).collect()
    assert sum(len(r["ids"]) for r in whole) == sum(map(len, ids.values())) and len(whole) == len(by)


def test_odd_words_have_the_tokenizers_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, ours = Tokenizer.from_file(path), WordIds(path, 1)
    for t in ("don't CAN'T it's", "a\x1cb a\xa0b x​y", "<|endoftext|>x y<|startoftext|>", "ÉCOLE école école ñandú, straße.", "İstanbul ẞ ΣΑΣ", "日本語 テスト 12ab34 !!??", "…“quoted”—dash", "ª º µ ß"):
        data = np.frombuffer(t.encode(), np.uint8)
        got, _ = ours.batch(data, np.array([0, len(data)]))
        assert got.tolist() == tokenizer.encode(t, add_special_tokens=False).ids + [1], t


def test_rounds_give_each_piece_the_smallest_free_gap(spark, monkeypatch):
    """One round, cut into ranges of a few rows, against a plain loop from the longest piece down; then all rounds against the least number of sequences."""
    rng = np.random.default_rng(7)
    monkeypatch.setattr(packing, "RANGE_ROWS", 20)
    lengths, sizes = [int(x) for x in rng.integers(1, 60, 120)], [int(x) for x in rng.integers(1, 64, 80)]
    left = spark.createDataFrame(list(enumerate(lengths)), "id long, length long")
    gaps = spark.createDataFrame(list(enumerate(sizes)), "seq long, gap long")
    matched, rest = packing.sweep(spark, left, gaps, max(lengths), 200)
    got = [(lengths[r["id"]], sizes[r["seq"]]) for r in matched.collect()]
    free, by_hand, over = sorted(sizes), [], []
    for x in sorted(lengths, reverse=True):
        fits = [g for g in free if g >= x]
        if fits:
            free.remove(fits[0])
            by_hand.append((x, fits[0]))
        else:
            over.append(x)
    assert sorted(got) == sorted(by_hand) and sorted(r["length"] for r in rest.collect()) == sorted(over)


def test_places_between_ranges():
    plan, used = packing.between([(0, 0, 3), (1, 2, 2), (2, 4, 0), (3, 1, 5)])
    # range 1 takes two of range 0's places, its own two and the last of range 0 go to range 2, which keeps one piece
    assert plan == [(1, 0, 2, 0, 0), (2, 0, 2, 1, 0), (2, 2, 3, 0, 0)] and used == [(0, 3), (1, 2)]


def test_many_small_pieces_after_long_ones(spark, monkeypatch):
    """Pieces of one token fill the gaps in a few rounds, many to a gap."""
    rounds = []
    real = packing.sweep
    monkeypatch.setattr(packing, "sweep", lambda *x: rounds.append(1) or real(*x))
    monkeypatch.setattr(packing, "pieces", lambda docs, path, size: docs.select("doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), "length", F.lit(0).cast("long").alias("ids_crc32")))
    rows = packing.packed(spark, spark.createDataFrame([(i, 3000 if i < 60 else 1) for i in range(60_000)], "doc_id long, length long"), "").collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    assert len(rows) == 60_000 and len(by) == 60 and len(rounds) <= 8
    for places in by.values():
        assert all(b[0] == a[0] + a[1] for a, b in zip(sorted(places), sorted(places)[1:])) and sum(n for _, n in places) <= 4096


# --- sharding


def test_resharding(spark, docs, texts):
    rows = queries.op6_sharding(spark, SF).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {i: (len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts.items()} and len(rows) == len(texts)
    slots, load = collections.defaultdict(list), collections.Counter()
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(40))


def test_flow_moves_the_fewest_bytes():
    rng = np.random.default_rng(8)
    for _ in range(20):
        n, m = int(rng.integers(1, 6)), int(rng.integers(1, 6))
        supply = [int(x) for x in rng.integers(0, 50, n)]
        capacity = [sum(supply) * (j + 1) // m - sum(supply) * j // m for j in range(m)]
        flows = resharding.least_moves(supply, capacity)
        assert [sum(f for i, _, f in flows if i == k) for k in range(n)] == supply and [sum(f for _, j, f in flows if j == k) for k in range(m)] == capacity
        assert sum(f for i, j, f in flows if i != j) == sum(supply) - sum(min(s, c) for s, c in zip(supply, capacity))


def test_rewrite_keeps_unchanged_shards_and_repeated_rows(spark, tmp_path):
    old = [(1, "a" * 50, 0), (1, "a" * 50, 0), (2, "b" * 40, 0), (3, "c" * 30, 1), (None, None, 2), (None, None, 2), (5, "e", 4)]
    path = f"file://{tmp_path}/layout"
    spark.createDataFrame(old, "doc_id long, text string, shard int").write.partitionBy("shard").parquet(path)
    before = {f for f in os.listdir(tmp_path / "layout/shard=1") if f.endswith(".parquet")}
    # shard 1 stays, 4 has no rows any more, copies of one row go to two shards
    goes = [(1, 0, 0), (1, 0, 2), (2, 0, 0), (3, 1, 1), (None, 2, 0), (None, 2, 2), (5, 4, 2)]
    text = {i: t for i, t, _ in old}
    placed = spark.createDataFrame([(i, zlib.crc32((text[i] or "").encode()), o, j) for i, o, j in goes], "doc_id long, text_crc32 long, old_shard int, shard int")
    from pyspark.sql import functions as F

    resharding.rewrite(spark, spark.read.parquet(path), placed, path, {1}, F.col("shard"))
    spark.catalog.refreshByPath(path)
    got = sorted(((r["doc_id"], r["text"], r["shard"]) for r in spark.read.parquet(path).collect()), key=str)
    assert got == sorted(((i, text[i], j) for i, _, j in goes), key=str)
    assert {f for f in os.listdir(tmp_path / "layout/shard=1") if f.endswith(".parquet")} == before and not (tmp_path / "layout/shard=4").exists()


def test_rewrite(spark, docs, tmp_path):
    placed = resharding.resharded(spark, docs, shared_old(), 4, 5)
    resharding.rewrite(spark, docs, placed, f"file://{tmp_path}/out")
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert back.count() == docs.count() and back.select("shard").distinct().count() == 5
    assert resharding.untouched(placed).count() <= 5


def shared_old():
    from pyspark.sql import functions as F

    return F.expr("pmod(doc_id, 4)")


# --- quality rules, classifier


def test_quality_rules_equal_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    ours = queries.op7_quality_rules(spark, SF)
    theirs = con.execute(quality_rules.sql())
    columns = [c[0] for c in theirs.description]
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in ours.collect()))) == sorted(map(repr, theirs.fetchall()))


@pytest.mark.parametrize("bits", [24, 31, 3, 61])
def test_repeated_windows(spark, bits):
    """Whatever is left of the hash beside the places, windows that come twice are all found."""
    rng = np.random.default_rng(5)
    rows = [(k, " ".join(rng.choice(list("abcdefgh"), n))) for k, n in enumerate([0, 1, 2, 3, 4, 5, 6, 7, 9, 12, 20, 60, 200, 400])]
    rows += [(100, " ".join(f"w{i}" for i in range(300))), (101, "a b c " * 40), (102, " ".join([*map(str, range(50)), *map(str, range(25))]))]
    df = of_texts(spark, rows).withColumn("words", F.expr("filter(split(text, ' '), x -> x <> '')"))
    got = {r["doc_id"]: r["n"] for r in df.selectExpr("doc_id", f"{quality_rules.repeated(bits)} as n").collect()}
    for k, text in rows:
        w = text.split()
        at = {}
        for i in range(len(w) - 2):
            at.setdefault(tuple(w[i : i + 3]), []).append(i)
        assert got[k] == len({i + j for places in at.values() if len(places) > 1 for i in places for j in range(3)})


def test_quality_rules_against_labels(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality_rules.judged(spark, docs).withColumnRenamed("quality", "p").join(labels, "doc_id").collect()
    assert all(r["kept"] == (r["quality"] == 1 and not r["base_failed"]) for r in rows)


def test_classifier_on_held_out_rows(spark):
    d = SF.replace("0.001", "0.01")
    rows = queries.op8_quality_classifier(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.97 * len(rows)


def test_attention_gradients():
    """The attention is a distribution over each document's passages, and training lowers the loss."""
    rng = np.random.default_rng(9)
    starts = np.array([0, 3, 4, 9, 12, 14])
    f, y = rng.normal(size=(14, quality_classifier.FEATURES)), np.array([1.0, 0, 1, 0, 1])
    model = quality_classifier.fit(f, starts, y)
    p, alpha = quality_classifier.score(model, f, starts)
    assert np.allclose(np.add.reduceat(alpha, starts[:-1]), 1) and ((p > 0.5) == y).all()


# --- personal data


def personal_by_hand(t):
    found = []
    for kind, p in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t):
            digits = re.sub("[^0-9]", "", m[0])
            double = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
            ok = (True, kind != 1 or all(int(x) <= 255 for x in m[0].split(".")), 12 <= len(digits) <= 19 and sum(x - 9 * (x > 9) for x in double) % 10 == 0, 9 <= len(digits) <= 15)[kind]
            if ok:
                found.append((m.start(), kind, m.end()))
    return sorted(found)


def test_personal_data(spark, texts):
    more = ["x@y.z_q@r.s a.b@c-d.e.f", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.255", "+1 (017) 555-7713 +123456789- 4539 1488 0343 6467 4111-1111-1111-1111x", "é" * 10 + " a@b.cd", "a" * 5000 + "@b.c", "+1" * 50, "1 " * 3000, "@@ +", ""]
    rows = [*texts.items(), *((10_000 + i, t) for i, t in enumerate(more)), (20_000, None)]
    got = {r["doc_id"]: [(x["start"], x["kind"], x["end"]) for x in r["base"]] for r in personal_data.personal_spans(spark, of_texts(spark, rows)).collect()}
    assert got == {i: personal_by_hand(t or "") for i, t in rows}


def test_redaction(spark, docs):
    rows = docs.filter("text rlike '@'")
    out = personal_data.redacted(spark, rows)
    assert out.columns == docs.columns
    for r in out.collect():
        assert "@" not in r["text"] and "<email>" in r["text"] and r["n_chars"] == len(r["text"])


def test_overlapping_spans_are_redacted_as_one(spark):
    """Against slices of the text, over several pieces of it."""
    rng = np.random.default_rng(14)
    text = "".join(rng.choice(list("ab é日\U0001f600\n"), 5000))
    spans = sorted((int(a), 0, int(a + n)) for a, n in zip(rng.integers(0, 4990, 60), rng.integers(1, 9, 60)))
    out, at = "", 0
    for a, _, b in spans:
        if a >= at:
            out += text[at:a] + "<email>"
        at = max(at, b)
    out += text[at:]
    row = spark.createDataFrame([(text, [(*x, "") for x in spans])], "text string, found array<struct<start:int,kind:int,end:int,s:string>>")
    assert row.select(F.expr(personal_data._REDACTED).alias("x")).first()["x"] == out


def test_candidates_meet_spans(spark):
    rng = np.random.default_rng(15)

    def some(n, kind):
        return sorted((int(a), kind, int(a + k)) for a, k in zip(rng.integers(0, 4000, n), rng.integers(1, 9, n)))

    base, wide = some(600, 0), some(700, 4)
    kind = "array<struct<start:int,kind:int,end:int>>"
    got = spark.createDataFrame([(base, wide), ([], wide), (base, [])], f"base {kind}, wide {kind}").select(F.expr(personal_data._meets("base")).alias("x")).collect()
    assert got[0]["x"] == [any(b[0] < c[2] and c[0] < b[2] for b in base) for c in wide] and not any(got[1]["x"]) and got[2]["x"] == []


def test_added_spans(spark):
    """Spelt-out addresses and numbers without their plus are found; order numbers, long hexadecimal numbers and sentences aren't."""
    rng = np.random.default_rng(16)

    def card(ok):
        d = [int(x) for x in rng.integers(1, 10, 15)]
        c = -sum(x * 2 - 9 * (x > 4) if k % 2 == 0 else x for k, x in enumerate(reversed(d))) % 10
        return "".join(map(str, d)) + str(c if ok else (c + 3) % 10)

    rows = []
    for i in range(300):
        said = [f"write to u{i}@mail{i % 7}.example.com or", f"call +1 ({rng.integers(100, 999)}) 555-{rng.integers(1000, 9999)} at", f"from 10.{i % 256}.3.4 with", f"card {card(True)} and", f"order {card(False)} or", f"key {rng.integers(0, 2**60):x}{i}f{rng.integers(10**7, 10**8)}c now"]
        rows.append((i, " ".join(rng.permutation(said))))
    odd = [(1000, "ask jane.roe (at) mail (dot) example (dot) com please"), (1001, "or (617) 555-0134 today"), (1002, f"order {card(False)} came"), (1003, "we met @ home. Then left"), (1004, "token a12345678b9012345678c")]
    got = {r["doc_id"]: [x["s"] for x in r["found"]] for r in personal_data.personal_spans(spark, of_texts(spark, rows + odd)).collect()}
    assert got[1000] == ["jane.roe (at) mail (dot) example (dot) com"] and got[1001] == ["(617) 555-0134"]
    assert got[1002] == got[1003] == got[1004] == []
    assert all(len(got[i]) == 4 for i, _ in rows)


def test_texts_with_many_matches(spark):
    t = " ".join(f"+1 (017) 555-{k % 10000:04d} or 1234567 u{k}@b.cd" for k in range(10_000))
    began = time.time()
    r = personal_data.personal_spans(spark, of_texts(spark, [(1, t)])).first()
    assert len(r["base"]) == 20_000 and [(x["start"], x["kind"], x["end"]) for x in r["base"]] == personal_by_hand(t)
    assert time.time() - began < 60  # seconds; it was minutes when every match copied those before it
    out = personal_data.redacted(spark, of_texts(spark, [(1, t)])).first()["text"]
    assert out.count("<phone>") == out.count("<email>") == 10_000


def test_boosting_learns():
    x = np.array([[a, b] for a in range(4) for b in range(4)])
    n, hits = np.full(16, 50.0), np.where((x[:, 0] > 1) & (x[:, 1] < 2), 45.0, 3.0)
    score = personal_data.values(personal_data.boost(x, n, hits), x)
    a, b = personal_data.platt(score, n, hits)
    assert np.allclose(1 / (1 + np.exp(-(a * score + b))), hits / n, atol=0.1)


# --- decontamination


def test_decontamination_finds_verbatim_and_edited(spark, docs, texts):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r["item_id"]: r["text"] for r in benchmark.collect()}
    rng = np.random.default_rng(10)
    clean = "no test item stands in here at all " * 20
    edited = {}
    for k, (i, t) in enumerate(items.items()):
        w = t.split()
        for j in rng.choice(len(w), max(1, len(w) // 7), replace=False):
            w[j] = "changed"
        edited[10_000 + k] = (i, f"{clean} {' '.join(w)} {clean}")
    rows = of_texts(spark, [*texts.items(), *((d, t) for d, (_, t) in edited.items()), (20_000, clean)])
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(spark, rows, benchmark).collect()}
    assert {(d, i) for d, (i, _) in edited.items()} <= got
    assert {(d, i) for d, t in texts.items() for i, u in items.items() if u in (t or "")} <= got
    assert not any(d == 20_000 for d, _ in got)


def test_decontamination_finds_an_edited_copy_in_many_documents(spark):
    words = [f"w{k}" for k in range(38)]
    copy = " ".join("changed" if k % 7 == 6 else x for k, x in enumerate(words))  # 20 of 35 seeds hold a change
    rows = [(d, f"a{d} b{d} {copy} c{d} d{d}") for d in range(80)]
    benchmark = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    got = {r["doc_id"]: (r["score"], r["n_matches"]) for r in decontamination.contaminated(spark, of_texts(spark, rows), benchmark).collect()}
    assert got == {d: ((2 * 33 - 5) / 76, 33) for d in range(80)}


def test_long_passages_are_aligned_in_pieces():
    """Equal to one alignment of the whole, and the bound is never below it."""
    rng = np.random.default_rng(12)
    for _ in range(30):
        item = rng.integers(0, 30, 8)
        passage = rng.integers(0, 30, 600)
        at = int(rng.integers(0, 580))
        passage[at : at + 8] = item
        passage[at + 3] = 99
        tiles = list(decontamination._tiles(0, 600, 8, 0.5))
        best = max(decontamination.align(item, passage[a:b])[0] for a, b in tiles)
        assert len(tiles) > 1 and best == decontamination.align(item, passage)[0]
        assert all(decontamination._bound(item, passage[a:b]) >= decontamination.align(item, passage[a:b])[0] for a, b in tiles)


def test_alignment_equals_plain_smith_waterman():
    rng = np.random.default_rng(11)
    for _ in range(30):
        a, b = rng.integers(0, 6, int(rng.integers(1, 12))), rng.integers(0, 6, int(rng.integers(1, 25)))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        best, matches, start, end = decontamination.align(a, b)
        assert best == h.max() and (best == 0 or 0 <= start < end <= len(b)) and matches <= len(a)


def test_hash_of_kept_words(spark, texts):
    by_hand = {i: hashlib.sha256(t.encode()).hexdigest() for i, (_, _, t) in remove_by_hand(texts, 50).items()}
    assert {r["doc_id"]: r["kept_sha256"] for r in queries.op2_substring_dedup(spark, SF).collect()} == by_hand


def test_substrings_of_rows_with_one_doc_id(spark):
    """Each row loses what it repeats itself; the other's places say nothing about it."""
    a, u, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "aub")
    rows = [(1, a), (2, a), (2, u), (2, f"{b} {a}"), (3, u)]
    got = sorted((r["doc_id"], r["kept_text"]) for r in substrings.remove_repeats(spark, of_texts(spark, rows), 50).collect())
    assert got == sorted([(1, a), (2, ""), (2, u), (2, b), (3, "")])


def shuffled(spark):
    """The shuffle files that stand in a local session."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f for d in manager.localDirs() for f in Path(d.getPath()).rglob("shuffle_*.data")}


def cut_and_look(spark, df, cut=shared.cut):
    """shared.cut(), after which no shuffle file of its own stands; nobody collects garbage here."""
    before = shuffled(spark)
    out = cut(spark, df)
    until = time.time() + 5
    while (left := shuffled(spark) - before) and time.time() < until:
        time.sleep(0.05)
    assert not left
    return out


def test_substrings_leave_no_tables_and_shuffle_files(spark, docs, monkeypatch):
    folder = Path(shared.shared_folder(spark).removeprefix("file://")) / "tesserine"
    before = {p.name for p in folder.iterdir()} if folder.exists() else set()
    monkeypatch.setattr(shared, "cut", cut_and_look)
    rows = substrings.remove_repeats(spark, docs, 50)
    assert len({p.name for p in folder.iterdir()} - before) == 1  # the spans, which the rows are joined with
    assert rows.count() == docs.count()


def test_exchange_leaves_no_shuffle_files(spark, docs, monkeypatch):
    """What a step of a round shuffles goes before the next writes; in the end the words' places stand alone beside the chunks."""
    folder = Path(shared.shared_folder(spark).removeprefix("file://")) / "tesserine"
    encoded = shared.cut(spark, docs.select("doc_id", "text", F.lit(True).alias("train")).mapInArrow(class_lm._encode, class_lm._ENCODED))
    before = {p.name for p in folder.iterdir()}
    monkeypatch.setattr(shared, "cut", cut_and_look)
    found = class_lm.exchanged(spark, encoded, 2, 20)
    assert {p.name for p in folder.iterdir()} - before == {found.slices._written.getName()}
