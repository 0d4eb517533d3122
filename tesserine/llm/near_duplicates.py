"""Near duplicates by fast similarity sketching, banding and exact verification.

Each text becomes its set of word shingles, and the set a sketch of 128
coordinates: in round i every shingle is hashed into one of the coordinates
still to be filled, the smallest value of the first round that reaches a
coordinate stays, and rounds 128 to 255 place every shingle in coordinate
i - 128, so that all fill. Coordinates of two sets agree with a probability
equal to their Jaccard similarity, with Chernoff-like concentration. 32 bands
of 4 coordinates route sets to buckets (a pair at 0.8 shares none with a
probability of 5e-8).

Equal sets are one class from the start, so copies are never paired. Within a
bucket, every member meets one centre c, the member that shares most buckets
with others, and is verified on full sets; what that links is one component.
Further rounds do the same with the centre of what is still apart, where one bit
of each coordinate first discards pairs six standard deviations below the
threshold. Then every pair left that could be linked is found without pairing
all: let f be in another component than c, and x any member. If f and x share no
shingle outside c, their intersection lies in c, so it has at most min(|f & c|,
|x & c|) shingles; with |x| >= |c| that makes J(f, x) <= J(f, c), which is too
small. So a pair needs 180 min(|f & c|, |x & c|) >= 80 (|x| + |f|), or shares
shingles outside c: k = ceil(80 (|f| + |x|) / 180) - |f & c| of them at least, so
that one of f's shingles outside c but its k - 1 most common ones is x's too. That
is an equi-join on rare shingles, by classes of |x|. What it finds is verified. No
link that could join two components is left out, and a bucket of m near copies
costs about m tests.

Edge cases: a null, empty or blank text has an empty set, is linked with
nothing and is kept. A text with fewer words than a shingle has one shingle,
the whole sequence. Rows with one doc_id count as one document, whatever their texts, and are all
returned: what one of them is linked with is linked with all. With ``apart`` they are
documents of their own where their texts differ, and of equal doc_ids the smallest hash of the text is kept. A row whose doc_id is null is returned with a null component and
kept. Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserine.llm import shared
from tesserine.llm.words import TERMS, U, grams, mix, row_of, words

COORDINATES, ROWS_IN_BAND = 128, 4
BANDS = COORDINATES // ROWS_IN_BAND
EMPTY = U(2**64 - 1)
#: Bits of 128 that may differ in two sketches; a pair at 0.8 differs in 13 on average with a deviation of 3.4.
MOST_BITS = 33
#: Members of a centre that one task is meant to meet; a centre of more is dealt over several.
MEMBERS = 256


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each row, sorted, and where each row's begin."""
    w = words(data, offsets, lower=True)
    keys, at = grams(w.hashes, w.rows, n)
    size = np.diff(w.rows)
    row = row_of(w.rows)[at]
    short = np.flatnonzero((size > 0) & (size < n))
    whole = np.zeros(len(short), np.uint64)
    for k in range(n - 1):
        has = size[short] > k
        whole[has] += w.hashes[w.rows[short[has]] + k] * TERMS[32 + k]
    keys, row = np.concatenate([keys, mix(whole)]), np.concatenate([row, short])
    order = np.lexsort((keys, row))
    keys, row = keys[order], row[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])
    keys, row = keys[new], row[new]
    return keys, np.searchsorted(row, np.arange(len(offsets)))


def sketch(keys: np.ndarray, rows: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """A row of ``t`` coordinates for each set; those of an empty set stay EMPTY."""
    out = np.full((len(rows) - 1) * t, EMPTY)
    row = row_of(rows)
    for i in range(2 * t):
        if not len(keys):
            break
        h = mix(keys + U((i * 0xD1342543DE82EF95 + 1) & (2**64 - 1)))
        place = (h & U(t - 1)).astype(np.int64) if i < t else np.full(len(h), i - t)
        np.minimum.at(out, row * t + place, (h >> U(8)) | (U(i) << U(56)))
        open_rows = np.unique(row)
        open_rows = open_rows[(out.reshape(-1, t)[open_rows] == EMPTY).any(axis=1)]
        if len(open_rows) < len(rows):
            is_open = np.zeros(len(rows), bool)
            is_open[open_rows] = True
            left = is_open[row]
            keys, row = keys[left], row[left]
    return out.reshape(-1, t)


def _sketched(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = shared.text_buffers(batch.column(1))
            for low, high in shared.steps(offsets):
                at = offsets[low : high + 1]
                keys, rows = shingle_sets(data[at[0] : at[-1]], at - at[0], n)
                size = np.diff(rows)
                sums = np.zeros((2, len(keys) + 1), np.uint64)
                np.cumsum(mix(keys), out=sums[0, 1:])
                np.cumsum(mix(keys ^ U(0x5851F42D4C957F2D)), out=sums[1, 1:])
                whole = sums[:, rows[1:]] - sums[:, rows[:-1]]
                coordinates = sketch(keys, rows)
                bits = np.packbits((mix(coordinates) & U(1)).astype(np.uint8), axis=1).reshape(-1).view(np.int64).reshape(-1, 2)
                bands = np.zeros((high - low, BANDS), np.uint64)
                for k in range(ROWS_IN_BAND):
                    bands += coordinates[:, k::ROWS_IN_BAND] * TERMS[k]
                bands = mix(bands + np.arange(BANDS, dtype=np.uint64) * TERMS[40])
                held = np.where(size > 0, BANDS, 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[low:high].cast(pa.int64()),
                        batch.column(2)[low:high],
                        pa.array(size, pa.int64()),
                        pa.array(whole[0].view(np.int64)),
                        pa.array(whole[1].view(np.int64)),
                        pa.array(np.ascontiguousarray(bits[:, 0])),
                        pa.array(np.ascontiguousarray(bits[:, 1])),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(held)]), pa.int32()), pa.array(bands[size > 0].reshape(-1).view(np.int64))),
                    ],
                    ["doc_id", "content", "n_shingles", "k0", "k1", "b0", "b1", "bands"],
                )

    return run


def _sets(n: int, wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            take = np.flatnonzero(shared.passes(wanted.value, mix(ids.astype(np.int64).view(np.uint64))))
            if not len(take):
                continue
            batch = batch.take(pa.array(take))
            data, offsets = shared.text_buffers(batch.column(1))
            for low, high in shared.steps(offsets):
                at = offsets[low : high + 1]
                keys, rows = shingle_sets(data[at[0] : at[-1]], at - at[0], n)
                yield pa.RecordBatch.from_arrays([batch.column(0)[low:high].cast(pa.int64()), pa.array([keys[a:b].tobytes() for a, b in zip(rows[:-1], rows[1:])], pa.binary())], ["id", "set"])

    return run


def _verified(similarity: int):
    """Compares the sets of a centre and of another: their intersection, whether they are linked, and the other's shingles outside the centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes: list[list] = [[], [], [], []]
            extra = []
            for s, t in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(s.as_buffer(), np.uint64), np.frombuffer(t.as_buffer(), np.uint64)
                at = np.searchsorted(x, y)
                at[at == len(x)] = 0
                same = x[at] == y
                both = int(same.sum())
                for k, v in enumerate((len(x), len(y), both, 100 * both >= similarity * (len(x) + len(y) - both))):
                    sizes[k].append(v)
                extra.append(y[~same].view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(e) for e in extra])]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *extra])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(v, pa.int64()) for v in sizes[:3]], pa.array(sizes[3], pa.bool_()), lists], ["c", "id", "c_n", "n", "both", "linked", "extra"])

    return run


def connected(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, component) of the graph with edges (a, b), by alternating large and small stars until nothing changes."""
    e = shared.cut(spark, edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    seen = None
    while True:
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        e = shared.cut(spark, small.filter("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())


def near_duplicates(spark: SparkSession, docs: DataFrame, shingle: int = 4, similarity: int = 80, rounds: int = 2, apart: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, content) for each row of ``docs``; linked: 100 * |A and B| >= similarity * |A or B|; content: the text's hash."""
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("content"))
    several = texts.filter("doc_id is not null").groupBy("doc_id").agg(F.min("content").alias("x"), F.max("content").alias("y")).filter("x <> y").select("doc_id", F.lit(True).alias("several"))
    several = shared.cut(spark, several)
    if several.isEmpty():
        return _linked(spark, texts, shingle, similarity, rounds)
    # rows that share a doc_id but not a text go by another number, a hash of both
    named = texts.join(several, "doc_id", "left").withColumn("own", F.expr("if(several, xxhash64(doc_id, content, 1), doc_id)"))
    rows = shared.cut(spark, named.select(F.col("own").alias("doc_id"), "text", "content", F.col("doc_id").alias("real")))
    found = shared.cut(spark, _linked(spark, rows.select("doc_id", "text", "content"), shingle, similarity, rounds).withColumnRenamed("doc_id", "own"))
    names = rows.filter("real is not null").select(F.col("doc_id").alias("own"), "real").distinct()
    found = found.join(names, "own", "left")
    if not apart:  # the texts of one document are linked
        links = found.filter("real is not null").select("real", "component_id").distinct()
        links = links.join(links.groupBy("real").agg(F.min("component_id").alias("b")), "real").filter("component_id <> b").select(F.col("component_id").alias("a"), "b")
        parts = connected(spark, links) if not links.isEmpty() else None
        if parts is not None:
            found = found.join(parts.select(F.col("node").alias("component_id"), "component"), "component_id", "left").withColumn("component_id", F.coalesce("component", "component_id")).drop("component")
    found = shared.cut(spark, found)
    first = found.filter("real is not null").groupBy("component_id").agg(F.min(F.struct("real", "content")).alias("first"))
    found = found.join(first, "component_id", "left").withColumn("kept", F.coalesce((F.col("real") == F.col("first.real")) & (F.lit(not apart) | (F.col("content") == F.col("first.content"))), F.lit(True)))
    return found.select(F.col("real").alias("doc_id"), "n_shingles", F.col("first.real").alias("component_id"), "kept", "content")


def _linked(spark: SparkSession, texts: DataFrame, shingle: int, similarity: int, rounds: int) -> DataFrame:
    """The same, where rows with one doc_id have one text."""
    all_rows = shared.cut(spark, texts.mapInArrow(_sketched(shingle), "doc_id long, content long, n_shingles long, k0 long, k1 long, b0 long, b1 long, bands array<long>"))
    # equal sets are one class, named by its smallest doc_id
    classes = all_rows.filter("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "k0", "k1").agg(F.min("doc_id").alias("id"), F.ceil(F.count("*") / MEMBERS).cast("int").alias("copies"))
    classes = shared.cut(spark, classes)
    heads = all_rows.join(classes.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    entries = heads.select(F.col("doc_id").alias("id"), F.explode("bands").alias("band"))
    busy = entries.groupBy("band").agg(F.min("id").alias("x"), F.max("id").alias("y"), F.count("*").alias("size")).filter("x < y").select("band", "size")
    entries = shared.cut(spark, entries.join(busy, "band").select("band", "id", "size"))
    nodes = shared.cut(spark, heads.join(entries.groupBy(F.col("id").alias("doc_id")).agg(F.sum("size").alias("weight")), "doc_id").select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "b0", "b1", "weight"))
    count = nodes.count()
    parts = None
    if count:
        wanted = spark.sparkContext.broadcast(shared.bitmap(nodes.mapInArrow(_mixed, "k long"), "k", count))
        sets = shared.cut(spark, texts.filter("doc_id is not null").select("doc_id", "text").mapInArrow(_sets(shingle, wanted), "id long, set binary").join(nodes.select("id"), "id", "left_semi").dropDuplicates(["id"]))
        parts = _components(spark, entries, nodes, sets, similarity, rounds)
    found = classes.withColumn("component", F.col("id")) if parts is None else classes.join(parts.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    same = ("n_shingles", "k0", "k1")
    return (
        _beside(all_rows.select("doc_id", *same, "content"), found.select(*same, "component"), classes.select(*same, "copies"), same, "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), "content")
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
        .withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))
        .select("doc_id", "n_shingles", "component_id", "kept", "content")
    )


def _mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(mix(batch.column(0).to_numpy().view(np.uint64)).view(np.int64))], ["k"])


def _centres(spark: SparkSession, pairs: DataFrame) -> DataFrame:
    """(c, copies): in how many parts the members of each centre are dealt."""
    return shared.cut(spark, pairs.groupBy("c").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("copies")))


def _beside(rows: DataFrame, values: DataFrame, copies: DataFrame, on: tuple[str, ...] = ("c",), by: str = "id", how: str = "inner") -> DataFrame:
    """``rows`` joined with ``values`` on some keys; the rows of a key are dealt over its ``copies`` by another column."""
    keys = list(on)
    dealt = rows.join(copies.filter("copies > 1"), keys, "left").withColumn("salt", F.expr(f"cast(pmod(xxhash64({by}), coalesce(copies, 1)) as int)")).drop("copies")
    copied = values.join(copies, keys).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    return dealt.join(copied, [*keys, "salt"], how).drop("salt")


def _compared(spark: SparkSession, pairs: DataFrame, sets: DataFrame, similarity: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (c, id) with what _verified() says of their full sets, and the copies of each c."""
    pairs = shared.cut(spark, pairs)
    centres = _centres(spark, pairs)
    full = _beside(pairs.join(sets.withColumnRenamed("set", "t"), "id"), sets.select(F.col("id").alias("c"), F.col("set").alias("s")), centres).select("c", "id", "s", "t")
    return full.mapInArrow(_verified(similarity), "c long, id long, c_n long, n long, both long, linked boolean, extra array<long>"), centres


def _components(spark: SparkSession, entries: DataFrame, nodes: DataFrame, sets: DataFrame, similarity: int, rounds: int) -> DataFrame | None:
    placed = entries.join(nodes.select("id", "weight"), "id").select("band", "id", "weight")
    centres = placed.groupBy("band").agg(F.max(F.struct("weight", "id")).alias("c")).select("band", F.col("c.id").alias("c"))
    first = entries.select("band", "id").join(centres, "band").filter("c <> id").select("c", "id").distinct()
    stars, members = _compared(spark, first, sets, similarity)
    stars = shared.cut(spark, stars)
    parts = _joined(spark, stars.filter("linked").select(F.col("c").alias("a"), F.col("id").alias("b")), None)
    # whoever still stands apart gets a centre of its own kind, if the sketches allow a link
    for _ in range(rounds):
        here = _with_part(placed, parts).select("band", "id", "part", "weight")
        apart = here.groupBy("band").agg(F.min("part").alias("x"), F.max("part").alias("y")).filter("x < y").select("band")
        here = here.join(apart, "band")
        main = here.groupBy("band").agg(F.max(F.struct("weight", "part")).alias("m")).select("band", F.col("m.part").alias("main"))
        others = here.join(main, "band")
        centre = others.filter("part <> main").groupBy("band").agg(F.max(F.struct("weight", "id", "part")).alias("c")).select("band", F.col("c.id").alias("c"), F.col("c.part").alias("c_part"))
        pairs = others.filter("part <> main").join(centre, "band").filter("part <> c_part").select("c", "id").distinct()
        links = shared.cut(spark, _compared(spark, _likely(pairs, nodes, similarity), sets, similarity)[0].filter("linked").select(F.col("c").alias("a"), F.col("id").alias("b")))
        if links.isEmpty():
            break
        parts = _joined(spark, links, parts)
    # all pairs left that can be linked: see above
    known = _with_part(stars.select("c", "id", "c_n", "n", "both", "extra"), parts)
    known = _beside(known, _with_part(members.select(F.col("c").alias("id")), parts).select(F.col("id").alias("c"), F.col("part").alias("c_part")), members)
    fringe = shared.cut(spark, known.filter("part <> c_part").select("c", "id", "part", "n", "both", "extra"))
    if fringe.isEmpty():
        return parts
    known = _beside(known, fringe.select("c").distinct(), members).select("c", "id", "part", "n", "c_n", "both", "extra")
    known = known.withColumn("class", F.floor(F.log("n") / math.log(1.05)).cast("int"))
    x = known.select("c", "id", "part", "class", F.explode("extra").alias("shingle"))
    common = x.groupBy("c", "shingle").agg(F.count("*").alias("times"))
    rare = fringe.select("c", F.col("id").alias("f"), F.col("part").alias("f_part"), F.explode("extra").alias("shingle")).join(common, ["c", "shingle"])
    rare = rare.withColumn("k", F.row_number().over(Window.partitionBy("c", "f").orderBy("times", "shingle"))).filter("times > 1")
    classes = known.groupBy("c", "class").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    needed = fringe.select("c", F.col("id").alias("f"), F.col("n").alias("f_n"), F.col("both").alias("f_both"), F.size("extra").alias("m"))
    needed = _beside(needed.withColumn("id", F.col("f")), classes, members).filter(f"100 * high >= {similarity} * f_n and 100 * f_n >= {similarity} * low")
    needed = needed.withColumn("need", F.expr(f"ceil({similarity} * (f_n + low) / {100 + similarity}.0D) - f_both")).select("c", "f", "class", F.expr("if(need <= 0, m, m - need + 1)").alias("first"))
    sharing = rare.join(needed, ["c", "f"]).filter("k <= first").join(x, ["c", "class", "shingle"]).filter("part <> f_part").select("f", "id").distinct()
    small = known.filter(f"n < c_n and {100 + similarity} * both >= {similarity} * n").select("c", "id", "part", "n", "both")
    small = fringe.select("c", F.col("id").alias("f"), F.col("part").alias("f_part"), F.col("n").alias("f_n"), F.col("both").alias("f_both")).join(small, "c").filter(f"part <> f_part and {100 + similarity} * least(both, f_both) >= {similarity} * (n + f_n)").select("f", "id")
    pairs = sharing.union(small).select(F.least("f", "id").alias("c"), F.greatest("f", "id").alias("id")).distinct()
    links = shared.cut(spark, _compared(spark, _likely(pairs, nodes, similarity), sets, similarity)[0].filter("linked").select(F.col("c").alias("a"), F.col("id").alias("b")))
    return parts if links.isEmpty() else _joined(spark, links, parts)


def _with_part(rows: DataFrame, parts: DataFrame | None) -> DataFrame:
    """``rows`` with the component of their id."""
    if parts is None:
        return rows.withColumn("part", F.col("id"))
    return rows.join(parts.select(F.col("node").alias("id"), F.col("component").alias("part")), "id", "left").withColumn("part", F.coalesce("part", "id"))


def _likely(pairs: DataFrame, nodes: DataFrame, similarity: int) -> DataFrame:
    """Pairs that sizes and sketches allow to be linked."""
    one = nodes.select(F.col("id").alias("c"), F.col("n").alias("xn"), F.col("b0").alias("x0"), F.col("b1").alias("x1"))
    two = nodes.select("id", F.col("n").alias("yn"), F.col("b0").alias("y0"), F.col("b1").alias("y1"))
    bits = F.bit_count(F.col("x0").bitwiseXOR(F.col("y0"))) + F.bit_count(F.col("x1").bitwiseXOR(F.col("y1")))
    return pairs.join(one, "c").join(two, "id").filter((100 * F.least("xn", "yn") >= similarity * F.greatest("xn", "yn")) & (bits <= MOST_BITS)).select("c", "id")


def _joined(spark: SparkSession, links: DataFrame, parts: DataFrame | None) -> DataFrame | None:
    """Components of the links so far."""
    if parts is not None:
        links = links.union(parts.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")))
    elif links.isEmpty():
        return None
    return shared.cut(spark, connected(spark, links))
