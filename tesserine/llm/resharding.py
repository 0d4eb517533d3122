"""Resharding as a minimum-cost flow: the fewest bytes move from old shards to new ones.

A row larger than 1/64 of a new shard is a block of its own; there are at most 64
for each new shard. The largest go first: a row stays if its shard has room and
goes to the emptiest one otherwise. Other rows of each old shard are dealt into blocks by a hash, so that blocks and their
sizes are bounded in number whatever the data. Old shard sizes are supplies, the
room left in new shards demands; a byte that stays in its shard costs 0, one that moves costs
1, and a successive-shortest-path solver finds the flow of least cost. The flow is
then laid over the blocks of each old shard in order: a block goes to one new
shard, or, where a transfer ends within it, is split between documents. Within a
block the largest documents come first, so that a split falls between small ones,
and a document goes where its middle lies. Files of old shards that no transfer
touches stay as they are.

Law: ``bytes``. The sizes of new shards differ by the few documents at splits.

Edge cases: a null text has no bytes, so its row has 16. Repeated rows are placed
each; a null doc_id and a null old shard (shard 0) are placed too. An empty table
gives no rows. Extra columns are not looked at.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserine.llm import shared

#: Bytes that a row takes besides its text.
ROW_BYTES = 16
#: Blocks of an old shard; a row larger than this share of a new shard is a block of its own.
BLOCKS, LARGE = 256, 64


def least_moves(supply: list[int], capacity: list[int]) -> list[tuple[int, int, int]]:
    """(old shard, new shard, bytes) of least cost, where moving a byte costs 1 and staying 0; the sums must be equal.

    Successive shortest paths with potentials on source -> old -> new -> sink; each augmentation fills an edge.
    """
    olds, news = len(supply), len(capacity)
    source, sink = olds + news, olds + news + 1
    edges: list[list[int]] = []  # to, room, cost; the reverse is at index ^ 1
    out: list[list[int]] = [[] for _ in range(olds + news + 2)]

    def edge(a: int, b: int, room: int, cost: int) -> None:
        out[a].append(len(edges))
        edges.append([b, room, cost])
        out[b].append(len(edges))
        edges.append([a, 0, -cost])

    for i, s in enumerate(supply):
        edge(source, i, s, 0)
    for j, c in enumerate(capacity):
        edge(olds + j, sink, c, 0)
    first = len(edges)
    for i in range(olds):
        for j in range(news):
            edge(i, olds + j, min(supply[i], capacity[j]), int(i != j))
    height = [0] * len(out)
    while True:
        far, by = [float("inf")] * len(out), [-1] * len(out)
        far[source], heap = 0, [(0, source)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for e in out[a]:
                b, room, cost = edges[e]
                if room and d + cost + height[a] - height[b] < far[b]:
                    far[b], by[b] = d + cost + height[a] - height[b], e
                    heapq.heappush(heap, (far[b], b))
        if by[sink] < 0:
            break
        height = [h + int(f) if f < float("inf") else h for h, f in zip(height, far)]
        path, a = [], sink
        while a != source:
            path.append(by[a])
            a = edges[by[a] ^ 1][0]
        n = min(edges[e][1] for e in path)
        for e in path:
            edges[e][1] -= n
            edges[e ^ 1][1] += n
    flows = []
    for k in range(first, len(edges), 2):
        if n := edges[k ^ 1][1]:
            i, j = divmod((k - first) // 2, news)
            flows.append((i, j, n))
    return flows


def place_large(rows: list[tuple[int, int]], capacity: list[int]) -> tuple[list[int], list[int]]:
    """The new shard of each (size, old shard), given in falling size, and the bytes that each new shard then holds."""
    load, out = [0] * len(capacity), []
    for size, old in rows:
        stays = old < len(capacity) and load[old] + size <= capacity[old]
        j = old if stays else min(range(len(capacity)), key=lambda k: (load[k] + size - capacity[k], k))
        load[j] += size
        out.append(j)
    return out, load


def room(load: list[int], rest: int) -> list[int]:
    """How ``rest`` bytes fill the shards up to one level, where ``load`` isn't above it already."""
    low, high = 0, max(load) + rest
    while low < high:
        level = (low + high) // 2
        if sum(max(0, level - x) for x in load) >= rest:
            high = level
        else:
            low = level + 1
    out = [max(0, low - x) for x in load]
    over = sum(out) - rest
    for j in range(len(out)):
        if over and out[j]:
            out[j] -= 1
            over -= 1
    return out


def resharded(spark: SparkSession, docs: DataFrame, old_shard: Column, olds: int, news: int) -> DataFrame:
    """For each row: doc_id, size, text_crc32, old_shard, shard and slot, its place among the rows of the new shard.

    ``old_shard`` is 0 to ``olds`` - 1; new shards have nearly equal capacities.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_BYTES
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        size.alias("size"),
        F.crc32(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(old_shard, F.lit(0)).cast("int").alias("old_shard"),
    ).withColumn("block", F.expr(f"cast(pmod(xxhash64(doc_id, text_crc32), {BLOCKS}) as int)"))
    rows = shared.cut(spark, rows)
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    even = [total * (j + 1) // news - total * j // news for j in range(news)]
    limit = total // (news * LARGE)
    same = ["doc_id", "text_crc32", "size", "old_shard"]
    large = rows.filter(F.col("size") > limit).withColumn("copy", F.expr(f"row_number() over (partition by {', '.join(same)} order by size)"))
    found = sorted(((r["size"], r["old_shard"], r["doc_id"], r["text_crc32"], r["copy"]) for r in large.collect()), key=lambda x: (-x[0], x[2] is None, x[2], x[1:2], x[3:]))
    goes, load = place_large([(r[0], r[1]) for r in found], even)
    own = spark.createDataFrame([(r[2], r[3], r[0], r[1], r[4], j) for r, j in zip(found, goes)], "d long, c long, s long, o int, k int, shard int")
    same_row = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_crc32") == F.col("c")) & (F.col("size") == F.col("s")) & (F.col("old_shard") == F.col("o")) & (F.col("copy") == F.col("k"))
    own = large.join(F.broadcast(own), same_row).select(*same, F.lit(-1).alias("block"), "shard")
    rows = rows.filter(F.col("size") <= limit)
    blocks = sorted((r["old_shard"], r["block"], r["bytes"]) for r in rows.groupBy("old_shard", "block").agg(F.sum("size").alias("bytes")).collect())
    supply = [sum(b[2] for b in blocks if b[0] == i) for i in range(olds)]
    flows = least_moves(supply, room(load, sum(supply)))
    # along an old shard's bytes, which new shard comes where: what stays first
    cuts: dict[int, list[tuple[int, int, int]]] = {}
    for i in range(olds):
        at = 0
        for j, n in sorted(((j, n) for o, j, n in flows if o == i), key=lambda x: (x[0] != i, x[0])):
            cuts.setdefault(i, []).append((at, at + n, j))
            at += n
    pieces, at = [], {}
    for i, b, size_ in blocks:
        low = at.get(i, 0)
        at[i] = low + size_
        for x, y, j in cuts.get(i, []):
            if x < low + size_ and y > low:
                pieces.append((i, b, x - low, y - low, j))
    plan = spark.createDataFrame(pieces, "old_shard int, block int, low long, high long, shard int")  # at most a few per block
    within = rows.withColumn("end", F.expr("sum(size) over (partition by old_shard, block order by size desc, doc_id, text_crc32 rows unbounded preceding)"))
    within = within.withColumn("middle", F.expr("end - size + size div 2"))
    placed = within.join(F.broadcast(plan), ["old_shard", "block"]).filter("middle >= low and middle < high")
    placed = placed.select(*same, "block", "shard").union(own)
    # places in a shard: within a block's part, after the parts before it
    parts = placed.groupBy("shard", "old_shard", "block").count().withColumn("before", F.expr("sum(count) over (partition by shard order by old_shard, block) - count")).drop("count")
    ranked = placed.withColumn("k", F.expr("row_number() over (partition by old_shard, block, shard order by doc_id, text_crc32, size) - 1"))
    return ranked.join(F.broadcast(parts), ["shard", "old_shard", "block"]).select("doc_id", "size", "text_crc32", "old_shard", "shard", F.expr("before + k").alias("slot"))


def rewrite(spark: SparkSession, docs: DataFrame, placed: DataFrame, path: str, unchanged: set[int] | None = None, old_shard: Column | None = None) -> None:
    """Writes the documents by new shard under ``path``; shards in ``unchanged`` keep their files, all others there are replaced or removed.

    Rows with the same id and text are told apart by ``old_shard``, as given to resharded(), and by a number.
    """
    crc = F.crc32(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    rows = docs.withColumns({"__id": F.col("doc_id").cast("long"), "__crc": crc, "__old": F.lit(0) if old_shard is None else F.coalesce(old_shard, F.lit(0)).cast("int")})
    same = ["__id", "__crc", "__old"]
    plain = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    rows = rows.withColumn("__copy", F.row_number().over(Window.partitionBy(*same).orderBy(F.xxhash64(*plain)))).drop("shard")
    places = placed.select(F.col("doc_id").alias("__i"), F.col("text_crc32").alias("__c"), (F.lit(0) if old_shard is None else F.col("old_shard")).alias("__o"), "shard")
    places = places.withColumn("__k", F.row_number().over(Window.partitionBy("__i", "__c", "__o").orderBy("shard")))
    rows = rows.join(places, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__crc") == F.col("__c")) & (F.col("__old") == F.col("__o")) & (F.col("__copy") == F.col("__k")))
    rows = rows.drop(*same, "__copy", "__i", "__c", "__o", "__k")
    if not unchanged:
        rows.repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(path)
        return
    stay = {str(r["shard"]) for r in placed.select("shard").distinct().collect()} | {str(j) for j in unchanged}
    rows = rows.filter(~F.col("shard").isin(sorted(unchanged)))
    rows.repartition("shard").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    if 0 in unchanged:  # holds the rows without a shard
        stay.add("__HIVE_DEFAULT_PARTITION__")
    # a shard that has no rows any more isn't overwritten
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for found in files.listStatus(folder):
        name = found.getPath().getName()
        if name.startswith("shard=") and name.removeprefix("shard=") not in stay:
            files.delete(found.getPath(), True)


def untouched(placed: DataFrame) -> DataFrame:
    """Shards whose rows all come from the old shard of the same number, which loses none: their files needn't be rewritten."""
    moved = placed.filter("old_shard <> shard")
    touched = moved.select("shard").union(moved.select(F.col("old_shard").alias("shard"))).distinct()
    return placed.select("shard").distinct().join(touched, "shard", "left_anti")
