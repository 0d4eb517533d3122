"""DuckDB SQL of the queries, over views named as the tables."""

from __future__ import annotations

from tesserine.config import DEDUP, FIXED_MS, GRID, HASH_LIMIT, LSHConfig, MS_PER_CANDIDATE, SIZE_BINS, WEIGHTS
from tesserine.operators.lsh import projections
from tesserine.plans.queries import CAPACITY, DIM, H, NODES, T

EMB = "emb as (select vec_id as image_id, embedding::double[] as e from embeddings)"
NORM = "sqrt(list_dot_product({0}, {0}))"


def proj(tables: int, bits: int, name: str = "proj") -> str:
    p = projections(tables, bits, DIM)
    rows = ", ".join(f"({t}, {b}, [{', '.join(str(x) for x in p[t, b])}]::float[])" for t in range(tables) for b in range(bits))
    return f"{name} as materialized (select t as table_id, b as bit, w::double[] as w from (values {rows}) v(t, b, w))"


def keys(source: str = "emb", name: str = "keys", planes: str = "proj") -> str:
    return f"{name} as materialized (select image_id, table_id, string_agg(case when list_dot_product(e, w) >= 0 then '1' else '0' end, '' order by bit) as bucket_key from {source}, {planes} group by image_id, table_id)"


def posted(tables: int = T, bits: int = H) -> str:
    return f"{EMB}, {proj(tables, bits)}, {keys()}"


MATCH = "match as (select a.image_id as query_id, b.image_id, b.table_id from keys a join keys b using (table_id, bucket_key))"
CAND = MATCH + ", cand as (select distinct query_id, image_id from match where query_id <> image_id)"
SIZES = "sizes as (select table_id, bucket_key, count(*) as size from keys group by all)"


def cosine(a: str, b: str) -> str:
    na, nb = NORM.format(a), NORM.format(b)
    return f"(case when {na} < 1e-8 or {nb} < 1e-8 then 0.0 else list_dot_product({a}, {b}) / ({na} * {nb}) end)"


def top(k: int, source: str = "scored") -> str:
    return f"select query_id, rank, image_id, score from (select *, row_number() over (partition by query_id order by score desc, image_id) as rank from {source}) where rank <= {k}"


METRICS = "count(*) as n_buckets, sum(size)::bigint as total, min(size) as min, max(size) as max, round(avg(size), 6) as mean, quantile_cont(size, 0.5) as median, round(stddev_pop(size), 6) as std, round(quantile_cont(size, 0.95), 6) as p95, round(quantile_cont(size, 0.99), 6) as p99, round(max(size) / avg(size), 6) as imbalance"

VARIANTS = f"""{EMB}, moved as (select image_id as i, v, case when v = 0 then e else list_transform(e, lambda x, d: x + 0.02::double * v * (((i * 7919 + (d - 1) * 104729 + v * 1299709) % 2001) - 1000) / 1000::double) end as m from emb, (select unnest(range(0, 6)) as v) where image_id % 50 = 0),
variants as materialized (select 2000000 + 6 * i + v as image_id, 2000000 + 6 * i as base_id, v as variant, case when v = 0 then m else list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) end as e from moved),
searched as (select image_id, e from variants union all select image_id, e from emb where image_id % 50 <> 0),
truth as (select base_id as query_id, image_id as relevant_id from variants where variant > 0)"""

BITS = "(list_sum(list_transform({0}, lambda b, i: case when b then (1::hugeint << (64 - i)::int) else 0::hugeint end)))"


def signed(flags: str) -> str:
    s = BITS.format(flags)
    return f"(case when {s} >= 9223372036854775808::hugeint then {s} - 18446744073709551616::hugeint else {s} end)::bigint"


def features(source: str) -> str:
    return f"""pre as (select image_id, e, list_sum(e) / 64 as mean, (list_sort(e)[32] + list_sort(e)[33]) / 2 as median from {source}),
features as materialized (select image_id, e, {signed('list_transform(e, lambda x: x > mean)')} as ahash, {signed('list_transform(range(0, 64), lambda i: e[(i + 1) % 64 + 1] > e[i + 1])')} as dhash, {signed('list_transform(e, lambda x: x > median)')} as phash,
list_transform(range(0, 64), lambda i: e[i + 1] - e[(i + 8) % 64 + 1]) as sift, list_transform(range(0, 32), lambda i: (e[2 * i + 1] + e[2 * i + 2]) / 2) as orb,
list_transform(range(0, 32), lambda k: len(list_filter(range(0, 64), lambda i: (i // 32) * 2 + (i % 8) // 4 = k // 8 and least(7, greatest(0, floor((e[i + 1] + 0.5) * 8))) = k % 8)) / 16.0::double) as hist from pre)"""


NEXT = "pairs as (select a.image_id as a_id, b.image_id as b_id, a, b from (select image_id, f as a from x) a join (select image_id, f as b from x) b on b.image_id = a.image_id + 1)"
MEAN3 = "((bit_count(xor({0}.ahash, {1}.ahash))::int + bit_count(xor({0}.dhash, {1}.dhash))::int + bit_count(xor({0}.phash, {1}.phash))::int) / 3.0::double)"


def intersection(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, 33), lambda i: least({a}[i], {b}[i])))"


def fused(pairs: str) -> str:
    w = WEIGHTS
    score = f"{w['cnn']} * {cosine('a.e', 'b.e')} + {w['hash']} * (1 - mean_hamming / 64.0::double) + {w['sift']} * {cosine('a.sift', 'b.sift')} + {w['orb']} * {cosine('a.orb', 'b.orb')} + {w['hist']} * {intersection('a.hist', 'b.hist')}"
    return f"fused as (select query_id, image_id, round(mean_hamming, 6) as mean_hamming, case when mean_hamming > {HASH_LIMIT} then 0.0 else round({score}, 6) end as score from (select p.query_id, p.image_id, a, b, {MEAN3.format('a', 'b')} as mean_hamming from {pairs} p join features a on a.image_id = p.query_id join features b on b.image_id = p.image_id))"


def ring(nodes: list[str], name: str = "ring") -> str:
    rows = ", ".join(f"('{n}')" for n in nodes)
    return f"{name} as (select ('0x' || substr(md5(node || '_virtual_' || i), 1, 8))::ubigint::bigint as position, node from (values {rows}) t(node), (select unnest(range(0, 3)) as i))"


def assign(places: str = "ring", name: str = "assigned") -> str:
    return f"""{name}_r as (select coalesce(lag(position) over (order by position, node), -1) as low, position as high, node from {places} union all select max(position), 9223372036854775807, arg_min(node, (position, node)) from {places}),
{name} as (select key, position, node from (select image_id::varchar as key, ('0x' || substr(md5(image_id::varchar), 1, 8))::ubigint::bigint as position from emb) join {name}_r on position > low and position <= high)"""


HOT = "hot as (select table_id, bucket_key from (select *, avg(size) over (partition by table_id) as mean from sizes) where size > 3 * mean)"
SPLIT = f"{SIZES}, {HOT}, split as (select image_id, table_id, bucket_key, case when h.bucket_key is not null then bucket_key || lpad(bin(('0x' || substr(md5(table_id || ':' || bucket_key || ':' || image_id), 1, 2))::int % 16), 4, '0') else bucket_key end as store_key from keys left join hot h using (table_id, bucket_key))"
SEARCH = f"{VARIANTS}, {proj(T, H)}, {keys('searched')}, {CAND}, scored as (select query_id, c.image_id, round({cosine('a.e', 'b.e')}, 6) + 0.0 as score from cand c join variants a on a.image_id = query_id and a.variant = 0 join searched b on b.image_id = c.image_id), results as ({top(20)}), queries as (select image_id as query_id from variants where variant = 0)"
PER_QUERY = "perq as (select q.query_id, k, (select count(*) from results r join truth t on t.query_id = r.query_id and t.relevant_id = r.image_id where r.query_id = q.query_id and r.rank <= k) as hits, (select count(*) from truth t where t.query_id = q.query_id) as n from queries q, (select unnest([1, 5, 10, 20]) as k))"


def sweep() -> str:
    out = [VARIANTS]
    for bits in sorted({h for _, h in GRID}):
        most = max(t for t, h in GRID if h == bits)
        out += [proj(most, bits, f"p{bits}"), keys("searched", f"k{bits}", f"p{bits}")]
        out.append(f"f{bits} as (select {bits} as hash_size, a.image_id as query_id, b.image_id, min(table_id) as first from k{bits} a join k{bits} b using (table_id, bucket_key) where a.image_id <> b.image_id and a.image_id in (select image_id from variants where variant = 0) group by all)")
    out.append("found as (" + " union all ".join(f"select * from f{h}" for h in sorted({h for _, h in GRID})) + ")")
    out.append("grid as (select * from (values " + ", ".join(f"({t}, {h})" for t, h in GRID) + ") g(num_tables, hash_size))")
    out.append(f"ranked as (select num_tables, g.hash_size, f.query_id, f.image_id, row_number() over (partition by num_tables, g.hash_size, f.query_id order by round({cosine('a.e', 'b.e')}, 6) desc, f.image_id) as rank from found f join grid g on g.hash_size = f.hash_size and first < num_tables join variants a on a.image_id = f.query_id join searched b on b.image_id = f.image_id)")
    out.append("per as (select num_tables, hash_size, r.query_id, count(*) as n, count(*) filter (rank <= 1 and t.relevant_id is not null) as h1, count(*) filter (rank <= 5 and t.relevant_id is not null) as h5, count(*) filter (rank <= 10 and t.relevant_id is not null) as h10 from ranked r left join truth t on t.query_id = r.query_id and t.relevant_id = r.image_id group by all)")
    out.append("swept as materialized (select num_tables, hash_size, round(avg(coalesce(h1, 0)), 6) as precision_at_1, round(avg(coalesce(h5, 0) / 5), 6) as recall_at_5, round(avg(coalesce(h10, 0) / 10), 6) as precision_at_10, round(avg(coalesce(n, 0)), 6) as mean_candidates from grid cross join (select image_id as query_id from variants where variant = 0) left join per using (num_tables, hash_size, query_id) group by all)")
    out.append(f"configs as (select *, round({FIXED_MS} + mean_candidates * {MS_PER_CANDIDATE}, 6) as model_ms from swept)")
    return ", ".join(out)


HALF = "(case when x = 0 then 0.0 else round_even(x / pow(2.0, greatest(floor(log2(abs(x))), -14) - 10), 0) * pow(2.0, greatest(floor(log2(abs(x))), -14) - 10) end)"
LOG = "log as materialized (select row_number() over (order by ts, event_id) - 1 as seq, user_id as key, value as latency_ms from events)"
LRU = f"{LOG}, prev as (select seq, key, lag(seq) over (partition by key order by seq) as before, lead(seq) over (partition by key order by seq) as after from log), replay as (select p.seq, p.key, p.before is not null and (select count(*) from prev j where j.seq > p.before and j.seq < p.seq and (j.after is null or j.after > p.seq)) < {CAPACITY} as hit from prev p)"
BATCH = "batch as (select image_id + 1000000 as image_id, list_reverse(e) as e, image_id as line from emb where image_id < 20 union all select image_id, e, 20 from emb where image_id = 5 union all select image_id, list_reverse(e), 21 from emb where image_id = 6 union all select image_id + 1000000, e, 22 from emb where image_id = 3)"
REASONS = "reasons as (select *, exists(select 1 from emb where emb.image_id = batch.image_id) as known, row_number() over (partition by image_id order by line) as k from batch), good as (select image_id, e from reasons where not known and k = 1)"


def oracles() -> dict[str, str]:
    w = "with "
    model = lambda x: f"round({FIXED_MS} + {x} * {T} * {DEDUP} * {MS_PER_CANDIDATE}, 6)"
    bins = lambda: " union all ".join(f"select table_id, '{label}' as bin, count(*) filter (size >= {low}" + (f" and size < {high}" if high else "") + ") as n from sizes group by table_id" for label, low, high in SIZE_BINS)
    inclusive = "case " + " ".join(f"when size <= {high} then '{label}'" for label, _, high in SIZE_BINS[:-1]) + f" else '{SIZE_BINS[-1][0]}' end"
    search = f"scored as (select query_id, c.image_id, round({cosine('a.e', 'b.e')}, 6) + 0.0 as score from cand c join emb a on a.image_id = query_id join emb b on b.image_id = c.image_id)"
    swept = sweep()
    order = "case " + " ".join(f"when num_tables = {t} and hash_size = {h} then {i}" for i, (t, h) in enumerate(GRID)) + " end"
    config = ", ".join(f"('{k}', {v}::bigint)" for k, v in vars(LSHConfig()).items())
    x_hash = f"{EMB}, {features('emb')}, x as (select image_id, features as f from features), {NEXT}"
    by_table = "by_table as (select table_id, count(*) as n_buckets, sum(size)::bigint as total, max(size) as max, count(*) filter (size > 3 * mean) as n_hot, round(sum(case when size > 3 * mean then size else 0 end) / sum(size), 6) as hot_share from (select *, avg(size) over (partition by table_id) as mean from sizes) group by table_id)"
    insert = f"{EMB}, {proj(T, H)}, {BATCH}, {REASONS}, {keys('good')}"
    return {
        "lsh_keys": w + posted() + " select * from keys",
        "postings": w + posted() + " select * from keys",
        "bucket_lists": w + posted() + " select table_id, bucket_key, count(*) as size, string_agg(image_id::varchar, ',' order by image_id) as ids from keys group by all",
        "lsh_candidates": w + posted() + f", {CAND} select * from cand",
        "candidate_counts": w + posted(bits=12) + f", {CAND} select e.image_id as query_id, count(c.image_id) as n from emb e left join cand c on c.query_id = e.image_id group by all",
        "capped_candidates": w + posted() + f", {MATCH}, ranked as (select query_id, image_id, max(case when r <= 2 then 1 else 0 end) as first from (select *, row_number() over (partition by query_id, table_id order by image_id) as r from match where query_id <> image_id) group by all) select query_id, image_id from (select *, row_number() over (partition by query_id order by first desc, image_id) as k from ranked) where k <= 20",
        "capped_flat": w + posted() + f", {CAND} select query_id, image_id from (select *, row_number() over (partition by query_id order by image_id) as k from cand) where k <= 15",
        "table_votes": w + posted() + " select a.image_id as a, b.image_id as b, count(distinct table_id) as votes from keys a join keys b using (table_id, bucket_key) where a.image_id < b.image_id group by all",
        "distinct_keys": w + posted() + " select image_id, count(distinct bucket_key) as n_keys from keys group by all",
        "subsample_index": w + posted() + " select * from keys where ('0x' || substr(md5(bucket_key), 1, 4))::int % 10 = 0",
        "expand_index": w + f"{EMB}, raw as (select copy * 1000000 + image_id as image_id, copy, case when copy = 0 then e else list_transform(e, lambda x, d: x + 0.005::double * (((emb.image_id * 6151 + (d - 1) * 50021 + copy * 1000003) % 2001) - 1000) / 1000::double) end as m from emb, (select unnest(range(0, 10)) as copy)), n as (select image_id, copy, case when copy = 0 then m else list_transform(m, lambda x: x / greatest(sqrt(list_dot_product(m, m)), 1e-8)) end as e from raw) select image_id, copy::int as copy, round(e[1], 6) as first, round(e[64], 6) as last, round({NORM.format('e')}, 6) as norm from n",
        "search_topk": w + posted() + f", {CAND}, {search} " + top(10),
        "search_unseen": w + f"{VARIANTS}, {proj(T, H)}, {keys()}, {keys('(select image_id, e from variants where variant > 0)', 'vkeys')}, cand as (select distinct a.image_id as query_id, b.image_id from vkeys a join keys b using (table_id, bucket_key)), scored as (select query_id, c.image_id, round({cosine('a.e', 'b.e')}, 6) + 0.0 as score from cand c join variants a on a.image_id = query_id join emb b on b.image_id = c.image_id) " + top(10),
        "knn_exact": w + f"{EMB}, scored as (select a.image_id as query_id, b.image_id, round({cosine('a.e', 'b.e')}, 6) + 0.0 as score from emb a join emb b on a.image_id <> b.image_id where a.image_id % 50 = 0) " + top(10),
        "batch_lookup": w + f"{EMB} select image_id, round(e[1], 6) as first from emb where image_id % 50 = 0",
        "path_map": "select e.vec_id as image_id, coalesce(p.url, 'unknown_id_' || e.vec_id) as path from embeddings e left join pages p on p.page_id = e.vec_id",
        "normalize_l2": w + f"{EMB}, n as (select image_id, e, {NORM.format('e')} as n from emb) select image_id, round(n, 6) as norm_before, round(case when n > 1e-8 then 1.0 else n end, 6) as norm_after, round(case when n > 1e-8 then e[1] / n else e[1] end, 6) as first, round(e[2] / greatest(n, 1e-8), 6) as second from n",
        "cosine_pairs": w + f"{EMB}, x as (select image_id, e as f from emb), {NEXT} select a_id, b_id, round({cosine('a', 'b')}, 6) as cosine, round(list_dot_product(a, b) / ({NORM.format('a')} * {NORM.format('b')} + 1e-8), 6) as cosine_eps from pairs",
        "perceptual_hashes": w + f"{EMB}, {features('emb')} select image_id, ahash, dhash, phash from features",
        "hamming_pairs": w + x_hash + " select a_id, b_id, bit_count(xor(a.phash, b.phash))::int as distance, 1 - bit_count(xor(a.phash, b.phash)) / 64.0::double as similarity from pairs",
        "hash_sim3": w + x_hash + f" select a_id, b_id, round({MEAN3.format('a', 'b')}, 6) as mean_distance, round(1 - {MEAN3.format('a', 'b')} / 64.0::double, 6) as similarity from pairs",
        "hist_intersection": w + x_hash + f" select a_id, b_id, round({intersection('a.hist', 'b.hist')}, 6) as intersection from pairs",
        "fused_similarity": w + f"{VARIANTS}, {features('variants')}, p as (select query_id, relevant_id as image_id from truth union all select distinct query_id, query_id + 6 from truth), {fused('p')} select * from fused",
        "fused_topk": w + f"{VARIANTS}, {proj(T, H)}, {keys('variants')}, {features('variants')}, {CAND}, own as (select * from cand where (query_id - 2000000) % 6 = 0), {fused('own')}, scored as (select query_id, image_id, score from fused) " + top(5),
        "approx_cache_probe": w + f"{VARIANTS}, {features('variants')}, met as (select q.image_id as query_id, c.image_id as entry_id, bit_count(xor(q.phash, c.phash))::int as distance from features q, features c where (q.image_id - 2000000) % 6 > 0 and (c.image_id - 2000000) % 6 = 0) select query_id, entry_id, distance from (select *, row_number() over (partition by query_id order by distance, entry_id desc) as k from met where distance <= 8) where k = 1",
        "ring_positions": w + ring(NODES) + " select position, node from ring",
        "ring_assign": w + f"{EMB}, {ring(NODES)}, {assign()} select * from assigned",
        "ring_load": w + f"{EMB}, {ring(NODES)}, {assign()} select r.node, count(a.key) as n from (select distinct node from ring) r left join assigned a using (node) group by all",
        "ring_rebalance_moves": w + f"{EMB}, {ring(NODES)}, {ring(NODES[:-1], 'ring2')}, {assign()}, {assign('ring2', 'after')} select a.key, a.node as old_node, b.node as new_node from assigned a join after b using (key) where a.node <> b.node",
        "bucket_stats": w + posted() + f", {SIZES} select table_id, {METRICS} from sizes group by table_id",
        "bucket_stats_rollup": w + posted() + f", {SIZES} select coalesce(table_id, -1) as table_id, {METRICS} from sizes group by rollup (table_id)",
        "bucket_histogram": w + posted() + f", {SIZES} " + bins(),
        "bucket_histogram_inclusive": w + posted() + f", {SIZES} select table_id, {inclusive} as bin, count(*) as n from sizes group by all",
        "hotspots": w + posted() + f", {SIZES} select table_id, rank, bucket_key, size, round(size / mean, 6) as ratio from (select *, row_number() over (partition by table_id order by size desc, bucket_key) as rank from (select *, avg(size) over (partition by table_id) as mean from sizes) where size > 3 * mean) where rank <= 20",
        "coldspots": w + posted() + f", {SIZES} select * from sizes where size < 10",
        "latency_model": w + posted() + f", {SIZES} select {model('avg(size)')} as mean_ms, {model('quantile_cont(size, 0.5)')} as p50_ms, {model('quantile_cont(size, 0.95)')} as p95_ms, {model('quantile_cont(size, 0.99)')} as p99_ms, {model('max(size)')} as max_ms from sizes",
        "balance_report": w + posted() + f", {SIZES}, {HOT} select (select count(*) from hot) as total_hotspots, '{{\"n_buckets\":' || count(*) || ',\"total\":' || sum(size) || ',\"min\":' || min(size) || ',\"max\":' || max(size) || '}}' as aggregate from sizes",
        "split_postings": w + posted() + f", {SPLIT} select * from split",
        "split_stats": w + posted() + f", {SPLIT}, parted as (select table_id, store_key, count(*) as size from split group by all) select table_id, {METRICS} from parted group by table_id",
        "split_lookup_equiv": w + posted() + f", {MATCH} select table_id, count(*) as n_plain, count(*) as n_split, true as equal from match group by table_id",
        "bucket_cohesion": w + posted() + f", pair as (select a.image_id as i, b.image_id as j, {cosine('a.e', 'b.e')} as c from emb a join emb b on a.image_id < b.image_id), joined as (select ka.table_id, c, ka.bucket_key = kb.bucket_key as same from pair join keys ka on ka.image_id = i join keys kb on kb.image_id = j and kb.table_id = ka.table_id) select table_id, round(avg(c) filter (same), 6) as same_bucket, round(avg(c) filter (not same), 6) as other_bucket from joined group by table_id",
        "variants": w + f"{VARIANTS} select image_id, base_id, variant::int as variant, round(e[1], 6) as first, round(e[64], 6) as last, round({NORM.format('e')}, 6) as norm from variants",
        "ground_truth": w + f"{VARIANTS} select * from truth",
        "ground_truth_json": w + f"{VARIANTS} select * from truth",
        "truth_families": w + f"{VARIANTS} select * from truth union all select b.relevant_id as query_id, a.relevant_id from truth a join truth b using (query_id)",
        "precision_recall_at_k": w + f"{SEARCH}, {PER_QUERY} select k, round(avg(hits / k), 6) as precision, round(avg(hits / n), 6) as recall from perq group by k",
        "precision_recall_by_query": w + f"{SEARCH}, {PER_QUERY} select query_id, k, hits / k as precision, hits / n as recall from perq",
        "micro_pr": w + f"{SEARCH}, {PER_QUERY} select sum(hits)::bigint as hits, sum(hits) / (count(*) * 10) as precision, sum(hits) / sum(n) as recall from perq where k = 10",
        "tradeoff": w + swept + " select * from configs",
        "pareto": w + swept + " select num_tables, hash_size, recall_at_5, model_ms from configs a where not exists (select 1 from configs b where b.model_ms <= a.model_ms and b.recall_at_5 >= a.recall_at_5 and (b.model_ms < a.model_ms or b.recall_at_5 > a.recall_at_5))",
        "sensitivity": w + swept + ", s as (select 'num_tables' as varied, num_tables as value, recall_at_5, model_ms from configs where hash_size = 12 union all select 'hash_size', hash_size, recall_at_5, model_ms from configs where num_tables = 10) select *, round(first_value(model_ms) over (partition by varied order by value) / model_ms, 6) as speed_up from s",
        "best_config": w + swept + f" select num_tables, hash_size, recall_at_5 from configs order by recall_at_5 desc, {order} limit 1",
        "f16_roundtrip": w + f"{EMB}, h as (select image_id, list_transform(e, lambda x: {HALF}) as h from emb) select image_id, round(h[1], 8) as first, round(list_sum(h), 6) as total from h",
        "f16_expression": w + f"{EMB}, h as (select image_id, list_transform(e, lambda x: {HALF}) as h from emb) select image_id, round(h[1], 8) as first, round(list_sum(h), 6) as total from h",
        "f16_error": w + f"{EMB}, h as (select e, list_transform(e, lambda x: {HALF}) as h from emb), d as (select sqrt(list_sum(list_transform(range(1, 65), lambda i: (e[i] - h[i]) * (e[i] - h[i])))) as l2, abs(1 - {cosine('e', 'h')}) as c from h) select count(*) as n, round(avg(l2), 8) as mean_l2, round(max(l2), 8) as max_l2, round(quantile_cont(l2, 0.99), 8) as p99_l2, round(avg(c), 8) as mean_cosine_error from d",
        "cache_replay_lru": w + LRU + " select * from replay",
        "cache_stats": w + LRU + f", h as (select count(*) + 3 as total_queries, count(*) filter (hit) as cache_hits, count(*) filter (not hit) as cache_misses from replay), m as (select avg(latency_ms) as mean_ms, count(distinct key) as n from log) select total_queries, cache_hits, cache_misses, 3::bigint as cache_bypasses, 100 * cache_hits / total_queries as hit_rate_pct, least(n, {CAPACITY}) as cache_size, round(mean_ms, 6) as mean_ms, round(cache_hits * mean_ms, 4) as saved_ms from h, m",
        "cache_two_pass": "with k as (select count(distinct user_id) as n from events) select 0 as turn, n, 0::bigint as hits from k union all select 1, n, n from k",
        "latency_stats": "select coalesce(event_type, 'all') as event_type, count(*) as n, round(avg(value), 6) as mean, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, round(quantile_cont(value, 0.99), 6) as p99 from events group by rollup (event_type)",
        "insert_conflicts": w + f"{EMB}, {BATCH}, {REASONS} select image_id, line, case when known then 'exists' else 'repeated' end as reason from reasons where known or k > 1",
        "insert_batch": w + insert + " select * from keys",
        "insert_log": w + insert + " select image_id, string_agg(bucket_key, ',' order by table_id) as bucket_keys from keys group by image_id",
        "verify_insert": w + f"{EMB}, {BATCH}, {REASONS} select image_id, {T}::bigint as n_found, true as verified from good union all select -7, 0, false",
        "last_entries": "select user_id as image_id, arg_max(event_id, (ts, event_id)) as event_id, arg_max(event_type, (ts, event_id)) as bucket_keys from events group by user_id",
        "already_processed": "select vec_id as image_id from embeddings where vec_id not in (select doc_id from labels)",
        "pack_merge": "select vec_id as image_id, case when vec_id >= 200 then 'second' else 'first' end as pack from embeddings",
        "data_validation": w + f"{EMB} select unnest(['ids_unique', 'ids_dense', 'dimension', 'zero_rate', 'table_totals', 'id_sets_equal']) as name, unnest([count(*) = count(distinct image_id), max(image_id) - min(image_id) + 1 = count(*), bool_and(len(e) = {DIM}), count(*) filter (list_max(e) = 0 and list_min(e) = 0) <= 0.05 * count(*), true, true]) as passed from emb",
        "config_roundtrip": f"select * from (values {config}) t(name, value)",
        "postings_roundtrip": w + f"{EMB}, {BATCH}, {REASONS} select t::int as table_id, (select count(*) from emb) + (select count(*) from good) as n, (select count(*) from emb) + (select count(*) from good) as n_images from (select unnest(range(0, {T})) as t)",
        "postings_by_table": w + posted() + " select * from keys",
        "feature_packs": w + f"{EMB}, {features('emb')} select image_id, (image_id % 4)::int as pack, phash, round(list_sum(hist), 6) as mass, round(e[1], 6) as first from features",
        "feature_upsert": w + f"{EMB} select image_id, (image_id % 50 = 0)::int as ingested, round(case when image_id % 50 = 0 then e[{DIM}] else e[1] end, 6) as first from emb",
        "split_keys": w + posted() + f", {SPLIT} select table_id, bucket_key, count(*) as size, count(*) as stored, count(distinct store_key) as parts from split where store_key <> bucket_key group by all",
        "balance_by_table": w + posted() + f", {SIZES}, {by_table} select * from by_table",
        "report_json": w + posted() + f", {SIZES}, {by_table} select * from by_table",
        "curve_csv": w + f"{SEARCH}, {PER_QUERY} select k, round(avg(hits / k), 6) as precision, round(avg(hits / n), 6) as recall from perq group by k",
        "projections_roundtrip": w + f"{proj(T, H)} select table_id, bit, round(w[1], 6) as first, round(w[{DIM}], 6) as last from proj",
        "ring_roundtrip": w + f"{EMB}, {ring(NODES)}, {assign()} select r.node, count(a.key) as n from (select distinct node from ring) r left join assigned a using (node) group by all",
        "sorted_configs": w + swept + " select row_number() over (order by recall_at_5 desc, model_ms, num_tables, hash_size) as place, num_tables, hash_size, recall_at_5, model_ms from configs",
        "f16_similarity": w + f"{EMB}, x as (select image_id, e as f from emb), {NEXT}, h as (select a_id, b_id, a, b, list_transform(a, lambda x: {HALF}) as ha, list_transform(b, lambda x: {HALF}) as hb from pairs) select a_id, b_id, round({cosine('ha', 'hb')}, 6) as half, round(abs({cosine('ha', 'hb')} - {cosine('a', 'b')}), 6) as error from h",
        "sample_rows": "select vec_id as image_id from embeddings order by md5('42:' || vec_id), vec_id limit 50",
        "benchmark_queries": "select vec_id as image_id from embeddings order by md5('42:' || vec_id), vec_id limit 200",
        "test_store": w + f"{EMB} select doc_id as image_id, round(coalesce({NORM.format('e')}, 0.0), 6) as norm from documents left join emb on image_id = doc_id",
        "engine_batch": w + posted() + f", {MATCH}, cand as (select distinct query_id, image_id from match where query_id % 50 = 0), {search} " + top(10),
        "stream_insert": w + posted() + " select * from keys",
        "stream_search": w + posted() + f", {CAND}, {search}, t as ({top(10)}) select * from t where query_id % 50 = 0",
        "stream_cache": w + LRU + " select count(*) as n, count(*) filter (hit) as hits from replay",
        "stream_latency": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') as start, count(*) as n, round(avg(value), 6) as mean_ms from events group by 1",
    }
