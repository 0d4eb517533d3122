"""Quality rules as weak supervision, in DataFrame expressions only.

Nine rules look at each text and vote good (1), bad (-1) or abstain (0). No
labels are used: expectation-maximisation on the counts of vote patterns
estimates how often each rule gives each vote on good and on bad texts, and the
posterior probability of good replaces an all-must-pass filter. A pattern is one
of 3^9 = 19,683, so what reaches the driver is bounded whatever the data; votes of
all rows are counted.

Edge cases: a null or blank text has no words; rules on shares abstain for it
and it fails the base rule. Rows are judged one by one, so repeated rows and a
null doc_id need no care; an empty table gives the prior. Only doc_id and text
are looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.llm import shared

TURNS = 20
#: Before any evidence: how often a rule says bad, nothing or good of bad texts, and of good ones; rows that this counts for.
START = {0: {-1: 0.4, 0: 0.15, 1: 0.45}, 1: {-1: 0.01, 0: 0.12, 1: 0.87}}
START_GOOD, PSEUDO = 0.8, 2.0

#: Rules on columns of features(): the first condition votes bad, the second good.
RULES = {
    "symbols": ("n_symbols > 0.25D * n_words", "n_symbols < 0.05D * n_words"),
    "marked": ("n_marked > 0.3D * n_words", "n_marked < 0.05D * n_words"),
    "letters": ("n_letters < 0.85D * word_chars", "n_letters > 0.92D * word_chars"),
    "capitals": ("n_capitals > 0.4D * word_chars", "n_capitals < 0.15D * word_chars"),
    "repeats": ("n_repeat_words > 0.4D * n_words", "n_repeat_words < 0.2D * n_words"),
    "variety": ("n_words between 50 and 2000 and n_distinct < 0.2D * n_words", "n_words between 50 and 2000 and n_distinct > 0.35D * n_words"),
    "lines": ("n_lines >= 3 and n_dup_lines > 0.3D * n_lines", "n_lines >= 1 and n_dup_lines <= 0.1D * n_lines"),
    "lengths": ("n_words > 0 and (word_chars < 2 * n_words or word_chars > 14 * n_words)", "word_chars between 3 * n_words and 10 * n_words and n_words > 0"),
    "shouts": ("n_shouts > 0.2D * n_words", "n_words > 0 and n_shouts < 0.02D * n_words"),
}
BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"

#: Bits that a window's place takes in the fast way of repeated().
PLACE_BITS = 24


def repeated(bits: int = PLACE_BITS) -> str:
    """Words in 3-word windows that come twice or more, as an expression on ``words``.

    The fast way sorts numbers, hashes whose low bits give way to the place, so that equal windows are neighbours and are
    compared by the whole hash. Where two neighbours agree in the high bits alone, or places need more bits, pairs of whole
    hash and place are sorted instead. transform(array(x), v -> ...)[0] binds v to x.
    """
    low, high = (1 << bits) - 1, -(1 << bits)
    count = "aggregate(sort_array({0}), named_struct('n', 0L, 'last', -3L), (a, x) -> named_struct('n', a.n + least(3L, x - a.last), 'last', x), a -> a.n)"
    place = lambda j: f"int(s[{j}] & {low}L)"
    near = lambda j: f"((x ^ s[{j}]) & {high}L) = 0"
    before, after = "greatest(j - 1, 0)", "least(j + 1, size(s) - 1)"
    fast = count.format(f"transform(filter(s, (x, j) -> (j > 0 and {near(before)}) or (j < size(s) - 1 and {near(after)})), x -> x & {low}L)")
    mixed = f"exists(transform(s, (x, j) -> j > 0 and {near(before)} and h[int(x & {low}L)] <> h[{place(before)}]), x -> x)"
    pairs = "sort_array(transform(h, (x, i) -> named_struct('h', x, 'i', bigint(i))))"
    whole = count.format(f"transform(filter(p, (x, j) -> (j > 0 and x.h = p[{before}].h) or (j < size(p) - 1 and x.h = p[least(j + 1, size(p) - 1)].h)), x -> x.i)")
    whole = f"transform(array({pairs}), p -> {whole})[0]"
    return f"""
transform(array(words), w -> if(size(w) < 3, 0L,
  transform(array(transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2]))), h ->
    if(size(array_distinct(h)) = size(h), 0L,
      if(size(h) > {low}, {whole},
        transform(array(sort_array(transform(h, (x, i) -> (x & {high}L) | i))), s ->
          if({mixed}, {whole}, {fast}))[0])))[0]))[0]
"""


def features(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns that the rules look at."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return (
        docs.withColumn("__t", text)
        .withColumn("words", F.expr(r"regexp_extract_all(__t, '[^\\x20\\x09-\\x0D]+', 0)"))
        .withColumn("__l", F.expr(r"filter(split(__t, '\n', -1), x -> x rlike '[^\\x20\\x09-\\x0D]')"))
        .withColumns(
            {
                "n_words": F.size("words").cast("long"),
                "word_chars": F.length(F.array_join("words", "")).cast("long"),
                "n_distinct": F.size(F.array_distinct("words")).cast("long"),
                "n_symbols": F.expr("length(regexp_replace(__t, '[^#*$%&|<>]+', ''))").cast("long"),
                "n_letters": F.expr(r"length(regexp_replace(__t, '\\P{L}+', ''))").cast("long"),
                "n_marked": F.expr("if(__t rlike '[#*$%&|<>]', size(filter(words, w -> w rlike '[#*$%&|<>]')), 0)").cast("long"),
                "n_capitals": F.expr(r"length(regexp_replace(__t, '\\P{Lu}+', ''))").cast("long"),
                "n_shouts": F.expr("length(regexp_replace(__t, '[^!]+', ''))").cast("long"),
                "n_lines": F.size("__l").cast("long"),
                "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
                "n_repeat_words": F.expr(repeated()).cast("long"),
            }
        )
        .drop("__t", "__l", "words")
    )


FEATURES = ["n_words", "word_chars", "n_distinct", "n_symbols", "n_letters", "n_marked", "n_capitals", "n_shouts", "n_lines", "n_dup_lines", "n_repeat_words"]


def vote(rule: str) -> str:
    bad, good = RULES[rule]
    return f"case when {bad} then -1 when {good} then 1 else 0 end"


def estimate(patterns: list[tuple[tuple[int, ...], int]], turns: int = TURNS) -> tuple[float, dict]:
    """From the number of rows with each vote pattern: the share of good texts, and rates[class][rule][vote]."""
    rules = list(RULES)
    good, rates = START_GOOD, {c: {r: dict(START[c]) for r in rules} for c in (0, 1)}
    total = sum(n for _, n in patterns)
    for _ in range(turns if total else 0):
        sums = {c: {r: {v: PSEUDO * START[c][v] for v in (-1, 0, 1)} for r in rules} for c in (0, 1)}
        share = 0.0
        for votes, n in patterns:
            weight = {c: (good if c else 1 - good) * math.prod(rates[c][r][v] for r, v in zip(rules, votes)) for c in (0, 1)}
            q = weight[1] / (weight[0] + weight[1])
            share += n * q
            for r, v in zip(rules, votes):
                sums[1][r][v] += n * q
                sums[0][r][v] += n * (1 - q)
        good = (share + PSEUDO * START_GOOD) / (total + PSEUDO)
        rates = {c: {r: {v: x / sum(by.values()) for v, x in by.items()} for r, by in sums[c].items()} for c in (0, 1)}
    return good, rates


def log_odds(good: float, rates: dict) -> str:
    """SQL for the log odds that a text is good, from its vote_ columns."""
    parts = [f"{math.log(good / (1 - good))!r}D"]
    for r in RULES:
        by = {v: math.log(rates[1][r][v] / rates[0][r][v]) for v in (-1, 0, 1)}
        parts.append(f"(case vote_{r} when -1 then {by[-1]!r}D when 0 then {by[0]!r}D else {by[1]!r}D end)")
    return " + ".join(parts)


def _voted(looked: DataFrame) -> DataFrame:
    return looked.withColumns({f"vote_{r}": F.expr(vote(r)) for r in RULES})


def _fit(looked: DataFrame) -> str:
    counted = _voted(looked).groupBy(*[f"vote_{r}" for r in RULES]).count().collect()
    return log_odds(*estimate(sorted((tuple(x[f"vote_{r}"] for r in RULES), x["count"]) for x in counted)))


def judged(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """For each row: doc_id, the features, base_failed, quality (the posterior) and kept."""
    looked = shared.cut(spark, features(docs.select("doc_id", "text")).select("doc_id", *FEATURES))
    odds = _fit(looked)
    return (
        _voted(looked)
        .withColumn("base_failed", F.expr(BASE_FAILED))
        .withColumn("quality", F.expr(f"1 / (1 + exp(-({odds})))"))
        .withColumn("kept", F.expr("not base_failed and quality >= 0.5D"))
        .drop(*[f"vote_{r}" for r in RULES])
    )


def kept(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with their columns, that are kept. The features are made once and written beside the rows: no text is shuffled."""
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col("text"))
    looked = shared.cut(spark, features(inner).select("__row", *FEATURES))
    odds = _fit(looked.select(*FEATURES))
    return _voted(looked).filter(F.expr(f"not ({BASE_FAILED}) and ({odds}) >= 0")).select("__row.*")


def sql() -> str:
    """DuckDB SQL of the query: features, votes, and each turn of the estimation as a table."""
    rules = list(RULES)
    duck = lambda x: x.replace("D *", " *")
    cells = [(c, r, v) for c in (0, 1) for r in rules for v in (-1, 0, 1)]
    name = lambda c, r, v: f"p{c}_{r}_{v + 1}"
    start = ", ".join(f"{START[c][v]}::double as {name(c, r, v)}" for c, r, v in cells)
    out = [
        r"""with t as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from t),
g as (select doc_id, i, hash(words[i], words[i + 1], words[i + 2]) as h from (select doc_id, words, unnest(range(1, len(words) - 1)) as i from w)),
d as (select doc_id, i from g qualify count(*) over (partition by doc_id, h) > 1),
r as (select doc_id, sum(least(3, i - before)) as n from (select doc_id, i, lag(i, 1, -5) over (partition by doc_id order by i) as before from d) group by doc_id),
f as (select w.doc_id, len(words)::bigint as n_words, coalesce(length(list_aggregate(words, 'string_agg', '')), 0)::bigint as word_chars, len(list_distinct(words))::bigint as n_distinct,
length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols, length(regexp_replace(t, '\P{Lu}+', '', 'g'))::bigint as n_capitals,
length(regexp_replace(t, '\P{L}+', '', 'g'))::bigint as n_letters, len(list_filter(words, lambda x: regexp_matches(x, '[#*$%&|<>]')))::bigint as n_marked, length(regexp_replace(t, '[^!]+', '', 'g'))::bigint as n_shouts,
len(l)::bigint as n_lines, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(r.n, 0)::bigint as n_repeat_words from w left join r on r.doc_id is not distinct from w.doc_id),
v as materialized (select *, """
        + ", ".join(f"{duck(vote(r))} as vote_{r}" for r in rules)
        + " from f),\nk as materialized (select "
        + ", ".join(f"vote_{r}" for r in rules)
        + ", count(*) as n from v group by all),\n"
        + f"m0 as (select {START_GOOD}::double as good, {start})"
    ]
    def side(c):
        return f"({'good' if c else '(1 - good)'} * " + " * ".join(f"(case vote_{r} when -1 then {name(c, r, -1)} when 0 then {name(c, r, 0)} else {name(c, r, 1)} end)" for r in rules) + ")"
    for k in range(TURNS):
        out.append(f"q{k} as materialized (select k.*, {side(1)} / ({side(0)} + {side(1)}) as q from k, m{k})")
        sums = ", ".join(f"coalesce(sum(case when vote_{r} = {v} then n * {'q' if c else '(1 - q)'} end), 0) + {PSEUDO * START[c][v]} as {name(c, r, v)}" for c, r, v in cells)
        out.append(f"s{k} as materialized (select (sum(n * q) + {PSEUDO * START_GOOD}) / (sum(n) + {PSEUDO}) as good, {sums} from q{k})")
        out.append(f"m{k + 1} as materialized (select good, " + ", ".join(f"{name(c, r, v)} / ({' + '.join(name(c, r, x) for x in (-1, 0, 1))}) as {name(c, r, v)}" for c, r, v in cells) + f" from s{k})")
    return (
        ",\n".join(out)
        + f"\nselect doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({BASE_FAILED}) as base_failed, (not ({BASE_FAILED}) and {side(1)} >= {side(0)}) as kept from v, m{TURNS}"
    )
