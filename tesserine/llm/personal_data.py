"""Personal data: candidates from high-recall generators, gradient-boosted trees, calibrated selection.

Exact patterns with checks (e-mail, address, Luhn, digit counts) give the base
spans, which always stay. Wide generators propose further spans, which may
overlap those and each other: groups of digits with any separators, and handles
with a spelt-out or spaced at sign. Each candidate has a format (digits,
separators, length) and a context (what stands left and right) in a few classes.

The labels are weak and cover a part of the candidates. One that overlaps a base span is an
example of personal data; one that a check refuses (a wrong check digit, a part over
255, a bad number of digits), that is glued to letters, or whose at sign stands before the end
of a sentence, is a counterexample. What the base patterns can't judge, such as a spelt-out
address or a number without its plus, has no label: the trees learn from the others, don't see
what tells the base kinds apart (a plus, an at sign, the check), and choose among these
only. So neither a base span nor what a check refused is proposed again. Examples of all
rows are counted by class, so what reaches the driver is bounded by the product of the
classes, not by the data. Every fifth document is kept from the trees and calibrates their
score (Platt) for each generator, which has its own threshold in PICK.

All work on rows is DataFrame expressions: matches and the gaps between them give
offsets in code points. Patterns begin where a run begins and take runs
possessively, which finds the same matches in time linear in the text; sums along a
text are made in blocks, so that no array is copied once for each match.

Edge cases: a null text is an empty one, without spans. Repeated rows and a null
doc_id are judged by themselves; an empty table chooses no candidates. Only
doc_id and text are looked at.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.llm import shared

#: Calibrated probability from which a candidate of a generator is chosen.
PICK = {"number": 0.9, "handle": 0.8}
KINDS = ("email", "ip", "card", "phone", "number", "handle")
BASE = 4
#: What the patterns begin with is only there to start at the first character of a run, or where the last match ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "number": r"\+?\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+",
    "handle": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,64}+(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]{1,64}+){1,8}+",
}
#: A text without this has no match.
HINTS = {"email": "t like '%@%'", "ip": "t rlike '[0-9]'", "card": "t rlike '[0-9]'", "phone": "t like '%+%'", "number": "t rlike '[0-9]'", "handle": "(t like '%@%' or t like '%at)%' or t like '%at]%')"}
_LUHN = """aggregate(sequence(1, length(d)), 0, (a, i) -> a + transform(array(int(substring(d, length(d) - i + 1, 1)) * (2 - i % 2)), y -> if(y > 9, y - 9, y))[0]) % 10 = 0"""
CHECKS = {
    "email": "true",
    "ip": r"x.s rlike r'^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$'",
    "card": f"transform(array(regexp_replace(x.s, '[^0-9]', '')), d -> if(length(d) between 12 and 19, {_LUHN}, false))[0]",
    "phone": "length(regexp_replace(x.s, '[^0-9]', '')) between 9 and 15",
}
#: A match that has a check but isn't personal data.
REFUSED = {
    "ip": f"not ({CHECKS['ip']})",
    "card": f"transform(array(regexp_replace(x.s, '[^0-9]', '')), d -> if(length(d) between 12 and 19, not ({_LUHN}), false))[0]",
    "phone": "length(regexp_replace(x.s, '[^0-9]', '')) not between 9 and 15",
}
_SPAN = "struct<start:int,kind:int,end:int,s:string,l:string,r:string>"
#: Elements that are added up at a time.
BLOCK = 256


def running(items: str, kind: str, first: str, step: str) -> str:
    """SQL: for each element x of an array, what ``step`` has made of p, which begins as ``first``, with the elements before it.

    Blocks are gone through twice: for what they begin with, and for what stands in them."""
    blocks = f"sequence(0, (size(xs) - 1) div {BLOCK})"
    block = f"slice(xs, b * {BLOCK} + 1, {BLOCK})"
    empty = f"cast(array() as array<{kind}>)"
    starts = f"aggregate({blocks}, named_struct('p', {first}, 'out', {empty}), (a, b) -> named_struct('p', aggregate({block}, a.p, (p, x) -> {step}), 'out', concat(a.out, array(a.p))), a -> a.out)"
    within = f"aggregate({block}, named_struct('p', starts[b], 'out', {empty}), (a, x) -> named_struct('p', transform(array(a.p), p -> {step})[0], 'out', concat(a.out, array(a.p))), a -> a.out)"
    return f"transform(array({items}), xs -> if(size(xs) = 0, {empty}, transform(array({starts}), starts -> flatten(transform({blocks}, b -> {within})))[0]))[0]"


def _found(kind: str, around: bool = False) -> str:
    """SQL: the matches of a kind in t, with their offsets in code points; ``around``: and the characters beside them."""
    k, p = KINDS.index(kind), PATTERNS[kind]
    sides = "if(i = 0 or v.g[i] <> '', right(v.g[i], 1), right(v.m[i - 1], 1)), 'r', if(v.g[i + 1] <> '', left(v.g[i + 1], 1), if(i + 1 < size(v.m), left(v.m[i + 1], 1), ''))" if around else "'', 'r', ''"
    before = running("transform(v.m, (y, i) -> length(y) + length(v.g[i]))", "int", "0", "p + x")
    return f"""if({HINTS[kind]}, transform(array(named_struct('m', regexp_extract_all(t, r'{p}', 0), 'g', split(t, r'{p}', -1))), v ->
    transform({before}, (at, i) -> named_struct('start', at + length(v.g[i]), 'kind', {k}, 'end', at + length(v.g[i]) + length(v.m[i]), 's', v.m[i], 'l', {sides})))[0], cast(array() as array<{_SPAN}>))"""


def _meets(others: str) -> str:
    """SQL: of ``wide``, in order, whether each meets one of the spans in ``others``: from the spans sorted together, by the greatest end before and the least start after."""
    events = f"sort_array(concat(transform({others}, x -> named_struct('start', x.start, 'own', 0, 'end', x.end)), transform(wide, x -> named_struct('start', x.start, 'own', 1, 'end', x.end))))"
    ends = running("e", "int", "-1", "greatest(p, if(x.own = 0, x.end, -1))")
    starts = running("reverse(e)", "int", "2147483647", "least(p, if(x.own = 0, x.start, 2147483647))")
    return f"""if(size({others}) = 0 or size(wide) = 0, transform(wide, x -> false), transform(array({events}), e -> transform(array(named_struct('a', {ends}, 'b', reverse({starts}))), m ->
    transform(filter(transform(e, (x, i) -> named_struct('own', x.own, 'hit', m.a[i] > x.start or m.b[i] < x.end)), x -> x.own = 1), x -> x.hit))[0])[0])"""


_SIDE = r"case when {0} = '' then 0 when {0} rlike r'\s' then 1 when {0} rlike r'[\p{{L}}\p{{N}}]' then 2 else 3 end"
#: SQL: a candidate with its signs as they are usually written, which is how its format is looked at.
_PLAIN = r"if(c.kind = 5, regexp_replace(regexp_replace(c.s, r'\x20?(?:@|\(at\)|\[at\])\x20?', '@'), r'\x20?(?:\.|\(dot\)|\[dot\])\x20?', '.'), c.s)"
#: Classes of a candidate c, whose digits are z.d and which is plainly written z.q: SQL and the number of classes.
CLASSES = {
    "generator": (f"c.kind - {BASE}", 2),
    "digits": ("case when length(z.d) < 7 then 0 when length(z.d) < 9 then 1 when length(z.d) < 12 then length(z.d) - 7 when length(z.d) < 16 then 5 when length(z.d) = 16 then 6 else 7 end", 8),
    "separators": ("least(3, length(regexp_replace(z.q, '[^ ()-]', '')))", 4),
    "dots": ("least(3, length(regexp_replace(z.q, '[^.]', '')))", 4),
    "left": (_SIDE.format("c.l"), 4),
    "right": (_SIDE.format("c.r"), 4),
}
#: A counterexample, whatever stands elsewhere: a number glued to letters, an at sign before the end of a sentence.
ODD = r"(c.kind = 4 and (c.l rlike r'[\p{L}\p{N}_]' or c.r rlike r'[\p{L}\p{N}_]')) or (c.kind = 5 and c.s rlike r' @ ' and c.s rlike r'\. ')"


def spans_of(docs: DataFrame, *keep: str) -> DataFrame:
    """Of each row, ``base``: the checked spans in order, and ``wide``: the candidates in order, with their classes and their label, 1, 0 or none."""
    t = docs.withColumn("t", F.coalesce(F.col("text").cast("string"), F.lit("")))
    for kind in KINDS[:BASE]:
        t = t.withColumn(f"__{kind}", F.expr(_found(kind)))
    t = t.withColumn("base", F.expr("sort_array(concat(" + ", ".join(f"filter(__{k}, x -> {CHECKS[k]})" for k in KINDS[:BASE]) + "))"))
    t = t.withColumn("refused", F.expr("concat(" + ", ".join(f"filter(__{k}, x -> {check})" for k, check in REFUSED.items()) + ")"))
    classes = ", ".join(f"'{name}', cast({code} as int)" for name, (code, _) in CLASSES.items())
    t = t.withColumn("wide", F.expr("sort_array(concat(" + ", ".join(_found(k, True) for k in KINDS[BASE:]) + "))"))
    t = t.withColumn("__hits", F.expr(_meets("base"))).withColumn("__refused", F.expr(_meets("refused")))
    # zipped, as an array looked up within a lambda may be made again for each element
    label = f"if(y.__hits, 1, if(y.__refused or {ODD}, 0, null))"
    plain = f"named_struct('d', regexp_replace(c.s, '[^0-9]', ''), 'q', {_PLAIN})"
    one = f"named_struct('start', c.start, 'kind', c.kind, 'end', c.end, 's', c.s, {classes}, 'label', {label})"
    t = t.withColumn("wide", F.expr(f"transform(arrays_zip(wide, __hits, __refused), y -> transform(array(y.wide), c -> transform(array({plain}), z -> {one})[0])[0])"))
    return t.select(*keep, F.expr("transform(base, x -> named_struct('start', x.start, 'kind', x.kind, 'end', x.end, 's', x.s))").alias("base"), "wide")


def boost(x: np.ndarray, n: np.ndarray, hits: np.ndarray, rounds: int = 30, rate: float = 0.3, depth: int = 3) -> list:
    """Gradient-boosted trees on counted examples: rows of classes ``x``, of which ``hits`` of ``n`` are positive.

    A tree is a leaf's value or (column, threshold, tree for values up to it, tree for the others)."""

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left: int):
        total_g, total_h = g[rows].sum(), h[rows].sum()
        leaf = rate * total_g / (total_h + 1.0)
        best, where = 1e-6, None
        if left:
            for c in range(x.shape[1]):
                for cut in np.unique(x[rows, c])[:-1]:
                    a = rows[x[rows, c] <= cut]
                    ga, ha = g[a].sum(), h[a].sum()
                    gain = ga**2 / (ha + 1) + (total_g - ga) ** 2 / (total_h - ha + 1) - total_g**2 / (total_h + 1)
                    if gain > best:
                        best, where = gain, (c, int(cut))
        if where is None:
            return float(leaf)
        c, cut = where
        return c, cut, grow(rows[x[rows, c] <= cut], g, h, left - 1), grow(rows[x[rows, c] > cut], g, h, left - 1)

    trees, score = [], np.zeros(len(n))
    for _ in range(rounds if len(n) else 0):
        p = 1 / (1 + np.exp(-score))
        trees.append(grow(np.arange(len(n)), hits - n * p, n * p * (1 - p) + 1e-9, depth))
        score += values([trees[-1]], x)
    return trees


def values(trees: list, x: np.ndarray) -> np.ndarray:
    """The sum of the trees for each row of classes."""
    out = np.zeros(len(x))

    def walk(tree, rows: np.ndarray) -> None:
        if isinstance(tree, tuple):
            c, cut, low, high = tree
            walk(low, rows[x[rows, c] <= cut])
            walk(high, rows[x[rows, c] > cut])
        else:
            out[rows] += tree

    for tree in trees:
        walk(tree, np.arange(len(x)))
    return out


def platt(score: np.ndarray, n: np.ndarray, hits: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve from score to probability, by damped Newton steps with a weak prior on slope 1."""

    def loss(a: float, b: float) -> float:
        z = a * score + b
        return float((n * np.logaddexp(0, z) - hits * z).sum() + (a - 1) ** 2 / 2 + 0.05 * b * b)

    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * score + b, -30, 30)))
        r, w = hits - n * p, n * p * (1 - p)
        g = np.array([(r * score).sum() - (a - 1), r.sum() - 0.1 * b])
        m = np.array([[(w * score * score).sum() + 1, (w * score).sum()], [(w * score).sum(), w.sum() + 0.1]])
        step, size = np.linalg.solve(m, g), 1.0
        while size > 1e-6 and loss(a + size * step[0], b + size * step[1]) > loss(a, b):
            size /= 2
        a, b = a + size * step[0], b + size * step[1]
    return float(a), float(b)


def _sql(tree, names: list[str]) -> str:
    if not isinstance(tree, tuple):
        return f"{tree!r}D"
    c, cut, low, high = tree
    return f"if(c.{names[c]} <= {cut}, {_sql(low, names)}, {_sql(high, names)})"


def fit(found: DataFrame) -> str:
    """SQL: whether candidate c is chosen. ``found``: (fold, wide); rows of fold 0 calibrate."""
    names = list(CLASSES)
    counted = found.select("fold", F.explode("wide").alias("c")).filter("c.label is not null").groupBy((F.col("fold") == 0).alias("held"), *[F.col(f"c.{x}").alias(x) for x in names]).agg(F.count("*").alias("n"), F.sum("c.label").alias("hits")).collect()
    rows = sorted((bool(r["held"]), *[r[x] for x in names], r["n"], r["hits"]) for r in counted)
    if not rows:
        return "false"
    x = np.array([r[1:-2] for r in rows], np.int64)
    n, hits, held = np.array([r[-2] for r in rows], float), np.array([r[-1] for r in rows], float), np.array([r[0] for r in rows])
    trees = boost(x[~held], n[~held], hits[~held])
    if not trees:
        return "false"
    score = values(trees, x)
    rules = []
    for k, generator in enumerate(KINDS[BASE:]):
        mine = held & (x[:, 0] == k)
        a, b = platt(score[mine], n[mine], hits[mine]) if mine.any() else (1.0, 0.0)
        if a > 0 and (x[:, 0] == k).any():
            least = PICK[generator]
            rules.append(f"(c.generator = {k} and {a!r}D * score + {b!r}D >= {math.log(least / (1 - least))!r}D)")
    return f"exists(array({' + '.join(_sql(t, names) for t in trees)}), score -> {' or '.join(rules)})" if rules else "false"


def _chosen(rule: str) -> str:
    """SQL: base spans and the chosen candidates of those without a label, in order."""
    return f"sort_array(concat(base, transform(filter(wide, c -> c.label is null and {rule}), c -> named_struct('start', c.start, 'kind', c.kind, 'end', c.end, 's', c.s))))"


def joined(array: str) -> str:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform({array}, x -> concat({names}[x.kind], ':', x.start, ':', x.end)), ',')"


def personal_spans(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """For each row: doc_id, base and found, arrays of (start, kind, end, s); kind is a place in KINDS."""
    fold = F.expr("pmod(xxhash64(doc_id), 5)").alias("fold")
    found = shared.cut(spark, spans_of(docs.select("doc_id", "text"), "doc_id"))
    rule = fit(found.select(fold, "wide"))
    return found.select("doc_id", "base", F.expr(_chosen(rule)).alias("found"))


#: SQL: text, of which the spans in found are named. It is cut into pieces of PIECE characters, so that what stands between two spans
#: is taken out of one or a few of them. A span that begins before an earlier one ends adds to that one.
PIECE = 1024
_NAMES = "array(" + ", ".join(f"'<{k}>'" for k in KINDS) + ")"


def _between(low: str, high: str) -> str:
    """SQL: the characters from ``low`` to ``high`` of the text in pieces."""
    begin = f"greatest(z.a - k * {PIECE}, 0)"
    return f"""transform(array(named_struct('a', {low}, 'b', {high})), z -> if(z.b <= z.a, '', array_join(transform(sequence(z.a div {PIECE}, (z.b - 1) div {PIECE}), k -> substring(pieces[int(k)], {begin} + 1, least(z.b - k * {PIECE}, {PIECE}) - {begin})), '')))[0]"""


_REDACTED = f"""if(size(found) = 0, text, transform(array(regexp_extract_all(text, r'(?s).{{1,{PIECE}}}', 0)), pieces -> transform(array({running("found", "int", "0", "greatest(p, x.end)")}), at ->
    concat(array_join(transform(found, (f, i) -> if(f.start < at[i], '', concat({_between("at[i]", "f.start")}, {_NAMES}[f.kind]))), ''), {_between("greatest(at[size(at) - 1], found[size(found) - 1].end)", "length(text)")}))[0])[0])"""


def redacted(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with each found span of its text replaced by its kind in angle brackets; overlapping spans become one. n_chars, if there, follows."""
    named = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*named).alias("__row"), "text")
    rule = fit(shared.cut(spark, spans_of(docs.select("doc_id", "text"), F.expr("pmod(xxhash64(doc_id), 5)").alias("fold")).select("fold", "wide")))
    out = spans_of(rows, "__row", "text").select("__row", F.col("text").cast("string").alias("text"), F.expr(_chosen(rule)).alias("found")).select("__row", F.expr(_REDACTED).alias("__new"))
    return out.select(*[F.col("__new").alias(c) if c == "text" else (F.length("__new").cast("long").alias(c) if c == "n_chars" else F.col(f"__row.`{c}`").alias(c)) for c in docs.columns])
