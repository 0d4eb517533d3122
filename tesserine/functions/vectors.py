"""Vector functions as Columns (V1-V6, V13), in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-8


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def _divided(a: Column, by) -> Column:
    """``a`` over by(its norm), which is computed once: the vector and its norm are bound as a struct."""
    bound = F.array(F.struct(a.alias("v"), by(norm(a)).alias("n")))
    return F.transform(bound, lambda s: F.transform(s["v"], lambda e: e / s["n"]))[0]


def l2_normalize(a: Column) -> Column:
    """V1: divided by its norm where that is over 1e-8."""
    return _divided(a, lambda n: F.when(n > TINY, n).otherwise(F.lit(1.0)))


def clamp_normalize(a: Column) -> Column:
    """V2: divided by its norm, at least 1e-8."""
    return _divided(a, lambda n: F.greatest(n, F.lit(TINY)))


def cosine(a: Column, b: Column) -> Column:
    """V3: 0 if either norm is under 1e-8."""
    na, nb = norm(a), norm(b)
    return F.when((na < TINY) | (nb < TINY), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))


def cosine_eps(a: Column, b: Column) -> Column:
    """V4: with 1e-8 added to the product of the norms."""
    return dot(a, b) / (norm(a) * norm(b) + TINY)


def histogram_intersection(a: Column, b: Column) -> Column:
    """The sum of smaller values."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0.0), lambda s, x: s + x)


def half_precision(x: Column) -> Column:
    """V5 and V6: rounded to the nearest IEEE half, ties to even, as a double."""
    q = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.abs(x))), F.lit(-14)) - 10)
    return F.when(x == 0, F.lit(0.0)).otherwise(F.rint(x / q) * q)
