"""Vector arithmetic as Column expressions over arrays (M1-M3, A7): all sums in double."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def literal(values: Sequence[float]) -> Column:
    """A query vector as a constant."""
    return F.array(*[F.lit(float(x)) for x in values])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Unclamped; 0 where a vector is zero, null where one is null."""
    na, nb = norm(a), norm(b)
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))


def similarity(a: Column, b: Column) -> Column:
    """M1: cosine clamped to [0, 1]."""
    c = cosine(doubles(a), doubles(b))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def normalised(v: Column) -> Column:
    """M3: divided by its length, at least 1e-12."""
    d = doubles(v)
    length = F.greatest(norm(d), F.lit(1e-12))
    return F.transform(d, lambda x: x / length)


def masked_mean(tokens: Column, mask: Column, size: int) -> Column:
    """The mean of the token vectors that the mask keeps, by their weight; a mask of zeros gives zeros, as the weight counts 1e-9 at least."""
    weight = F.greatest(F.aggregate(mask, F.lit(0.0), lambda s, m: s + m.cast("double")), F.lit(1e-9))
    zero = F.array_repeat(F.lit(0.0), size)
    weighed = F.zip_with(tokens, mask, lambda v, m: F.transform(doubles(v), lambda x: x * m.cast("double")))
    total = F.aggregate(weighed, zero, lambda s, v: F.zip_with(s, v, lambda a, b: a + b))
    return F.transform(total, lambda x: x / weight)
