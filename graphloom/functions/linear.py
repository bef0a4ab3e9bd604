"""Vector functions over arrays, summed in double precision."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TINY = 1e-8


def dot(a: Column, b: Column) -> Column:
    """The inner product; null if either is null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def soft_cosine(a: Column, b: Column, tiny: float = TINY) -> Column:
    """Cosine similarity with a little added to both lengths, so that a zero vector gives 0."""
    return dot(a, b) / ((norm(a) + tiny) * (norm(b) + tiny))
