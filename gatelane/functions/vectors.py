"""Vector arithmetic on ``ARRAY<FLOAT|DOUBLE>`` columns, computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Dot product over the shorter of the two lengths."""
    products = F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0)))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    squares = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return F.sqrt(squares)


def l2_normalize(v: Column) -> Column:
    """Unit vector; NULL for a zero vector."""
    length = norm(v)
    return F.when(length > 0, F.transform(v, lambda x: x.cast("double") / length))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; NULL if either vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def mean_pool(vectors: Column) -> Column:
    """Mean of a short array of vectors held in one row (token vectors of one text)."""
    count = F.size(vectors)
    first = F.transform(vectors[0], lambda x: F.lit(0.0))
    total = F.aggregate(vectors, first, lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y.cast("double")))
    return F.when(count > 0, F.transform(total, lambda x: x / count))
