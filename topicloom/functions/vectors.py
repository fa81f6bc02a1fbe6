"""Vector expressions on ``array<double>`` or ``array<float>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_doubles(v), F.lit(0.0), lambda acc, x: acc + x * x))


def normalise(v: Column) -> Column:
    """Unit vector; a zero vector stays zero."""
    # the repeated length is computed once; inside a lambda it would be computed per element
    lengths = F.array_repeat(norm(v), F.size(v))
    return F.zip_with(as_doubles(v), lengths, lambda x, n: F.when(n > 0, x / n).otherwise(x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if one vector is zero."""
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, dot(a, b) / lengths).otherwise(F.lit(0.0))
