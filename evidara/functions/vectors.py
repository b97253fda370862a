"""Vector arithmetic on array columns, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def inner(a: Column, b: Column) -> Column:
    """Inner product; null where lengths differ."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine with a norm of 0 taken as 1, and 0 where lengths differ."""
    na, nb = norm(a), norm(b)
    one = lambda n: F.when(n == 0, F.lit(1.0)).otherwise(n)
    return F.coalesce(inner(a, b) / (one(na) * one(nb)), F.lit(0.0))
