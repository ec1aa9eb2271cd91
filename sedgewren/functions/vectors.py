"""Vector expressions over array columns, in double arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NORM_FLOOR = 1e-12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """Unit vector; null where the squared length is under NORM_FLOOR."""
    # As an element of an array the length has a name: an expression inside the inner function would be worked out for each x.
    scaled = F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: x.cast("double") / n))
    return F.when(dot(v, v) >= NORM_FLOOR, F.get(scaled, F.lit(0)))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + NORM_FLOOR)
