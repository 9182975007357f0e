"""Vector expressions over ``array<double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seasoncast.functions.parse import col_of

__all__ = ["as_double_array", "dot", "l2_norm", "cosine", "normalize"]


def as_double_array(c) -> Column:
    return col_of(c).cast("array<double>")


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(as_double_array(a), as_double_array(b), lambda x, y: x * y),
                       F.lit(0.0), lambda acc, v: acc + v)


def l2_norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    """Cosine similarity computed in double precision; null if a vector is zero."""
    return F.try_divide(dot(a, b), l2_norm(a) * l2_norm(b))


def normalize(a) -> Column:
    """Unit-length vector; a zero vector stays zero."""
    n = l2_norm(a)
    return F.transform(as_double_array(a),
                       lambda x: F.when(n == 0, F.lit(0.0)).otherwise(x / n))
