"""Vector functions on ``array<float>`` columns, in double precision, JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ragstone.functions.text import bound


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalise(a: Column) -> Column:
    """The unit vector; null for a zero vector."""
    return bound(norm(a), lambda n: F.when(n > 0, F.transform(a, lambda x: (x.cast("double") / n).cast("float"))))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Null if a vector is null, zero, or the lengths differ."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n)


def cosine_distance(a: Column, b: Column) -> Column:
    """0 for the same direction, 1 for orthogonal, 2 for opposite."""
    return F.lit(1.0) - cosine_similarity(a, b)


def l2_distance(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == F.size(b), F.sqrt(F.aggregate(
        F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, d: s + d * d)))


def negative_inner_product(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == F.size(b), -dot(a, b))


def has_dim(a: Column, dim: int) -> Column:
    """Schema check of a fixed-length vector column."""
    return F.size(a) == dim
