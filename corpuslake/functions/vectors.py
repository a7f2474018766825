"""Vectors: dimension checks and cosine similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Exact to double; null elements or unequal sizes give null."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0.0), lambda s, x: s + x))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity; null for a zero vector, where it is undefined."""
    return F.try_divide(dot(a, b), (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b))


def has_dimensions(a: Column, n: int) -> Column:
    return F.size(a) == n


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])
