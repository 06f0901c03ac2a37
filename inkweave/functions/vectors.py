"""Vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for null, empty or zero vectors and for different lengths."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (size > 0), dot(a, b) / size).otherwise(F.lit(0.0))


def unit(a: Column) -> Column:
    """The vector over its length as array<double>, so that a dot product is a cosine; null for a zero vector."""
    size = F.sqrt(dot(a, a))
    return F.when(size > 0, F.get(F.transform(F.array(size), lambda n: F.transform(a, lambda x: x.cast("double") / n)), F.lit(0)))
