"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 where a vector is zero."""
    length = norm(a) * norm(b)
    return F.when(length > 0, dot(a, b) / length).otherwise(F.lit(0.0))


def normalised(v: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    n = norm(v)
    return F.when(n > 0, F.transform(doubles(v), lambda x: x / n)).otherwise(doubles(v))


def mean_pooled(token_vectors: Column, mask: Column) -> Column:
    """The mean of the token vectors whose mask is 1, element by element."""
    kept = F.transform(F.filter(F.arrays_zip(token_vectors.alias("v"), mask.alias("m")), lambda z: z["m"] == 1), lambda z: doubles(z["v"]))
    total = F.aggregate(F.slice(kept, 2, F.greatest(F.size(kept) - 1, F.lit(0))), kept[0], lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    return F.when(F.size(kept) > 0, F.transform(total, lambda x: x / F.size(kept)))


def literal(values) -> Column:
    return F.array(*(F.lit(float(x)) for x in values))
