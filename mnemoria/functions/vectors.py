"""Vector arithmetic on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products; null where lengths differ."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_given_norms(a: Column, b: Column, norm_a: Column, norm_b: Column) -> Column:
    """Cosine from stored norms; 0 where either is 0."""
    return F.when(norm_a * norm_b == 0, F.lit(0.0)).otherwise(dot(a, b) / (norm_a * norm_b))


def cosine(a: Column, b: Column) -> Column:
    return cosine_given_norms(a, b, norm(a), norm(b))


def l2(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x)))


def mean_of(a: Column, b: Column) -> Column:
    """Element-wise mean of two embeddings; the other one where one is null or empty."""
    both = F.zip_with(a, b, lambda x, y: (x + y) / 2)
    return F.when(F.coalesce(F.size(a), F.lit(0)) <= 0, b).when(F.coalesce(F.size(b), F.lit(0)) <= 0, a).otherwise(both)


def literal(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])
