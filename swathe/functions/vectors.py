"""Vector expressions over array<float> columns (all arithmetic in double)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double")))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` reads it.

    Inside a lambda an outer expression is evaluated for every element; binding
    it as the one element of an array avoids that.
    """
    return F.transform(F.array(value), use)[0]


def l2_normalize(v: Column) -> Column:
    """Unit-length copy of a vector; an all-zero vector stays as it is."""
    scaled = lambda vec, n: F.transform(vec, lambda x: x.cast("double") / n)
    length = lambda vec: F.coalesce(F.nullif(norm(vec), F.lit(0.0)), F.lit(1.0))
    return let(v, lambda vec: let(length(vec), lambda n: scaled(vec, n)))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + F.lit(1e-7))


def vector_literal(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])
