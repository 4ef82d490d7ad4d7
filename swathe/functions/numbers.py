"""Small numeric helpers on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def clip(value, low: float, high: float) -> Column:
    """Bound a value; NULL stays NULL (plain least/greatest would skip it)."""
    value = as_col(value)
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def round_even(value, digits: int) -> Column:
    """Half-to-even rounding, as the scores are defined."""
    return F.bround(as_col(value), digits)


def share(condition: Column) -> Column:
    """Aggregate: fraction of rows that satisfy a condition."""
    return F.avg(condition.cast("double"))


def count_where(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("long")
