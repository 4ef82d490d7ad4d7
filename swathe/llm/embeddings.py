"""What the embedding operators (11 to 13) share: which vectors take part, and Arrow lists as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Components beyond this could leave the range of 64-bit integers once scaled, squared and summed.
LARGEST = 4096.0


def whole_vectors(rows: DataFrame, *kept: str, column: str = "embedding") -> tuple[DataFrame, int]:
    """``vec_id, vector, *kept`` of the rows that take part, and the length of their vectors.

    Left out are vectors that are null or empty, or hold a null, a non-finite component or one beyond
    ``LARGEST``, and those of another length than the most frequent one (ties: the longer).
    """
    vector = F.col(column).cast("array<double>")
    # A NaN is larger than every number here.
    fits = F.forall("vector", lambda x: F.coalesce(F.abs(x) <= LARGEST, F.lit(False)))
    plain = rows.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"), *kept).where(
        F.col("vector").isNotNull() & (F.size("vector") > 0) & fits)
    sizes = plain.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    length = sizes["size"] if sizes else 0
    return plain.where(F.size("vector") == length), length


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)
