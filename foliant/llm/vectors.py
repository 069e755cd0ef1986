"""What the operators on embeddings share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sound(embedding: str) -> Column:
    """Vectors of finite components, not all 0."""
    v = F.col(embedding)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def numbered(df: DataFrame, key: str) -> Column:
    """The key as a long. Operators whose results hold least keys take whole numbers only."""
    kind = df.schema[key].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{key} must be a column of whole numbers, not {kind}")
    return F.col(key).cast("long")


def by_length(cases: dict[int, int]) -> Column:
    """The value of a vector's length (column dim)."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in cases.items() for x in pair]), F.col("dim"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column, all of length dim."""
    column = column if isinstance(column, pa.Array) else column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), dim)
