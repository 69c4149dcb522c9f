"""What both vector operators need: which rows take part, and rows as a matrix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(vec: str) -> Column:
    """True for a vector with at least one component, all of them finite numbers."""
    return F.coalesce(F.expr(f"size(`{vec}`) > 0 AND forall(`{vec}`, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"), F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Doubles of list rows that all have ``dim`` components."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
