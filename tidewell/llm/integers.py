"""Vectors of exact integers: floor(scale * component) of each, read from Arrow batches, and what bounds their distances."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components stay below this magnitude, so that squared distances of up to 64 components fit into 63 bits.
MOST = 1 << 27


def usable(vector: str, dims: int) -> Column:
    """Whether a vector has ``dims`` components, none of them null, NaN or infinite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce((F.size(vector) == dims) & fine, F.lit(False))


def rounded(column: pa.Array, dims: int, scale: int) -> np.ndarray:
    """The rows of a list column without nulls as int64, floor(scale * x) with x as double."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    low = np.floor(scale * x)
    if len(low) and np.abs(low).max() >= MOST:
        raise OverflowError(f"a component times {scale} reaches {MOST}: its squared distances would exceed 63 bits")
    return low.astype(np.int64)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column of ints as int64."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def few(frame: DataFrame, most: int) -> bool:
    """Whether ``frame`` has at most ``most`` rows; reads no more than one more."""
    return frame.limit(most + 1).count() <= most
