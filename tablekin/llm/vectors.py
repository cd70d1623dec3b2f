"""Vectors of whole numbers, made of float entries, for the operators on embeddings."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tablekin.llm.common import shipped

shipped(__name__)

SCALE = 256


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its entries are, as finite numbers."""
    return F.coalesce(
        F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))), F.lit(False))


def largest(vector: Column) -> Column:
    """The largest absolute entry times SCALE; 0 of an empty vector."""
    return F.coalesce(F.array_max(F.transform(vector, lambda c: F.abs(c) * SCALE)), F.lit(0.0))


def whole(vector: Column) -> Column:
    """floor(SCALE * c) of every entry as long; entries must be finite and small enough for one."""
    return F.transform(vector, lambda c: F.floor(c * SCALE))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors as rows of int64, zeros where one is shorter than ``width``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    if len(lengths) and (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out
