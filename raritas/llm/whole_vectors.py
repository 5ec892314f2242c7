"""Vectors of whole numbers: which rows are usable, scaling, and matrices from and to Arrow columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# The largest size of a component: 64 squared differences of such, and sums over 2**36 rows, still fit a long.
MOST = 1 << 27


def usable(vector: str, dimension: int | None = None) -> Column:
    """Whether a vector is there, has a component (or as many as ``dimension``), and all are numbers and finite."""

    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))

    size = F.size(vector) > 0 if dimension is None else F.size(vector) == dimension
    return F.coalesce(size & F.forall(vector, finite), F.lit(False))


def whole_numbers(vector: str, scale: int) -> Column:
    """Each component x as floor(scale * x), x as a double; one that is too large is an error."""

    def whole(x: Column) -> Column:
        value = F.floor(F.lit(float(scale)) * x.cast("double"))
        message = F.lit(f"a component exceeds {MOST} after scaling")
        return F.when(F.abs(F.lit(float(scale)) * x.cast("double")) <= MOST, value).otherwise(F.raise_error(message).cast("long"))

    return F.transform(vector, whole)


def lists_to_matrix(column: pa.ListArray) -> np.ndarray:
    """Lists of one length as a matrix of 64-bit integers."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def matrix_to_binary(matrix: np.ndarray) -> pa.Array:
    """Each line as little-endian 32-bit integers."""
    data = np.ascontiguousarray(matrix.astype("<i4"))
    offsets = np.arange(len(data) + 1, dtype=np.int32) * (data.shape[1] * 4)
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def binary_to_matrix(column: pa.Array, width: int) -> np.ndarray:
    """The lines back as 64-bit integers."""
    size = pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if size else np.int32)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    if raw is None or not len(column):
        return np.zeros((len(column), width), dtype=np.int64)
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return np.frombuffer(data.tobytes(), dtype="<i4").astype(np.int64).reshape(len(column), width)
