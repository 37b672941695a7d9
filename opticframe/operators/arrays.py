"""Arrays of vectors and pixels between Arrow columns and numpy, without a Python object for each number."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(v: Column) -> Column:
    """Whether an array holds numbers, all of them finite and none null."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce((F.size(v) > 0) & ~F.exists(v, bad), F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of equally long arrays without nulls as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def parts(column: pa.Array) -> list[np.ndarray | None]:
    """The arrays of a column as doubles; None for a null, and for one that holds a null."""
    if not len(column):
        return []
    flat, at = column.flatten(), column.offsets.to_numpy()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    holes = np.r_[0, np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))]
    size = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, np.diff(at))  # a null's place may not be empty
    ends = np.cumsum(size)
    begins = ends - size
    return [values[a:b] if there and holes[a] == holes[b] else None for a, b, there in zip(begins.tolist(), ends.tolist(), column.is_valid().to_pylist())]


def images(batch: pa.RecordBatch, data: str = "data") -> list[np.ndarray | None]:
    """The frames (height, width, data) of a batch; None where pixels are null, hold a null or are not height x width."""
    shapes = zip(batch.column("height").to_pylist(), batch.column("width").to_pylist())
    return [p.reshape(h, w) if p is not None and h and w and h > 0 and w > 0 and p.size == h * w else None for p, (h, w) in zip(parts(batch.column(data)), shapes)]


def lists(arrays: list[np.ndarray | None]) -> pa.Array:
    """A column of arrays of doubles."""
    offsets = np.cumsum([0, *[0 if a is None else a.size for a in arrays]])
    flat = np.concatenate([np.zeros(0), *[a.ravel() for a in arrays if a is not None]])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.float64()), mask=pa.array([a is None for a in arrays], pa.bool_()))
