"""Arrow columns of equally long arrays as double matrices, inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of an array column; arrays of different lengths are an error."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.unique(pc.list_value_length(column)).to_pylist()
    if len(lengths) > 1:
        raise ValueError(f"vectors differ in length: {sorted(lengths, key=str)}")
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1)


def list_array(rows: np.ndarray) -> pa.Array:
    """The other way: one array per matrix row."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))


def constant(value: object, rows: int, kind: pa.DataType) -> pa.Array:
    return pa.repeat(pa.scalar(value, kind), rows)
