"""Vectors of an Arrow list column as integer matrices."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Scaled components stay inside +-LIMIT: sums of products of up to 8192 of them are exact in doubles.
LIMIT = 1 << 20


def quantised(col: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(usable, lengths, flat)``: which rows hold a vector without null or non-finite components, their
    lengths, and ``floor(scale * x)`` of their components one after the other, ``x`` as a double."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    lens = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = col.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    usable = pc.is_valid(col).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lens)), lens)
    usable = usable & (np.bincount(row, ~np.isfinite(flat), minlength=len(lens)) == 0)
    flat = np.clip(np.floor(flat[usable[row]] * scale), -LIMIT, LIMIT).astype(np.int32)
    return usable, lens[usable], flat


def padded(lens: np.ndarray, flat: np.ndarray, dims: int) -> np.ndarray:
    """Rows of equal length; missing components are 0."""
    out = np.zeros((len(lens), dims), np.int32)
    out[np.arange(dims) < lens[:, None]] = flat
    return out


def packed(*rows) -> list[bytes]:
    return [np.ascontiguousarray(r).tobytes() for r in rows]
