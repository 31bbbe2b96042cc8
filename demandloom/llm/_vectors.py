"""Reading of vector columns in Arrow batches, shared by the embedding operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def finite_rows(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: the row numbers of vectors without null and non-finite entries, and their entries as doubles.

    Null and empty vectors are left out.
    """
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    out = {}
    for dim in np.unique(size[size > 0]).tolist():
        at = np.flatnonzero(size == dim)
        flat = column.take(pa.array(at)).flatten().cast(pa.float64())
        x = flat.to_numpy(zero_copy_only=False).reshape(len(at), dim)
        good = np.isfinite(x).all(axis=1)
        if good.any():
            out[int(dim)] = (at[good], x[good])
    return out


def floored(x: np.ndarray, factor: float, limit: int) -> np.ndarray:
    """floor(factor * x) as integers, kept within -limit .. limit."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(factor * x), -limit, limit).astype(np.int64)
