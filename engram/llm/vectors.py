"""Vectors as integer matrices, shared by the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from engram.llm.arrays import spread

#: Vectors with a component this far from zero take no part: sums of their products might not fit in 64 bits.
FIT = 1 << 27


def finite_rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column with exactly dim components, none null, NaN or infinite, and their matrix of doubles."""
    lens = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls turn into NaN
    first = np.cumsum(np.maximum(lens, 0)) - np.maximum(lens, 0)
    rows = np.flatnonzero(lens == dim)
    m = flat[spread(first[rows], np.full(len(rows), dim))].reshape(-1, dim)
    fine = np.isfinite(m).all(1)
    return rows[fine], m[fine]


def whole_numbers(column: pa.Array, dim: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that finite_rows() keeps and FIT admits, and floor(scale * x) of their components."""
    rows, m = finite_rows(column, dim)
    m = np.floor(m * scale)
    fine = (np.abs(m) < FIT).all(1)
    return rows[fine], m[fine].astype(np.int64)


def padded_rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """As finite_rows(), for all vectors of up to dim components: shorter ones end in zeros."""
    lens = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero((lens >= 0) & (lens <= dim))
    size = lens[rows]
    m = np.zeros((len(rows), dim))
    first = np.cumsum(np.maximum(lens, 0)) - np.maximum(lens, 0)
    m[np.repeat(np.arange(len(rows)), size), spread(np.zeros(len(rows), np.int64), size)] = flat[spread(first[rows], size)]
    fine = np.isfinite(m).all(1)
    return rows[fine], m[fine]


def stored(column: pa.Array, dim: int) -> np.ndarray:
    """The matrix of a list column in which all rows have dim components."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def as_lists(m: np.ndarray) -> pa.ListArray:
    """A matrix as a list column of 32-bit integers."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel(), pa.int32()))
