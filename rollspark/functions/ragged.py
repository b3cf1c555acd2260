"""Arrow list columns as flat numpy arrays with row boundaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 21


class Ragged:
    """The non-empty rows of a list column.

    ``values`` are the elements of these rows, ``rows`` their row numbers,
    ``starts`` and ``sizes`` their extents in ``values``. Null rows and empty
    rows hold no elements and are left out.
    """

    def __init__(self, column: pa.Array):
        self.column = column
        self.values = column.flatten().to_numpy(zero_copy_only=False)
        sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        self.length = len(column)
        self.rows = np.flatnonzero(sizes)
        self.sizes = sizes[self.rows]
        self.starts = np.cumsum(self.sizes) - self.sizes

    def matrices(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row numbers, matrix) of rows of equal size, in pieces of at most ``PIECE`` elements or one row.

        Small pieces keep the copies made while working on them small.
        """
        for size in np.unique(self.sizes):
            chosen = np.flatnonzero(self.sizes == size)
            step = max(1, PIECE // int(size))
            for first in range(0, len(chosen), step):
                part = chosen[first : first + step]
                if len(chosen) == len(self.sizes):
                    start = self.starts[part[0]]
                    matrix = self.values[start : start + len(part) * size].reshape(-1, size)
                else:
                    matrix = self.values[self.starts[part][:, None] + np.arange(size)]
                yield self.rows[part], matrix.astype(np.float64)


def list_array(values: np.ndarray, like: Ragged) -> pa.Array:
    """List column with new elements in the row layout of ``like``."""
    sizes = np.zeros(like.length, dtype=np.int32)
    sizes[like.rows] = like.sizes
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    mask = like.column.is_null()
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=mask if like.column.null_count else None)
