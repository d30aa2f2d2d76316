"""Vectors in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def usable(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each dimension the places of the usable vectors and these as rows of doubles.

    Null and empty vectors and those with a null or non-finite component are no usable ones.
    """
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == dim)
        x = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), dim)
        good = np.isfinite(x).all(axis=1)
        if good.any():
            yield at[good], x[good]
