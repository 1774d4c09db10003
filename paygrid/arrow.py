"""Arrow batches inside tasks: a bounded part of a batch at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_ROWS = 16_384


def list_sizes(lists: pa.Array) -> np.ndarray:
    """Elements of each list (null: none)."""
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def text_sizes(texts: pa.Array) -> np.ndarray:
    """Bytes of each text (null: none)."""
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def spans(sizes: np.ndarray, most: int, rows: int = CHUNK_ROWS) -> Iterator[tuple[int, int]]:
    """``(first, after the last)`` of neighbouring rows whose sizes add up to at
    most ``most`` (a larger row stands alone) and that are at most ``rows``."""
    off, i, n = np.concatenate([[0], np.cumsum(sizes)]), 0, len(sizes)
    while i < n:
        j = min(n, i + rows, max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1))
        yield i, j
        i = j
