"""Bounds on what a Python worker holds: slices of Arrow batches, and freed memory given back."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:  # another C library, which needs no trimming
    _libc = None

#: Bytes of texts, pre-tokens or ids that a worker turns into Python objects and index arrays at a time.
SLICE = 2 << 20


def trim() -> None:
    """Give freed memory back to the system; allocators keep the room of the largest batch otherwise."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def bounds(weights: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(first, last) rows of consecutive slices of about `most`, one row at least."""
    ends, at = np.cumsum(weights, dtype=np.int64), 0
    while at < len(ends):
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield at, to
        at = to


def whole(values: pa.Array | pa.ChunkedArray) -> pa.Array:
    return values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values


def weights(values: pa.Array) -> np.ndarray:
    """Bytes of each row: of texts, or of lists of texts or numbers with eight for each item."""
    if not pa.types.is_list(values.type):
        return np.asarray(pc.fill_null(pc.binary_length(values), 0)).astype(np.int64)
    counts = np.asarray(pc.fill_null(pc.list_value_length(values), 0)).astype(np.int64)
    if pa.types.is_integer(values.type.value_type):
        return 8 * counts
    sizes = np.asarray(pc.fill_null(pc.binary_length(values.flatten()), 0)).astype(np.int64)
    ends = np.cumsum(counts)
    before = np.concatenate(([0], np.cumsum(sizes)))
    return 8 * counts + before[ends] - before[ends - counts]


def by_slices(run: Callable[..., pa.Array], kind: pa.DataType, *columns: pa.Array | pa.ChunkedArray, most: int | None = None) -> pa.Array:
    """`run` over slices of rows, so that its working memory follows SLICE and not the batch."""
    columns = tuple(map(whole, columns))
    out = [run(*(c.slice(a, b - a) for c in columns)) for a, b in bounds(sum(map(weights, columns)), most or SLICE)]
    joined = pa.concat_arrays(out) if out else pa.array([], kind)
    del out
    trim()
    return joined
