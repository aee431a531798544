"""Helpers for Python stages that stream Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

Work = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def lean(work: Work) -> Work:
    """A stage that hands the memory it no longer uses back when a task ends.

    Workers are kept from task to task; what their allocators hold on to would count against the
    executor while other stages run.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # other C libraries have none
            if trim is not None:
                trim(0)

    return run


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values in a sorted array."""
    if not len(keys):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return starts, np.diff(np.r_[starts, len(keys)])


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that never cut a group, from batches sorted by the integer column ``key``.

    The last group of each batch waits for the next one, so memory holds one batch and
    one group.
    """
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        keys = table.column(key).to_numpy()
        if held and keys[-1] == held[-1].column(key)[-1].as_py():
            held.append(table)
            continue
        first = int(np.searchsorted(keys, keys[-1], side="left"))
        yield pa.concat_tables([*held, table.slice(0, first)])
        held = [table.slice(first)]
    if held:
        yield pa.concat_tables(held)


def fixed_binary(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """A binary column whose values all have ``width`` bytes, as a (rows, width) array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())
    if not len(column):
        return np.empty((0, width), np.uint8)
    raw = np.frombuffer(column.buffers()[2], np.uint8)
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    at = np.frombuffer(column.buffers()[1], kind)[column.offset]
    return raw[at : at + len(column) * width].reshape(-1, width)


def binary_rows(rows: np.ndarray) -> pa.Array:
    """The rows of a C-ordered uint8 matrix as a binary column, without a copy per row."""
    n, width = rows.shape
    offsets = np.arange(n + 1, dtype=np.int32) * width
    data = np.ascontiguousarray(rows)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
