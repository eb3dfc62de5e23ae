"""Arrow batches of texts: bounded slices in, record batches out."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a kernel works on at once (one longer text makes a slice of its own); of words, whose arrays are
#: many times as large, fewer.
SLICE_BYTES, WORDS_BYTES = 1 << 20, 1 << 18
#: Bytes of batches after which freed memory is returned, and at a task's end.
HOLD_BYTES = 1 << 25
_busy: list[tuple[str, Callable[[], None]]] = []


def give_back() -> None:
    """Return freed memory to the system, where it can be told to: workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def working(kind: str, forget: Callable[[], None]) -> None:
    """Say at a task's start what kind of kernel it runs and how to drop what that keeps from task to task. A worker that
    last ran another kind drops that one's: the stages of a pipeline share workers, and only one runs at a time."""
    if _busy and _busy[-1][0] != kind:
        _busy.pop()[1]()
    if not _busy:
        _busy.append((kind, forget))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of each cut together take about `limit` bytes."""
    done = 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        size = np.frombuffer(pc.binary_length(col).fill_null(0).cast(pa.int64()).buffers()[1], np.int64, n)
        ends = np.cumsum(size)
        at = 0
        while at < n:
            before = ends[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(at, upto - at)
            at = upto
        done += batch.nbytes
        if done > HOLD_BYTES:
            give_back()
            done = 0
    give_back()


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; a null one reads as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
