"""Helpers for operators that run on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of the long text column that one step works on; a longer single text is a step of its own.
STEP_BYTES = 4 << 20


def by_bytes(batch: pa.RecordBatch, column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose ``column`` holds about ``limit`` bytes each, to bound a worker's memory."""
    values = batch.column(column)
    if values.nbytes <= limit or len(batch) <= 1:
        if len(batch):
            yield batch
        return
    sizes = np.frombuffer(values.cast(pa.large_binary()).buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    step = (sizes[:-1] - sizes[0]) // limit
    cuts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(batch)]
    for lo, hi in zip(cuts, cuts[1:]):
        yield batch.slice(lo, hi - lo)
