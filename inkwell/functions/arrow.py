"""Arrow batches in pieces, so that what Python makes of a batch stays small whatever the batch's size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a piece holds, unless one row alone has more.
PIECE = 1 << 20


def pieces(batches: Iterable[pa.RecordBatch], most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The batches' rows in order, cut where a run's strings reach `most` bytes; a longer row is a piece by itself."""
    for batch in batches:
        ends = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
                ends += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(ends)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop
