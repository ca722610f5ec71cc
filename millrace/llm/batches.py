"""Arrow batches cut by the bytes of their texts, so that memory follows bytes and not rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text, and rows, that one step of a worker handles; a longer single text is a step of its own.
STEP_BYTES = 1 << 20
STEP_ROWS = 1024


def steps(batches: Iterable[pa.RecordBatch], text: int, limit: int = STEP_BYTES, rows: int = STEP_ROWS) -> Iterator[pa.RecordBatch]:
    """Slices of the batches, in order, with about `limit` bytes in column number `text` each."""
    for whole in batches:
        sizes = pc.fill_null(pc.binary_length(whole.column(text)), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(sizes, dtype=np.int64), 0
        while at < whole.num_rows:
            begun = int(ends[at - 1]) if at else 0
            to = int(np.searchsorted(ends, begun + limit, side="right"))
            to = min(max(to, at + 1), at + rows, whole.num_rows)
            yield whole.slice(at, to - at)
            at = to
