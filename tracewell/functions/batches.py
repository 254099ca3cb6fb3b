"""Arrow batches by bytes: Spark fills a batch by rows, however long their texts are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

SLICE_BYTES = 1 << 20


def slices(batch: pa.RecordBatch, *texts: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows (views, no copies) whose columns ``texts`` have at most so many bytes together, or of one row."""
    size = sum(np.asarray(pc.fill_null(pc.binary_length(batch.column(c)), 0), np.int64) for c in texts)
    ends, at = np.cumsum(size), 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def fields(rows: DataFrame) -> list[str]:
    """The columns of ``rows`` as a schema text has them."""
    return [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema]
