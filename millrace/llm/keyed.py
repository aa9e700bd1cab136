"""Groups of equal keys from key-sorted partitions, in bounded memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def key_groups(batches: Iterator[pa.RecordBatch], key: str, columns: list[str], large: int) -> Iterator[tuple[bool, list[np.ndarray]]]:
    """Yields (False, columns) with whole groups, and (True, columns) with rows of a group of over ``large`` rows.

    Rows must come sorted by ``key``. No more than a batch and ``large`` rows are held.
    A group that proves too large is passed on as it comes.
    """
    at = columns.index(key)
    held, over = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [np.asarray(batch.column(c)) if not pa.types.is_binary(batch.column(c).type) else np.array(batch.column(c).to_pylist(), dtype=object) for c in columns]
        if held is not None:
            rows, held = [np.concatenate(x) for x in zip(held, rows, strict=True)], None
        if over is not None:
            n = int(np.searchsorted(rows[at], over, "right"))
            if n:
                yield True, [x[:n] for x in rows]
            rows = [x[n:] for x in rows]
            if not len(rows[at]):
                continue
            over = None
        last = int(np.searchsorted(rows[at], rows[at][-1]))
        if last:
            yield False, [x[:last] for x in rows]
        rows = [x[last:] for x in rows]
        if len(rows[at]) > large:
            over = rows[at][0]
            yield True, rows
        else:
            held = rows
    if held is not None:
        yield False, held
