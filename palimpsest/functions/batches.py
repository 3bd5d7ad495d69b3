"""Row functions over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa

SLICE = 256


def by_slices(one: Callable, kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """one(row's values) for every row of a batch; the values of a few rows at a time are Python's, so a
    batch of large bodies is held once, not once more as objects."""
    cuts = ([c.slice(k, SLICE).to_pylist() for c in columns] for k in range(0, len(columns[0]), SLICE))
    parts = [pa.array([one(*row) for row in zip(*cut)], kind) for cut in cuts]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)
