"""Runs of equal keys in Arrow batches."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def run_ends(batch: pa.RecordBatch, keys: list[str]) -> list[int]:
    """Where each run of rows with equal keys ends; nulls are equal. No rows, no runs."""
    n = batch.num_rows
    if not n:
        return []
    same = np.ones(n - 1, bool)
    for k in keys:
        a, b = batch.column(k).slice(0, n - 1), batch.column(k).slice(1)
        same &= pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False) | pc.and_(pc.is_null(a), pc.is_null(b)).to_numpy(zero_copy_only=False)
    return [*(1 + np.flatnonzero(~same)).tolist(), n]
