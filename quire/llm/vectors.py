"""Arrow list columns as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows, doubles): the indices of the lists that are non-null and hold finite components only, and their values,
    shorter ones filled up with zeros. Empty lists are rows without components."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    start, end = col.offsets.to_numpy()[:-1], col.offsets.to_numpy()[1:]
    flat = col.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null components come as NaN
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
    ok = (bad[end] == bad[start]) & ~col.is_null().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(ok)
    size = (end - start)[rows]
    dim = int(size.max(initial=0))
    out = np.zeros((len(rows), dim))
    if n and dim:
        if (size == dim).all() and len(rows) == n and len(flat) == n * dim and start[0] == 0:
            out = flat.reshape(n, dim)
        else:
            at = np.arange(dim)
            mask = at < size[:, None]
            out[mask] = flat[(start[rows][:, None] + at)[mask]]
    return rows, out


def unpack(blobs, dtype) -> np.ndarray:
    """Binary rows as a matrix, shorter ones filled up with zeros."""
    parts = [np.frombuffer(b, dtype=dtype) for b in blobs]
    dim = max(map(len, parts), default=0)
    out = np.zeros((len(parts), dim), dtype=dtype)
    for i, p in enumerate(parts):
        out[i, : len(p)] = p
    return out
