"""Vector columns as matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix in double precision) for each length of vector that occurs.

    Vectors that are null, empty, zero or hold a null or non-finite component are left out.
    """
    n = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    start = np.concatenate(([0], np.cumsum(n)))[:-1]
    for d in np.unique(n[n > 0]).tolist():
        rows = np.flatnonzero(n == d)
        m = flat[start[rows][:, None] + np.arange(d)]
        ok = np.isfinite(m).all(1) & (m != 0).any(1)
        yield rows[ok], m[ok]


def scaled(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows with their largest component in [0.5, 1), the power of two taken out of each), so that no square over- or underflows."""
    e = np.frexp(np.abs(m).max(1))[1] if m.size else np.zeros(len(m), np.int32)
    return np.ldexp(m, -e[:, None]), e


def directions(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of length 1, binary logarithms of the lengths)."""
    x, e = scaled(m)
    n = np.einsum("ij,ij->i", x, x)
    return x / np.sqrt(n)[:, None], e + np.log2(n) / 2


def keys(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes of rows, as two signed integers; -0.0 counts as 0.0."""
    got = [xxhash.xxh3_128_intdigest(x.tobytes()) for x in m + 0.0]
    return np.array([(v >> 64) - (1 << 63) for v in got], np.int64), np.array([(v & (1 << 64) - 1) - (1 << 63) for v in got], np.int64)


def blobs(m: np.ndarray, kind: str) -> list[bytes]:
    return [x.tobytes() for x in np.ascontiguousarray(m.astype(kind))]


def rows(column: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1)
