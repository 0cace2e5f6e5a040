"""Small dense linear algebra over Arrow batches: many little problems of one size at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

DEPENDENT = 1e-11  # a column is dependent when less than this share of it is new
VALUES = 100_000  # values a piece of a batch holds, about
CELLS = 500_000  # values of the matrices that are made of a piece at a time, about


def pieces(batches, column: str, limit: int = VALUES):
    """Record batches cut so that the rows of a piece, padded to its longest list, hold at most `limit` values (one row may
    hold more). Memory then follows neither the session's batch size nor the length of the lists in other rows."""
    for batch in batches:
        size = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(batch.column(column)), 0))
        start, longest = 0, 0
        for i, n in enumerate(size.tolist()):
            longest = max(longest, n)
            if i > start and longest * (i + 1 - start) > limit:
                yield batch.slice(start, i - start)
                start, longest = i, n
        yield batch.slice(start)


def padded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A list<double> column as a zero-padded matrix and the list lengths."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.asarray(column.offsets)
    lengths = np.diff(offsets)
    flat = np.asarray(column.flatten(), dtype=float)
    out = np.zeros((len(lengths), int(lengths.max(initial=0))))
    out[np.arange(out.shape[1])[None, :] < lengths[:, None]] = flat
    return out, lengths


def groups(*keys: np.ndarray, limit: int | None = None, cost: np.ndarray | None = None):
    """Row indices with equal keys; with `limit`, in pieces whose summed cost stays below it."""
    table = np.stack(keys, axis=1)
    _, inverse = np.unique(table, axis=0, return_inverse=True)
    inverse = inverse.ravel()
    order = np.argsort(inverse, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(inverse[order])) + 1):
        if limit is None:
            yield rows
            continue
        step = max(1, int(limit // max(1, cost[rows].max())))
        for i in range(0, len(rows), step):
            yield rows[i : i + step]


def factor(gram: np.ndarray) -> np.ndarray:
    """Cholesky factors of a stack of Gram matrices. A column that the ones before it already explain
    gets a zero column in the factor, which leaves it out of every fit. The last column is the target
    and is always kept: its diagonal is the root of the residual sum of squares."""
    q = gram.shape[-1]
    out = np.zeros_like(gram)
    for j in range(q):
        head = out[:, j, :j]
        left = gram[:, j, j] - np.einsum("bi,bi->b", head, head)
        keep = left > DEPENDENT * gram[:, j, j]
        if j == q - 1:
            keep, left = np.ones_like(keep), np.maximum(left, 0.0)
        root = np.sqrt(np.where(keep, left, 1.0))
        column = gram[:, j:, j] - np.einsum("bij,bj->bi", out[:, j:, :j], head)
        out[:, j:, j] = np.where(keep[:, None], column / np.where(root > 0, root, 1.0)[:, None], 0.0)
    return out


def coefficients(lower: np.ndarray) -> np.ndarray:
    """Regression coefficients from `factor`, 0 for left-out columns."""
    k = lower.shape[-1] - 1
    beta = np.zeros((len(lower), k))
    for j in range(k - 1, -1, -1):
        pivot = lower[:, j, j]
        known = lower[:, k, j] - np.einsum("bi,bi->b", lower[:, j + 1 : k, j], beta[:, j + 1 :])
        beta[:, j] = np.where(pivot > 0, known / np.where(pivot > 0, pivot, 1.0), 0.0)
    return beta


def residual_squares(lower: np.ndarray) -> np.ndarray:
    """Residual sums of squares of the fits on the first 0, 1, 2, ... columns."""
    target = lower[:, -1, :] ** 2
    return target[:, ::-1].cumsum(axis=1)[:, ::-1]


def lists(rows: list[np.ndarray | None]) -> pa.Array:
    return pa.array([None if r is None else r for r in rows], type=pa.list_(pa.float64()))
