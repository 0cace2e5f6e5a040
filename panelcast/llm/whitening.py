"""Embedding whitening by a bidiagonal qd solver.

The covariance is never formed. Tasks centre blocks of the distinct vectors and reduce them to triangular factors by QR; the
factors are stacked and reduced again in rounds until one is left, as wide as a vector. Householder reflections make it
bidiagonal. The dqds algorithm (differential quotient-difference with shifts) finds its singular values, the smallest first, by
sums and products of positive numbers only, so that small ones are as exact as large ones. For each leading value, a twisted
factorisation of the shifted bidiagonal product, top down and bottom up, met where its pivot is smallest, gives the direction.

Vectors are compared and added up as integers, so the mean and `deviation` are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.session import cut_lineage

SCALE = 256
COMPONENTS = 4
BLOCK = 8 << 20  # bytes of doubles that are reduced at a time
FAN = 16  # triangular factors that one task reduces in a round
EPS = float(np.finfo(float).eps)
TOLERANCE = (10 * EPS) ** 2  # share of a squared singular value that a coupling may have and count as none
CLOSE = 1e-3  # relative gap below which directions are made orthogonal to one another
LONG = 1 << 63


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of integers, shorter lists filled up with 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.asarray(pa.compute.list_value_length(column), dtype=np.int64)
    flat = np.asarray(column.flatten(), dtype=np.int64)
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), dtype=np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


def blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    step = max(1, BLOCK // (8 * max(width, 1)))
    for batch in batches:
        for at in range(0, len(batch), step):
            yield batch.slice(at, step)


def _sums(width: int):
    """Exact column sums of a task's vectors: (pos, high, low), sum = high * 2^32 + low."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, width), dtype=np.int64)
        for part in blocks(batches, width):
            x = matrix(part.column("x"), width)
            total += np.stack([(x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)])
            total += np.stack([total[1] >> 32, (total[1] & 0xFFFFFFFF) - total[1]])  # the low part stays below 2^32
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), pa.array(total[0]), pa.array(total[1])], ["pos", "high", "low"])

    return run


def _triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r") if len(rows) else rows


def _most(x: np.ndarray) -> int:
    """The largest size of an entry."""
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


def centred(x: np.ndarray, sums: list[int], n: int) -> np.ndarray:
    """x - sums / n. Whole parts are taken off as integers, so that a large mean costs no digits."""
    whole = np.array([s // n for s in sums], dtype=np.int64)
    part = np.array([(s % n) / n for s in sums])
    if _most(x) >= LONG >> 2:  # the difference may be no long
        return x.astype(float) - whole - part
    return (x - whole).astype(float) - part


def _factor(sums: list[int], n: int):
    """The triangular factor of all vectors of a task, one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(sums)
        held = np.zeros((0, width))
        for part in blocks(batches, width):
            held = _triangle(np.concatenate([held, centred(matrix(part.column("x"), width), sums, n)]))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([held.ravel().tolist()], pa.list_(pa.float64()))], ["at", "r"])

    return run


def _stacked(width: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        held = np.zeros((0, width))
        for r in table["r"]:
            held = _triangle(np.concatenate([held, np.asarray(r.values, dtype=float).reshape(-1, width)]))
        return pa.table({"at": pa.array([table["at"][0].as_py() // FAN], pa.int64()), "r": pa.array([held.ravel().tolist()], pa.list_(pa.float64()))})

    return run


def triangular(fit: DataFrame, sums: list[int], n: int) -> np.ndarray:
    """The triangular factor (width x width) of the centred vectors `x` of `fit`: R'R = n times their covariance."""
    width, schema = len(sums), "at long, r array<double>"
    parts = cut_lineage(fit.select("x").mapInArrow(_factor(sums, n), schema))
    count = parts.agg(F.max("at")).first()[0]
    while count is not None and count > 0:
        parts = cut_lineage(parts.groupBy(F.floor(F.col("at") / FAN).alias("key")).applyInArrow(_stacked(width), schema))
        count = parts.agg(F.max("at")).first()[0]
    held = np.zeros((0, width))
    for r in parts.collect():  # one row, as large as a square of the width
        held = _triangle(np.concatenate([held, np.array(r.r, dtype=float).reshape(-1, width)]))
    return np.concatenate([held, np.zeros((width - len(held), width))])


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Householder reflections from left and right: diagonal, superdiagonal, and the right reflections (unit vectors that
    act on the columns after the first, second, ...)."""
    a, width = r.astype(float).copy(), r.shape[1]
    right = []

    def reflect(v: np.ndarray) -> np.ndarray | None:
        norm = np.linalg.norm(v)
        if norm == 0 or norm == abs(v[0]):
            return None  # nothing below the first
        u = v / norm
        u[0] += 1.0 if u[0] >= 0 else -1.0
        return u / np.linalg.norm(u)

    for k in range(width):
        u = reflect(a[k:, k])
        if u is not None:
            a[k:, k:] -= 2 * np.outer(u, u @ a[k:, k:])
        u = reflect(a[k, k + 1 :]) if k + 2 < width else None
        if u is not None:
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ u, u)
        right.append(u)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def _sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]]:
    """One differential qd step with a shift: new q and e, and the d it ran through."""
    d, qs, es, ds = q[0] - shift, [], [], [q[0] - shift]
    for k in range(len(e)):
        new = d + e[k]
        ratio = q[k + 1] / new if new != 0 else 1.0
        qs.append(new)
        es.append(e[k] * ratio)
        d = d * ratio - shift
        ds.append(d)
    return [*qs, d], es, ds


def singular_squares(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squared singular values of a bidiagonal matrix, falling, by dqds. A step without a shift gives the diagonal of the inverse, whose
    trace bounds the smallest value from below (Newton's step); that is the next shift. Blocks whose coupling has gone are
    solved by themselves; the last value of a block is done when its coupling has gone."""
    todo = [((diagonal.astype(float) ** 2).tolist(), (above.astype(float) ** 2).tolist(), 0.0)]
    found: list[float] = []
    while todo:
        q, e, base = todo.pop()
        while q:
            if len(q) == 1:
                found.append(base + max(q[0], 0.0))
                break
            if e[-1] <= TOLERANCE * (base + q[-1]) or e[-1] == 0:
                found.append(base + max(q[-1], 0.0))
                q, e = q[:-1], e[:-1]
                continue
            gone = next((k for k in range(len(e) - 2, -1, -1) if e[k] <= TOLERANCE * EPS * (q[k] + base) or e[k] == 0), None)
            if gone is not None:
                todo.append((q[: gone + 1], e[: gone], base))
                q, e = q[gone + 1 :], e[gone + 1 :]
                continue
            if q[-1] > 4 * q[0] > 0:  # the small end comes last
                q, e = q[::-1], e[::-1]
            q, e, d = _sweep(q, e, 0.0)
            if min(d) > 0 and e[-1] > TOLERANCE * (base + q[-1]):
                shift = (1 - 4 * EPS * len(d)) / sum(1 / x for x in d)
                trial = _sweep(q, e, shift)
                if shift > EPS * EPS * (base + q[-1]) and min(trial[2]) >= 0:
                    q, e, base = trial[0], trial[1], base + shift
    return np.array(sorted(found, reverse=True))


def twisted(diagonal: np.ndarray, above: np.ndarray, value: float) -> np.ndarray:
    """The unit right singular vector for a squared singular value: B'B - value is factored from the top and from the bottom,
    and the two factorisations meet in the row where the pivot is smallest."""
    size = len(diagonal)
    tiny = EPS * EPS * max(float(np.abs(diagonal).max()), 1e-150)
    a = np.where(np.abs(diagonal) < tiny, tiny, diagonal)
    d, l, ab = (a * a).tolist(), (above / a[:-1]).tolist(), (above * a[:-1]).tolist()  # noqa: E741
    least = EPS * max(max(d), value) * EPS
    top, s = [0.0] * size, -value  # L+ and the running value of the stationary step
    stationary = [s]
    for k in range(size - 1):
        pivot = d[k] + s
        pivot = pivot if abs(pivot) > least else least
        top[k] = ab[k] / pivot
        s = top[k] * l[k] * s - value
        stationary.append(s)
    low, p = [0.0] * size, d[-1] - value
    progressive = [p]
    for k in range(size - 2, -1, -1):
        pivot = above[k] * above[k] + p
        pivot = pivot if abs(pivot) > least else least
        t = d[k] / pivot
        low[k] = l[k] * t
        p = p * t - value
        progressive.append(p)
    progressive = progressive[::-1]
    meet = int(np.argmin([abs(x + y + value) for x, y in zip(stationary, progressive, strict=True)]))
    z = np.zeros(size)
    z[meet] = 1.0
    for k in range(meet - 1, -1, -1):
        z[k] = -top[k] * z[k + 1]
    for k in range(meet, size - 1):
        z[k + 1] = -low[k] * z[k]
    return z / np.linalg.norm(z)


def directions(r: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Squared singular values, falling, of the leading components of a triangular factor and their right singular vectors as
    columns. Components without variance are left out."""
    width = r.shape[1]
    if not width or not np.abs(r).any():
        return np.zeros(0), np.zeros((width, 0))
    size = float(np.abs(r).max())
    diagonal, above, right = bidiagonal(r / size)
    values = singular_squares(diagonal, above)[:components]
    values = values[values > (width * EPS) ** 2 * values[0]]
    cuts = np.flatnonzero(above == 0) + 1  # blocks without coupling have vectors of their own
    parts = list(zip([0, *cuts.tolist()], [*cuts.tolist(), width], strict=True))
    owned = [(singular_squares(diagonal[a:b], above[a : b - 1]), a, b) for a, b in parts] if len(parts) > 1 else [(values, 0, width)]
    ranked = sorted(((v, a, b) for vs, a, b in owned for v in vs), key=lambda t: -t[0])[: len(values)]
    out: list[np.ndarray] = []
    for k, (value, a, b) in enumerate(ranked):
        z = np.zeros(width)
        z[a:b] = twisted(diagonal[a:b], above[a : b - 1], value)
        near = [out[j] for j in range(k) if abs(ranked[j][0] - value) <= CLOSE * value]
        for turn in range(2):
            for other in near:
                z = z - other * (other @ z)
            if turn == 0 and near and np.linalg.norm(z) < 0.1:  # the same vector again: another one of its space
                z = _another(diagonal[a:b], above[a : b - 1], value, [o[a:b] for o in near], a, width)
        out.append(z / np.linalg.norm(z))
    v = np.stack(out, axis=1)
    for k in range(width - 1, -1, -1):
        u = right[k]
        if u is not None:
            v[k + 1 :] -= 2 * np.outer(u, u @ v[k + 1 :])
    return np.array([t[0] for t in ranked]) * size * size, v


def _another(diagonal: np.ndarray, above: np.ndarray, value: float, near: list[np.ndarray], at: int, width: int) -> np.ndarray:
    """Inverse iteration in what is orthogonal to the vectors that are known."""
    size = len(diagonal)
    product = np.diag(diagonal**2) + np.diag(diagonal[:-1] * above, 1) + np.diag(diagonal[:-1] * above, -1)
    product[np.arange(1, size), np.arange(1, size)] += above**2
    shifted = product - (value * (1 + 4 * EPS) + EPS * EPS) * np.eye(size)
    z = np.cos(1.0 + np.arange(size))
    for _ in range(4):
        for other in near:
            z = z - other * (other @ z)
        z = np.linalg.solve(shifted, z / np.linalg.norm(z))
        z = z / np.linalg.norm(z)
    out = np.zeros(width)
    out[at : at + size] = z
    return out


def _covered(sums: list[int], n: int, weights: np.ndarray):
    """Sums of products of a task's whitened vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, k = weights.shape
        total = np.zeros((k + 1, k + 1))
        for part in blocks(batches, width):
            w = centred(matrix(part.column("x"), width), sums, n) @ weights
            w = np.concatenate([w, np.ones((len(w), 1))], axis=1)
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], ["pos", "x"])

    return run


def _projected(sums: list[int], n: int, weights: np.ndarray, explained: list[float], error: float):
    width, k = weights.shape
    names = ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def deviations(x: np.ndarray) -> list[int | None]:
        """Sums of (n x - S)^2: in longs where they surely fit, else in integers of any size; none beyond a long."""
        most = max(_most(x) * n + max(map(abs, sums), default=0), 1)
        if most * most * max(width, 1) < LONG:
            d = n * x - np.array(sums, dtype=np.int64)
            return (d * d).sum(axis=1).tolist()
        about = ((float(n) * x - np.array(sums, dtype=float)) ** 2).sum(axis=1)
        exact = [sum((n * c - s) ** 2 for c, s in zip(x[i].tolist(), sums, strict=True)) if about[i] < 2 * LONG else LONG for i in range(len(x))]
        return [d if d < LONG else None for d in exact]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, width):
            x = matrix(part.column("x"), width)
            w = centred(x, sums, n) @ weights
            of = pa.array(np.repeat(np.arange(len(part)), k))
            rows = len(part) * k
            columns = [
                part.column("id").take(of), pa.array(np.tile(np.arange(1, k + 1), len(part)), pa.int32()), pa.array(np.full(rows, n), pa.int64()),
                pa.array(deviations(x), pa.int64()).take(of), pa.array(w.ravel()), pa.array(np.tile(explained, len(part)), pa.float64()), pa.array(np.full(rows, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def whitened(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE
) -> DataFrame:
    """For every row whose vector has only finite entries, and each of the leading components: id, component (from 1), n (distinct vectors),
    deviation (sum over dimensions of (n x - S)^2), whitened, explained (share of the variance) and identity_error.

    x is floor(scale * entry); mean, variance and directions are those of the distinct x. Rows with a null vector, or with null or
    non-finite entries, have no result; repeated rows have one each; an id may be null. A shorter vector is filled up with
    zeros. A component without variance is not there, so equal vectors alone, or an empty table, give an empty result. A deviation that no long can
    hold is null. Directions of equal variance are any orthogonal ones. Other columns are not read."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    good = vectors.where(v.isNotNull()).where(~bad)
    rows = good.select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda c: F.floor(c.cast("double") * F.lit(float(scale)))).alias("x"))
    schema = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    nothing = vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    width = rows.agg(F.max(F.size("x"))).first()[0]
    if not width:
        return nothing
    whole = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x")))
    fit = cut_lineage(rows.select(whole.alias("x")).distinct())
    n = fit.count()
    parts = fit.mapInArrow(_sums(width), "pos int, high long, low long").groupBy("pos").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    sums = [0] * width
    for r in parts.collect():  # a row a dimension
        sums[r.pos] = (r.high << 32) + r.low
    factor = triangular(fit, sums, n)
    squares, v = directions(factor, components)
    if not len(squares):
        return nothing
    variance = squares / n
    weights = v / np.sqrt(variance)
    explained = (squares / float((factor**2).sum())).tolist()
    k = len(squares)
    total = np.zeros((k + 1) * (k + 1))
    for r in fit.mapInArrow(_covered(sums, n, weights), "pos int, x double").groupBy("pos").agg(F.sum("x").alias("x")).collect():
        total[r.pos] = r.x
    total = total.reshape(k + 1, k + 1) / n
    error = float(np.abs(total[:k, :k] - np.outer(total[:k, k], total[:k, k]) - np.eye(k)).max())
    return rows.mapInArrow(_projected(sums, n, weights, explained, error), schema).withColumnRenamed("id", id_col)
