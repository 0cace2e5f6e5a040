"""Non-seasonal ARIMA by exact likelihood.

The order of differencing comes from repeated KPSS tests. Every (p, q) is fitted by maximum likelihood with the Kalman filter
(`functions.kalman`), coefficients kept stationary and invertible, and the lowest AICc is kept; forecasts start from the filtered state.

A task fits all orders of many short series together, and a series leaves the search as soon as its likelihood no longer grows. A long series
stays cut: each step of the search is one pass over the chunks, which summarize their rows for all points that are asked for, and summaries
of neighbouring chunks are composed in rounds. All orders of all such series take their steps in the same passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.functions import batch as B
from panelcast.functions import kalman as K
from panelcast.operators.arima import MAX_D, MAX_P, MAX_Q, to_stationary
from panelcast.operators.layout import DEFAULT, Layout, chunk_arrays
from panelcast.session import cut_lineage

GROUP = 64  # long series whose searches the driver holds at a time
FAN = 256  # summaries that one task puts one after the other
ASKED = 64  # points of a chunk that are filtered at a time
COARSE = (-2.4, -1.4, -0.6, 0.0, 0.6, 1.4, 2.4)
PER_TASK = 50_000  # rows whose series a task fits, about
MARGIN = 1e-6  # by which a later order's AICc must be lower
FITS = "series_id string, d int, p int, q int, aicc double, ar array<double>, ma array<double>, mean double, variance double, predicted array<double>"


def orders(max_p: int, max_q: int) -> list[tuple[int, int]]:
    return [(p, q) for p in range(max_p + 1) for q in range(max_q + 1)]


def trials(p: int, q: int) -> np.ndarray:
    """Points of a coarse grid over the first parameter of each part, the others 0."""
    points = [
        [a] * min(p, 1) + [0.0] * (p - 1) + [m] * min(q, 1) + [0.0] * (q - 1)
        for a in (COARSE if p else (0.0,)) for m in (COARSE if q else (0.0,))
    ]
    return np.array(points, dtype=float).reshape(len(points), p + q)


def begun(p: int, q: int) -> int:
    """The number of valleys from which a search sets out: mixed models may have several."""
    return 2 if p and q else 1


def valleys(height: np.ndarray, p: int, q: int) -> np.ndarray:
    """Points of the grid of `trials`, by series, that are no higher than their neighbours: the numbers of the lowest `begun`; the lowest of all
    again where there are fewer."""
    sides = (len(COARSE) if p else 1, len(COARSE) if q else 1)
    field = np.pad(height.reshape(-1, *sides), ((0, 0), (1, 1), (1, 1)), constant_values=np.inf)
    low = np.ones((len(height), *sides), dtype=bool)
    for a, b in ((0, 1), (2, 1), (1, 0), (1, 2)):
        low &= field[:, 1:-1, 1:-1] <= field[:, a : a + sides[0], b : b + sides[1]]
    order = np.argsort(np.where(low.reshape(height.shape), height, np.inf), axis=1, kind="stable")[:, : begun(p, q)]
    found = np.take_along_axis(low.reshape(height.shape), order, axis=1)
    return np.where(found, order, order[:, :1])


def score(minus_log: np.ndarray, n: np.ndarray, p: int, q: int, with_mean: np.ndarray) -> np.ndarray:
    """AICc of a fit with p + q coefficients, a variance and maybe a mean; infinite with too few rows."""
    k = p + q + 1 + with_mean
    left = n - k - 1
    return np.where(left > 0, 2 * minus_log + 2 * k + 2 * k * (k + 1) / np.where(left > 0, left, 1), np.inf)


def best_of(scores: np.ndarray) -> np.ndarray:
    """The column of the lowest score in each row; an earlier one unless a later is lower by MARGIN. The first if none is finite."""
    best, at = scores[:, 0].copy(), np.zeros(len(scores), dtype=np.int64)
    for k in range(1, scores.shape[1]):
        lower = scores[:, k] < best - MARGIN
        best[lower], at[lower] = scores[lower, k], k
    return at


def ahead(states: K.States, state: np.ndarray, mean: np.ndarray, horizon: np.ndarray) -> np.ndarray:
    """Forecasts of the differenced series from end states whose columns are those of the values and of the constant."""
    x = (state[:, :, 0] - mean[:, None] * state[:, :, 1]).T[:, None]
    out = np.zeros((len(mean), int(horizon.max(initial=0))))
    for h in range(out.shape[1]):
        out[:, h] = mean + x[0, 0]
        x = states.moved(x)
    return out


def summed(change: np.ndarray, d: np.ndarray, last: np.ndarray, rise: np.ndarray) -> np.ndarray:
    """Forecasts of the values from those of their d-th differences."""
    once = np.cumsum(change, axis=1)
    steps = np.arange(1, change.shape[1] + 1)
    out = np.where((d == 0)[:, None], change, last[:, None] + once)
    return np.where((d == 2)[:, None], last[:, None] + rise[:, None] * steps + np.cumsum(once, axis=1), out)


def _rows(ids, d, chosen: list[tuple], horizon, last, rise) -> pa.RecordBatch:
    """Result rows from (p, q, aicc, ar, ma, mean, variance, forecasts of differences) of each series."""
    names = ["series_id", "d", "p", "q", "aicc", "ar", "ma", "mean", "variance", "predicted"]
    change = np.zeros((len(chosen), int(horizon.max(initial=0))))
    for i, c in enumerate(chosen):
        change[i, : len(c[7])] = c[7]
    out = summed(change, d, last, rise)
    numbers = [[c[k] for c in chosen] for k in range(7)]
    columns = [
        ids, pa.array(d, pa.int32()), pa.array(numbers[0], pa.int32()), pa.array(numbers[1], pa.int32()),
        pa.array([a if np.isfinite(a) else None for a in numbers[2]], pa.float64()), B.lists(numbers[3]), B.lists(numbers[4]),
        pa.array(numbers[5], pa.float64()), pa.array(numbers[6], pa.float64()), B.lists([o[:h] for o, h in zip(out, horizon, strict=True)]),
    ]
    return pa.RecordBatch.from_arrays(columns, names)


def searched(target, rows: int, p: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """The best parameters of each series and their value, from the valleys of the grid."""
    grid, every = trials(p, q), np.arange(rows)
    height = target(np.repeat(every, len(grid)), np.tile(grid, (rows, 1))).reshape(rows, len(grid))
    start = valleys(height, p, q)
    other = start != start[:, :1]  # a valley that is there again is searched once
    other[:, 0] = True
    turn, of = np.nonzero(other.T)
    x, value = K.minimized(lambda k, points: target(of[k], points), grid[start[of, turn]])
    z, least = np.zeros((rows, p + q)), np.full(rows, np.inf)
    for j in range(start.shape[1]):
        at = np.flatnonzero(turn == j)
        at = at[value[at] < least[of[at]]]
        z[of[at]], least[of[at]] = x[at], value[at]
    return z, least


def _whole(max_p: int, max_q: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.pieces(batches, "values", 60_000):
            values, n = B.padded(batch.column("values"))
            d, horizon, last, rise = (np.asarray(batch.column(c)) for c in ("d", "horizon", "last", "rise"))
            with_mean, rows, none = d < 2, len(n), np.zeros(len(n), dtype=np.int64)
            found, scores = [], []
            for p, q in orders(max_p, max_q):

                def target(of, z, p=p):
                    _, products, logs = K.filtered(K.States(*K.model(z, p)), values[of], n[of], none[of], False)
                    return K.likelihood(products, logs, n[of], with_mean[of])[0]

                z, least = searched(target, rows, p, q)
                found.append(z)
                scores.append(score(least, n, p, q, with_mean))
            at, scores = best_of(np.stack(scores, axis=1)), np.stack(scores, axis=1)
            chosen: list[tuple] = [()] * rows
            for k, (p, q) in enumerate(orders(max_p, max_q)):
                of = np.flatnonzero(at == k)
                if not len(of):
                    continue
                ar, ma = K.model(found[k][of], p)
                states = K.States(ar, ma)
                state, products, logs = K.filtered(states, values[of], n[of], none[of], False)
                _, mean, variance = K.likelihood(products, logs, n[of], with_mean[of])
                steps = ahead(states, state, mean, horizon[of])
                for j, i in enumerate(of):
                    chosen[i] = (p, q, scores[i, k], ar[j], ma[j], mean[j], variance[j], steps[j, : horizon[i]])
            yield _rows(batch.column("series_id"), d, chosen, horizon, last, rise)

    return run


def _summaries(z: np.ndarray, of_series: dict[int, np.ndarray], max_p: int, chunk_rows: int):
    """Summaries of chunks at the points that are asked for of their series."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, chunk, values in zip(*(batch.column(c) for c in ("number", "chunk", "values")), strict=True):
                asked, y = of_series.get(number.as_py(), np.zeros(0, np.int64)), np.asarray(values.values, dtype=float)
                for a in range(0, len(asked), ASKED):
                    points = asked[a : a + ASKED]
                    same = np.full(len(points), len(y)), np.full(len(points), chunk.as_py() * chunk_rows)
                    state, products, logs = K.filtered(K.States(*K.model(z[points], max_p)), np.tile(y, (len(points), 1)), *same, True)
                    flat = np.concatenate([state.reshape(len(points), -1), products.reshape(len(points), -1), logs[:, None]], axis=1)
                    columns = [pa.array(points, pa.int32()), pa.array([chunk.as_py()] * len(points), pa.int64()), B.lists(list(flat))]
                    yield pa.RecordBatch.from_arrays(columns, ["point", "chunk", "summary"])

    return run


def _unpacked(flat: np.ndarray, r: int) -> tuple:
    a = r * (r + 2)
    return flat[:a].reshape(r, r + 2), flat[a:-1].reshape(r + 2, r + 2), float(flat[-1])


def _merged(r: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        whole = None
        for flat in table["summary"]:
            part = _unpacked(np.asarray(flat.values), r)
            whole = part if whole is None else K.composed(whole, part)
        flat = np.concatenate([whole[0].ravel(), whole[1].ravel(), [whole[2]]])
        return pa.table({"point": table["point"].slice(0, 1), "chunk": pa.array([table["chunk"][0].as_py() // FAN], pa.int64()), "summary": B.lists([flat])})

    return run


def _long(chunks: DataFrame, series: DataFrame, max_p: int, max_q: int, layout: Layout) -> list[pa.RecordBatch]:
    """Results of a group of long series. `series` is collected; `chunks` has number, chunk and values."""
    info = series.collect()
    n, d, horizon = (np.array([r[c] for r in info], dtype=np.int64) for c in ("n", "d", "horizon"))
    last, rise = (np.array([r[c] for r in info], dtype=float) for c in ("last", "rise"))
    with_mean, r, width, every = d < 2, max(max_p, max_q + 1), max_p + max_q, orders(max_p, max_q)

    def summaries(of: np.ndarray, z: np.ndarray) -> tuple:
        by_series = {int(k): np.flatnonzero(of == k) for k in np.unique(of)}
        found = chunks.mapInArrow(_summaries(z, by_series, max_p, layout.chunk_rows), "point int, chunk long, summary array<double>")
        most = -(-int(n.max()) // layout.chunk_rows)
        while most > 1:
            found = found.groupBy("point", F.floor(F.col("chunk") / FAN).alias("part")).applyInArrow(_merged(r), "point int, chunk long, summary array<double>")
            most = -(-most // FAN)
        flat = np.zeros((len(of), r * (r + 2) + (r + 2) ** 2 + 1))
        for row in found.select("point", "summary").collect():  # a row a point
            flat[row.point] = row.summary
        parts = [_unpacked(f, r) for f in flat]
        return np.stack([p[0][:, r:] for p in parts]), np.stack([p[1][r:, r:] for p in parts]), np.array([p[2] for p in parts])

    # a model of lower order is one of the highest order whose other partial correlations are 0, so all are searched together
    def wide(p: int, q: int, grid: np.ndarray) -> np.ndarray:
        out = np.zeros((len(grid), width))
        out[:, :p], out[:, max_p : max_p + q] = grid[:, :p], grid[:, p:]
        return out

    grids = [wide(p, q, trials(p, q)) for p, q in every]
    owner = np.repeat(np.arange(len(info)), sum(map(len, grids)))
    kind = np.tile(np.repeat(np.arange(len(every)), [len(g) for g in grids]), len(info))
    tried = np.tile(np.concatenate(grids), (len(info), 1))
    _, products, logs = summaries(owner, tried)
    height = K.likelihood(products, logs, n[owner], with_mean[owner])[0]
    first, use = np.cumsum([0, *map(len, grids)]), []
    for at, (p, q) in enumerate(every):
        own = height.reshape(len(info), -1)[:, first[at] : first[at + 1]]
        use.append((np.arange(len(info)) * first[-1] + first[at])[:, None] + valleys(own, p, q))
    use = np.unique(np.concatenate([u.ravel() for u in use]))
    owner, kind, tried = owner[use], kind[use], tried[use]
    free = np.array([[j < p for j in range(max_p)] + [j < q for j in range(max_q)] for p, q in every], dtype=bool).reshape(len(every), width)[kind]

    def target(rows, z):
        _, products, logs = summaries(owner[rows], z)
        return K.likelihood(products, logs, n[owner[rows]], with_mean[owner[rows]])[0]

    z, value = K.minimized(target, tried, free)
    scores, point = np.full((len(info), len(every)), np.inf), np.zeros((len(info), len(every)), dtype=np.int64)
    for i in np.argsort(-value, kind="stable"):  # the best of several starts comes last
        p, q = every[kind[i]]
        scores[owner[i], kind[i]], point[owner[i], kind[i]] = score(value[i : i + 1], n[owner[i] : owner[i] + 1], p, q, with_mean[owner[i]])[0], i
    at = best_of(scores)
    picked = point[np.arange(len(info)), at]
    state, products, logs = summaries(np.arange(len(info)), z[picked])
    _, mean, variance = K.likelihood(products, logs, n, with_mean)
    ar, ma = K.model(z[picked], max_p)
    steps = ahead(K.States(ar, ma), state, mean, horizon)
    chosen = []
    for k, (p, q) in enumerate(every[a] for a in at):
        chosen.append((p, q, scores[k, at[k]], ar[k, :p], ma[k, :q], mean[k], variance[k], steps[k, : horizon[k]]))
    return [_rows(pa.array([x.series_id for x in info]), d, chosen, horizon, last, rise)]


def arima_likelihood(
    clean: DataFrame, horizons: DataFrame, max_p: int = MAX_P, max_q: int = MAX_Q, max_d: int = MAX_D, layout: Layout = DEFAULT
) -> DataFrame:
    """One row per series (FITS): orders, AICc (NULL with too few rows), coefficients, mean and shock variance of the differenced series, and the
    forecasts of steps 1..horizon. The model of w[t] is w[t] - mean = sum ar[i] (w[t-i] - mean) + e[t] + sum ma[j] e[t-j]; after two
    differences there is no mean. Fitting long series takes several Spark jobs a step of the search."""
    w = cut_lineage(to_stationary(clean, max_d, layout) if max_d else clean.withColumn("d", F.lit(0)))
    ends = clean.filter(F.col("pos") >= F.col("n") - 2).groupBy("series_id").agg(
        F.max_by("value", "pos").alias("last"), (F.max_by("value", "pos") - F.min_by("value", "pos")).alias("rise")
    )
    stats = w.groupBy("series_id").agg(F.max("d").cast("int").alias("d"), F.max("n").alias("n"))
    stats = stats.join(ends, "series_id").join(horizons.select("series_id", F.col("horizon").cast("int").alias("horizon")), "series_id")
    arrays = chunk_arrays(w, "n", 0, layout)
    if layout.whole:
        tasks = max(clean.sparkSession.sparkContext.defaultParallelism, w.count() // PER_TASK)
        ready = arrays.select("series_id", "values").join(stats, "series_id").repartition(tasks, "series_id")
        return ready.mapInArrow(_whole(max_p, max_q), FITS)
    arrays, stats, after, out = cut_lineage(arrays), cut_lineage(stats), "", []
    while True:  # groups by name: what the driver holds of a group is bounded
        group = stats.filter(F.col("series_id") > after).orderBy("series_id").limit(GROUP)
        names = [r.series_id for r in group.select("series_id").collect()]
        if not names:
            break
        after = names[-1]
        number = F.create_map(*[F.lit(v) for k, name in enumerate(names) for v in (name, k)])[F.col("series_id")].cast("int")
        chunks = cut_lineage(arrays.filter(F.col("series_id").isin(*names)).select(number.alias("number"), "chunk", "values"))
        out += _long(chunks, stats.filter(F.col("series_id").isin(*names)).orderBy("series_id"), max_p, max_q, layout)
    spark = clean.sparkSession
    return spark.createDataFrame(pa.Table.from_batches(out), FITS) if out else spark.createDataFrame([], FITS)
