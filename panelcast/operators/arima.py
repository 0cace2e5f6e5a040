"""Non-seasonal ARIMA by the two-step regression method of Hannan and Rissanen.

The order of differencing comes from repeated KPSS tests. A long autoregression gives estimates of the
shocks; regressions on lagged values and lagged shocks then give every (p, q) up to (3, 3) on common
rows, and the lowest AICc among the stationary ones is kept. Both regressions need sums of products
only, which chunks of a long series add up to.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions import batch as B
from panelcast.operators.layout import (
    DEFAULT,
    Layout,
    attach,
    chunk_arrays,
    chunk_of,
    in_chunk,
    keep,
    own_rows,
    spread,
    sum_arrays,
)
from panelcast.operators.unit_root import ALPHA, kpss
from panelcast.session import cut_lineage

MAX_P, MAX_Q, MAX_D = 3, 3, 2


def differenced(clean: DataFrame, layout: Layout) -> DataFrame:
    """First differences of `clean`, in the same shape."""
    rows = spread(clean, "n", 1, layout=layout)
    change = F.col("value") - F.lag("value").over(in_chunk(layout))
    return (
        own_rows(rows.withColumn("value", change), layout).filter("pos > 0")
        .withColumn("pos", F.col("pos") - 1)
        .withColumn("n", F.col("n") - 1)
        .withColumn("chunk", chunk_of("pos", layout))
    )


def to_stationary(clean: DataFrame, max_d: int, layout: Layout) -> DataFrame:
    """Rows of each series differenced until KPSS no longer rejects, at most max_d times, with `d`."""
    done, rows = [], clean
    for d in range(max_d):
        sizes = rows.groupBy("series_id").agg(F.max("n").alias("n"))
        rejects = kpss(rows, layout).select(
            "series_id", F.coalesce(F.col("pvalue") < ALPHA, F.lit(False)).alias("again")
        )
        judged = cut_lineage(attach(rows, rejects.join(sizes, "series_id"), "n", layout))
        done.append(judged.filter("NOT again").drop("again").withColumn("d", F.lit(d)))
        rows = differenced(judged.filter("again").drop("again"), layout)
    done.append(rows.withColumn("d", F.lit(max_d)))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def long_order(n: Column) -> Column:
    return F.least(F.ceil(10 * F.log10(n)), F.floor(n / 4)).cast("int")


def _lagged(w: np.ndarray, lags: int, start: int) -> list[np.ndarray]:
    """Columns w[t-1] .. w[t-lags] for t = start ..."""
    return [w[:, start - i : w.shape[1] - i] for i in range(1, lags + 1)]


def _at_least(w: np.ndarray, width: int) -> np.ndarray:
    return np.pad(w, ((0, 0), (0, max(0, width - w.shape[1]))))


def _long_grams(batches):
    for batch in B.pieces(batches, "values"):
        values, lengths = B.padded(batch.column("values"))
        m, mean = np.asarray(batch.column("m")), np.asarray(batch.column("mean"))
        grams = [None] * len(m)
        for rows in B.groups(m, limit=B.CELLS, cost=values.shape[1] * (m + 2)):
            k = int(m[rows[0]])
            w = _at_least(values[rows, : int(lengths[rows].max())] - mean[rows, None], k + 1)
            seen = np.arange(k, w.shape[1])[None, :] < lengths[rows][:, None]
            x = np.stack([np.ones(seen.shape), *_lagged(w, k, k), w[:, k:]], axis=2) * seen[:, :, None]
            gram = np.matmul(x.transpose(0, 2, 1), x)
            for i, r in enumerate(rows):
                grams[r] = gram[i].ravel()
        yield pa.RecordBatch.from_arrays(
            [batch.column("series_id"), batch.column("chunk"), batch.column("m"), B.lists(grams)],
            names=["series_id", "chunk", "m", "gram"],
        )


def _long_fits(batches):
    for batch in B.pieces(batches, "gram"):
        m, grams = np.asarray(batch.column("m")), batch.column("gram")
        fits = [None] * len(m)
        for rows in B.groups(m):
            q = int(m[rows[0]]) + 2
            gram = np.stack([np.asarray(grams[int(r)].values) for r in rows]).reshape(-1, q, q)
            beta = B.coefficients(B.factor(gram))
            for i, r in enumerate(rows):
                fits[r] = beta[i]
        yield pa.RecordBatch.from_arrays([batch.column("series_id"), B.lists(fits)], names=["series_id", "long"])


def _short_grams(max_p: int, max_q: int):
    def run(batches):
        width = 2 + max_p + max_q
        for batch in B.pieces(batches, "values"):
            values, lengths = B.padded(batch.column("values"))
            m, mean = np.asarray(batch.column("m")), np.asarray(batch.column("mean"))
            long = batch.column("long")
            grams, tails = [None] * len(m), [None] * len(m)
            for rows in B.groups(m, limit=B.CELLS, cost=values.shape[1] * (m + width)):
                k = int(m[rows[0]])
                size = lengths[rows]
                start = max(max_p, k + max_q if max_q else 0)
                w = _at_least(values[rows, : int(size.max())] - mean[rows, None], start + 1)
                shock = np.zeros_like(w)
                if max_q:
                    beta = np.stack([np.asarray(long[int(r)].values) for r in rows])
                    past = sum(beta[:, i, None] * c for i, c in enumerate(_lagged(w, k, k), 1))
                    shock[:, k:] = w[:, k:] - beta[:, :1] - past
                seen = np.arange(start, w.shape[1])[None, :] < size[:, None]
                columns = [np.ones(seen.shape), *_lagged(w, max_p, start), *_lagged(shock, max_q, start), w[:, start:]]
                x = np.stack(columns, axis=2) * seen[:, :, None]
                gram = np.matmul(x.transpose(0, 2, 1), x)
                for i, r in enumerate(rows):
                    grams[r] = gram[i].ravel()
                    end = int(size[i])
                    take = lambda a, c: np.r_[np.zeros(c), a[i, :end]][::-1][:c]
                    tails[r] = np.r_[take(w, max_p), take(shock, max_q)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("series_id"), batch.column("chunk"), B.lists(grams), B.lists(tails)],
                names=["series_id", "chunk", "gram", "tail"],
            )

    return run


def _choose(max_p: int, max_q: int):
    """Best (p, q) per series and the forecast of the differenced values, then of the values."""

    def run(batches):
        width = 2 + max_p + max_q
        for batch in B.pieces(batches, "gram"):
            n = batch.num_rows
            gram = np.stack([np.asarray(g.values) for g in batch.column("gram")]).reshape(n, width, width)
            tail = np.stack([np.asarray(t.values) for t in batch.column("tail")]).reshape(n, max_p + max_q)
            d, horizon = np.asarray(batch.column("d")), np.asarray(batch.column("horizon"))
            mean = np.asarray(batch.column("mean"))
            last, rise = np.asarray(batch.column("last")), np.asarray(batch.column("rise"))
            rows = gram[:, 0, 0].copy()
            gram[d == 2, 0], gram[d == 2, :, 0] = 0.0, 0.0  # no constant after two differences
            best = np.full(n, np.inf)
            order = np.zeros((n, 2), dtype=np.int32)
            # without any usable regression: the mean, or no change when differenced
            const, ar, ma = np.where(d == 0, 0.0, -mean), np.zeros((n, max_p)), np.zeros((n, max_q))
            for p in range(max_p + 1):
                for q in range(max_q + 1):
                    pick = np.r_[0, 1 : 1 + p, 1 + max_p : 1 + max_p + q, width - 1].astype(int)
                    lower = B.factor(gram[:, pick][:, :, pick])
                    beta, k = B.coefficients(lower), p + q + 1 + (d < 2)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        sse = np.maximum(lower[:, -1, -1] ** 2, 1e-300)
                        score = rows * np.log(sse / rows) + 2 * k + 2 * k * (k + 1) / (rows - k - 1)
                    stable = np.ones(n, dtype=bool)
                    if p:
                        companion = np.zeros((n, p, p))
                        companion[:, 0] = beta[:, 1 : 1 + p]
                        companion[:, np.arange(1, p), np.arange(p - 1)] = 1.0
                        stable = np.abs(np.linalg.eigvals(companion)).max(axis=1) < 1
                    better = (rows - k - 1 > 0) & stable & np.isfinite(score) & (score < best)
                    best[better], order[better] = score[better], (p, q)
                    const[better], ar[better], ma[better] = beta[better, 0], 0.0, 0.0
                    ar[better, :p], ma[better, :q] = beta[better, 1 : 1 + p], beta[better, 1 + p :]
            steps = int(horizon.max(initial=0))
            past, shocks = tail[:, :max_p].copy(), tail[:, max_p:].copy()
            ahead = np.zeros((n, steps))
            for h in range(steps):
                ahead[:, h] = const + (ar * past).sum(axis=1) + (ma * shocks).sum(axis=1)
                if max_p:
                    past = np.column_stack([ahead[:, h], past[:, :-1]])
                if max_q:
                    shocks = np.column_stack([np.zeros(n), shocks[:, :-1]])
            ahead += mean[:, None]
            once, twice = np.cumsum(ahead, axis=1), np.cumsum(np.cumsum(ahead, axis=1), axis=1)
            out = np.where((d == 0)[:, None], ahead, last[:, None] + once)
            count = np.arange(1, steps + 1)
            out = np.where((d == 2)[:, None], last[:, None] + rise[:, None] * count + twice, out)
            yield pa.RecordBatch.from_arrays(
                [batch.column("series_id"), batch.column("d"), pa.array(order[:, 0]), pa.array(order[:, 1]),
                 B.lists([out[i, : horizon[i]] for i in range(n)])],
                names=["series_id", "d", "p", "q", "predicted"],
            )

    return run


def arima(
    clean: DataFrame,
    horizons: DataFrame,
    max_p: int = MAX_P,
    max_q: int = MAX_Q,
    max_d: int = MAX_D,
    layout: Layout = DEFAULT,
) -> DataFrame:
    """(series_id, d, p, q, predicted): the chosen orders and the forecasts of steps 1..horizon."""
    w = to_stationary(clean, max_d, layout) if max_d else clean.withColumn("d", F.lit(0))
    w = cut_lineage(w)
    order = long_order(F.col("n")) if max_q else F.lit(0)
    reach = F.greatest(order + max_q, F.lit(max_p))  # rows a regression row looks back
    stats = w.groupBy("series_id").agg(F.max("n").alias("n"), F.max("d").alias("d"), F.avg("value").alias("mean"))
    stats = cut_lineage(
        stats.withColumn("m", order).withColumn("mean", F.when(F.col("d") < 2, F.col("mean")).otherwise(F.lit(0.0)))
    )
    ready = attach(chunk_arrays(w, "n", reach, layout), stats, "n", layout)
    if max_q:
        # the long regression looks back less far, so it leaves out the first of the earlier rows
        spare = F.when(F.col("chunk") > 0, reach - F.col("m")).otherwise(F.lit(0))
        ready = keep(ready, layout)
        inputs = ready.select(
            "series_id", "chunk", "m", "mean", F.slice("values", spare + 1, F.size("values")).alias("values")
        )
        fitted = "series_id string, long array<double>"
        if layout.whole:  # one Python worker a task does both
            fits = inputs.mapInArrow(lambda batches: _long_fits(_long_grams(batches)), fitted)
        else:
            grams = inputs.mapInArrow(_long_grams, "series_id string, chunk bigint, m int, gram array<double>")
            fits = sum_arrays(grams, "gram", layout).mapInArrow(_long_fits, fitted)
        ready = attach(ready, fits.join(stats.select("series_id", "n"), "series_id"), "n", layout)
    else:
        ready = ready.withColumn("long", F.array().cast("array<double>"))
    short = ready.select("series_id", "chunk", "m", "mean", "values", "long").mapInArrow(
        _short_grams(max_p, max_q), "series_id string, chunk bigint, gram array<double>, tail array<double>"
    )
    if layout.whole:
        summed = short.drop("chunk")
    else:
        short = cut_lineage(short)
        tails = short.groupBy("series_id").agg(F.max_by("tail", "chunk").alias("tail"))
        summed = sum_arrays(short.drop("tail"), "gram", layout).join(tails, "series_id")
    ends = clean.filter(F.col("pos") >= F.col("n") - 2).groupBy("series_id").agg(
        F.max_by("value", "pos").alias("last"),
        (F.max_by("value", "pos") - F.min_by("value", "pos")).alias("rise"),
    )
    inputs = summed.join(stats.select("series_id", "d", "mean"), "series_id").join(ends, "series_id")
    return inputs.join(horizons.select("series_id", "horizon"), "series_id").mapInArrow(
        _choose(max_p, max_q), "series_id string, d int, p int, q int, predicted array<double>"
    )


def arima_forecasts(fits: DataFrame) -> DataFrame:
    return fits.select("series_id", F.posexplode("predicted").alias("i", "predicted")).select(
        "series_id", F.lit("ARIMA").alias("model_name"), (F.col("i") + 1).alias("step"), "predicted"
    )
