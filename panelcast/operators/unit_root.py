"""Stationarity tests: KPSS (level) and augmented Dickey-Fuller (constant), and their verdict."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions import batch as B
from panelcast.operators.layout import DEFAULT, Layout, all_of_chunk, attach, chunk_arrays, in_chunk, keep, sum_arrays

ALPHA = 0.05

# Published 10, 5, 2.5 and 1 % points of the level KPSS statistic.
KPSS_POINTS = ((0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01))

# Published response surface for the Dickey-Fuller p-value with a constant.
TAU_MAX, TAU_MIN, TAU_SPLIT = 2.74, -18.83, -1.61
TAU_SMALL = (2.1659, 1.4412, 0.038269)
TAU_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)

TOO_SHORT, CONSTANT = "series too short", "series is constant"
ADF_ROWS = "series_id string, statistic double, pvalue double, lags int"


# ---- KPSS -----------------------------------------------------------------------------------


def kpss_pvalue(stat: Column) -> Column:
    (x0, p0), *rest = KPSS_POINTS
    out = F.when(stat <= x0, F.lit(p0))
    for x1, p1 in rest:
        out = out.when(stat <= x1, p0 + (stat - x0) * ((p1 - p0) / (x1 - x0)))
        x0, p0 = x1, p1
    return out.when(stat > x0, F.lit(p0))


def _centred_sums(clean: DataFrame, layout: Layout) -> DataFrame:
    """Rows with `s`, the running sum of the values less their mean."""
    if layout.whole:
        rows = clean.withColumn("mean", F.avg("value").over(all_of_chunk(layout))).withColumn("s_before", F.lit(0.0))
    else:
        per_chunk = clean.groupBy("series_id", "chunk").agg(F.sum("value").alias("v"), F.count(F.lit(1)).alias("c"))
        whole = Window.partitionBy("series_id")
        earlier = whole.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        offsets = per_chunk.withColumn("mean", F.sum("v").over(whole) / F.sum("c").over(whole)).withColumn(
            "s_before", F.coalesce(F.sum(F.col("v") - F.col("c") * F.col("mean")).over(earlier), F.lit(0.0))
        )
        rows = clean.join(offsets.drop("v", "c"), ["series_id", "chunk"])
    upto = in_chunk(layout).rowsBetween(Window.unboundedPreceding, 0)
    s = F.col("s_before") + F.sum(F.col("value") - F.col("mean")).over(upto)
    s = F.when(F.col("pos") < F.col("n") - 1, s).otherwise(F.lit(0.0))
    return rows.select("series_id", "chunk", "pos", "n", "value", s.alias("s"))


def _shifted_squares(sums: DataFrame, shifts: dict[str, Column]) -> DataFrame:
    """Per series and name: the sum over t of (s[t] - s[t - shift])**2, s being 0 outside the series.

    The shift differs per series, so it cannot be a frame. Every row adds its s at its own place and
    takes it away `shift` places later; adding up per place gives the differences. The places spread
    over all tasks, however long the series is.
    """
    names = list(shifts)

    def entry(place, sign, own):
        return F.struct(
            place.alias("place"), *[(sign * F.col("s") if n in own else F.lit(0.0)).alias(n) for n in names]
        )

    entries = [entry(F.col("pos"), 1.0, names)]
    entries += [entry(F.col("pos") + by.cast("bigint"), -1.0, [n]) for n, by in shifts.items()]
    by_place = (
        sums.select("series_id", F.explode(F.array(*entries)).alias("e"))
        .groupBy("series_id", "e.place")
        .agg(*[F.sum(f"e.{n}").alias(n) for n in names])
    )
    return by_place.groupBy("series_id").agg(*[F.sum(F.col(n) * F.col(n)).alias(n) for n in names])


def _array_squares(s: Column, shift: Column) -> Column:
    """The same sum for a series held in one array."""
    gap = F.array_repeat(F.lit(0.0), shift.cast("int"))
    squares = F.zip_with(F.concat(s, gap), F.concat(gap, s), lambda a, b: (a - b) * (a - b))
    return F.aggregate(squares, F.lit(0.0), lambda total, x: total + x)


def _with_bandwidth(series: DataFrame) -> DataFrame:
    """Add the automatic number of lags, from the squared sums at L + 1 and L neighbours. Step by step,
    so that no sum is computed twice."""
    n = F.col("n")
    up_to = F.floor(F.pow(n, F.lit(2.0 / 9.0)))
    chosen = F.floor(1.1447 * F.pow(F.col("ratio") * F.col("ratio"), F.lit(1.0 / 3.0)) * F.pow(n, F.lit(1.0 / 3.0)))
    return (
        series.withColumn("s0", (F.col("d_start") - F.col("d_less")) / n)
        .withColumn("ratio", ((up_to + 1) * F.col("s0") - F.col("d_start") / n) / F.when(F.col("s0") != 0, F.col("s0")))
        .withColumn("lags", F.least(F.coalesce(chosen, n - 1), n - 1))
        .drop("d_start", "d_less", "s0", "ratio")
    )


def _kpss_sums_whole(clean: DataFrame, layout: Layout) -> DataFrame:
    """n, constant, ss, lags and d per series; a whole series fits into an array, so nothing is shuffled."""
    sums = _centred_sums(clean, layout)
    in_order = F.sort_array(F.collect_list(F.struct("pos", "s")))
    series = sums.groupBy("series_id").agg(
        F.max("n").cast("double").alias("n"),
        (F.max("value") == F.min("value")).alias("constant"),
        F.sum(F.col("s") * F.col("s")).alias("ss"),
        F.transform(in_order, lambda r: r["s"]).alias("s"),
    )
    start = F.floor(F.pow(F.col("n"), F.lit(2.0 / 9.0)))
    series = series.withColumns(
        {"d_start": _array_squares(F.col("s"), start + 1), "d_less": _array_squares(F.col("s"), start)}
    )
    return _with_bandwidth(series).withColumn("d", _array_squares(F.col("s"), F.col("lags") + 1)).drop("s")


def _kpss_sums_cut(clean: DataFrame, layout: Layout) -> DataFrame:
    sums = keep(_centred_sums(clean, layout), layout)
    stats = sums.groupBy("series_id").agg(
        F.max("n").cast("double").alias("n"),
        (F.max("value") == F.min("value")).alias("constant"),
        F.sum(F.col("s") * F.col("s")).alias("ss"),
    )
    start = F.floor(F.pow(F.col("n"), F.lit(2.0 / 9.0)))
    width = _shifted_squares(sums, {"d_start": start + 1, "d_less": start})
    lags = keep(_with_bandwidth(stats.join(width, "series_id")), layout)
    final = _shifted_squares(attach(sums, lags.select("series_id", "n", "lags"), "n", layout), {"d": F.col("lags") + 1})
    return lags.join(final, "series_id")


def kpss(clean: DataFrame, layout: Layout = DEFAULT) -> DataFrame:
    """statistic, pvalue and number of lags per series; NULL with an error text for a constant one.

    With Bartlett weights the long-run variance at l lags is the mean square of the sums of l + 1
    neighbours over l + 1, which are differences of the running sum s. The autocovariances that the
    automatic bandwidth needs follow from the two variances at L and L - 1 lags in the same way.
    """
    series = (_kpss_sums_whole if layout.whole else _kpss_sums_cut)(clean, layout)
    variance = F.col("d") / (F.col("n") * (F.col("lags") + 1))
    usable = ~F.col("constant") & (variance > 0)
    stat = F.when(usable, F.col("ss") / (F.col("n") * F.col("n")) / F.when(variance > 0, variance))
    return series.select("series_id", stat.alias("statistic"), "lags").select(
        "series_id",
        "statistic",
        kpss_pvalue(F.col("statistic")).alias("pvalue"),
        F.when(F.col("statistic").isNotNull(), F.col("lags")).cast("int").alias("lags"),
        F.when(F.col("statistic").isNull(), F.lit(CONSTANT)).alias("error"),
    )


# ---- ADF ------------------------------------------------------------------------------------


def max_lag(n: Column) -> Column:
    widest = F.ceil(12 * F.pow(n / 100, F.lit(0.25)))
    return F.least(widest, F.floor(n / 2) - 2).cast("int")


def _adf_grams(batches):
    """Per chunk: Gram matrix of 1, y[t-1], dy[t-1..t-k], dy[t] over the chunk's own rows (flattened)
    and, from the first chunk, the k + 1 values the series starts with."""
    for batch in B.pieces(batches, "values"):
        values, lengths = B.padded(batch.column("values"))
        k = np.asarray(batch.column("k"))
        mean, sd = np.asarray(batch.column("mean")), np.asarray(batch.column("sd"))
        chunk = np.asarray(batch.column("chunk"))
        values = (values - mean[:, None]) / sd[:, None]
        grams, heads = [None] * len(k), [None] * len(k)
        for rows in B.groups(k, limit=B.CELLS, cost=values.shape[1] * (k + 3)):
            lag = int(k[rows[0]])
            y = values[rows, : int(lengths[rows].max())]
            seen = np.arange(lag + 1, y.shape[1])[None, :] < lengths[rows][:, None]
            change = np.diff(y, axis=1)
            m = seen.shape[1]
            columns = [np.ones_like(seen, dtype=float), y[:, lag : lag + m]]
            columns += [change[:, lag - i : lag - i + m] for i in range(1, lag + 1)]
            x = np.stack([*columns, change[:, lag : lag + m]], axis=2) * seen[:, :, None]
            gram = np.matmul(x.transpose(0, 2, 1), x)
            for i, r in enumerate(rows):
                grams[r] = gram[i].ravel()
                heads[r] = values[r, : lag + 1] if chunk[r] == 0 else None
        yield pa.RecordBatch.from_arrays(
            [batch.column("series_id"), batch.column("chunk"), batch.column("n"), batch.column("k"),
             B.lists(grams), B.lists(heads)],
            names=["series_id", "chunk", "n", "k", "gram", "head"],
        )


def _adf_statistics(batches):
    """From the summed Gram matrices: the lag with the lowest AIC on common rows, then the t value of
    y[t-1] in the regression at that lag on all its rows."""
    for batch in B.pieces(batches, "gram"):
        n, k = np.asarray(batch.column("n")), np.asarray(batch.column("k"))
        grams, heads = batch.column("gram"), batch.column("head")
        stat, used = np.full(len(n), np.nan), np.zeros(len(n), dtype=np.int32)
        for rows in B.groups(k):
            lag = int(k[rows[0]])
            q = lag + 3
            gram = np.stack([np.asarray(grams[int(r)].values) for r in rows]).reshape(-1, q, q)
            head = np.stack([np.asarray(heads[int(r)].values) for r in rows])
            m = (n[rows] - 1 - lag)[:, None]
            ssr = B.residual_squares(B.factor(gram))[:, 2 : lag + 3]
            aic = m * np.log(np.maximum(ssr, 1e-300)) + 2 * np.arange(lag + 1)
            best = aic.argmin(axis=1)
            for b in np.unique(best):
                mine = best == b
                # order: 1, dy[t-1..t-b], y[t-1], dy[t]; rows b+1..lag are missing from the common sample
                pick = np.r_[0, np.arange(2, 2 + b), 1, q - 1]
                full = gram[mine][:, pick][:, :, pick]
                start, change = head[mine], np.diff(head[mine], axis=1)
                for t in range(b + 1, lag + 1):
                    row = np.column_stack(
                        [np.ones(len(start)), *[change[:, t - 1 - i] for i in range(1, b + 1)], start[:, t - 1], change[:, t - 1]]
                    )
                    full = full + row[:, :, None] * row[:, None, :]
                lower = B.factor(full)
                df = n[rows][mine] - 1 - b - (b + 2)
                sigma = np.sqrt(lower[:, -1, -1] ** 2 / np.maximum(df, 1))
                with np.errstate(divide="ignore", invalid="ignore"):
                    t_value = np.where((df > 0) & (lower[:, -2, -2] > 0), lower[:, -1, -2] / sigma, np.nan)
                stat[rows[mine]], used[rows[mine]] = t_value, b
        yield pa.RecordBatch.from_arrays(
            [batch.column("series_id"), pa.array(stat, mask=~np.isfinite(stat)),
             pa.array(adf_pvalues(stat), mask=~np.isfinite(stat)), pa.array(used)],
            names=["series_id", "statistic", "pvalue", "lags"],
        )


def adf_pvalues(stat: np.ndarray) -> np.ndarray:
    small, large = np.polyval(TAU_SMALL[::-1], stat), np.polyval(TAU_LARGE[::-1], stat)
    z = np.where(stat <= TAU_SPLIT, small, large)
    p = np.array([0.5 * math.erfc(-v / math.sqrt(2)) if math.isfinite(v) else math.nan for v in z])
    return np.where(stat > TAU_MAX, 1.0, np.where(stat < TAU_MIN, 0.0, p))


def adf(clean: DataFrame, lags: int | None = None, layout: Layout = DEFAULT) -> DataFrame:
    """statistic, pvalue and chosen lag per series. `lags` caps the lags tried (0: plain Dickey-Fuller)."""
    k = max_lag(F.col("n"))
    if lags is not None:
        k = F.least(k, F.lit(lags))
    stats = clean.groupBy("series_id").agg(
        F.max("n").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"),
        (F.max("value") == F.min("value")).alias("constant"),
    )
    usable = stats.filter((max_lag(F.col("n")) >= 0) & ~F.col("constant")).drop("constant").withColumn("k", k)
    arrays = chunk_arrays(clean, "n", F.greatest(k + 1, F.lit(1)), layout)
    ready = attach(arrays, usable, "n", layout).select("series_id", "chunk", "n", "k", "mean", "sd", "values")
    if layout.whole:  # one Python worker a task does both
        tested = ready.mapInArrow(lambda batches: _adf_statistics(_adf_grams(batches)), ADF_ROWS)
    else:
        grams = ready.mapInArrow(
            _adf_grams, "series_id string, chunk bigint, n bigint, k int, gram array<double>, head array<double>"
        )
        heads = grams.filter("chunk = 0").select("series_id", "head")
        summed = sum_arrays(grams.drop("head"), "gram", layout).join(heads, "series_id")
        tested = summed.select("series_id", "n", "k", "gram", "head").mapInArrow(_adf_statistics, ADF_ROWS)
    problem = F.when(F.col("constant"), CONSTANT).when(max_lag(F.col("n")) < 0, TOO_SHORT)
    return stats.join(tested, "series_id", "left").select(
        "series_id",
        "statistic",
        "pvalue",
        "lags",
        F.coalesce(problem, F.when(F.col("statistic").isNull(), TOO_SHORT)).alias("error"),
    )


def stationarity(clean: DataFrame, adf_lags: int | None = None, layout: Layout = DEFAULT) -> DataFrame:
    """Both tests; stationary when the unit root is rejected and level stationarity is not. A series
    that cannot be tested gets NULL statistics, stationary = false and the reason."""
    a, k = adf(clean, adf_lags, layout), kpss(clean, layout)
    rejects = F.coalesce(F.col("adf_pvalue") < ALPHA, F.lit(False))
    accepts = F.coalesce(F.col("kpss_pvalue") >= ALPHA, F.lit(False))
    both = a.select(
        "series_id", F.col("statistic").alias("adf_statistic"), F.col("pvalue").alias("adf_pvalue"), "error"
    ).join(
        k.select("series_id", F.col("statistic").alias("kpss_statistic"), F.col("pvalue").alias("kpss_pvalue")),
        "series_id",
    )
    return both.select(
        "series_id",
        "adf_statistic",
        "adf_pvalue",
        rejects.alias("adf_stationary"),
        "kpss_statistic",
        "kpss_pvalue",
        accepts.alias("kpss_stationary"),
        (rejects & accepts).alias("stationary"),
        "error",
    )
