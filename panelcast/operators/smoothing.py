"""Exponential smoothing and Theta forecasts.

Both choose from a fixed grid of smoothing parameters. The recursion
    e = y - (l + phi b);  l <- l + phi b + alpha e;  b <- phi b + alpha beta e
is linear in the state (l, b), so a chunk of a long series can be summarized without knowing the state
it starts from: the state it ends in is a linear map of the state it starts in, and its sum of squared
errors a quadratic form of it. Chunks are therefore scanned in parallel and only their small summaries
are put one after the other.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.functions import batch as B
from panelcast.session import cut_lineage
from panelcast.operators.layout import DEFAULT, Layout, chunk_arrays

LEVEL_ALPHAS = tuple(round(0.05 * i, 2) for i in range(1, 20)) + (0.99,)
ALPHAS, BETAS, PHIS = (0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9), (0.01, 0.05, 0.1, 0.2, 0.4), (0.8, 0.9, 0.98)

# (form, alpha, beta, phi); phi = 0 switches the slope off, phi = 1 leaves it undamped
GRID = (
    [("level", a, 0.0, 0.0) for a in LEVEL_ALPHAS]
    + [("trend", a, b, 1.0) for a, b in itertools.product(ALPHAS, BETAS)]
    + [("damped", a, b, p) for a, b, p in itertools.product(ALPHAS, BETAS, PHIS)]
)
ESTIMATED = {"level": 3, "trend": 5, "damped": 6}  # smoothing parameters, initial states, variance
START_ROWS = 10  # rows the initial slope is taken from

_N = len(GRID)
_ALPHA, _BETA, _PHI = (np.array([g[i] for g in GRID]) for i in (1, 2, 3))
_LEVEL = np.array([g[0] == "level" for g in GRID])
_K = np.array([ESTIMATED[g[0]] for g in GRID])


def starts(clean: DataFrame) -> DataFrame:
    """First value, and line through the first rows, per series."""
    y, t = F.when(F.col("pos") < START_ROWS, F.col("value")), F.col("pos") + 1
    return clean.groupBy("series_id").agg(
        F.max("n").alias("n"),
        F.min_by("value", "pos").alias("first"),
        F.coalesce(F.regr_intercept(y, t), F.min_by("value", "pos")).alias("line"),
        F.coalesce(F.regr_slope(y, t), F.lit(0.0)).alias("rise"),
    )


def _scan(y, lengths, level, slope, carry=None):
    """Run the recursion over padded rows sorted by falling length. level and slope are
    (rows, parameters) or, with a basis axis, (rows, 3, parameters); returns end states and what
    `carry(errors, rows)` collects."""
    for t in range(y.shape[1]):
        k = int(np.searchsorted(-lengths, -t, side="left"))
        if k == 0:
            break
        expected = level[:k] + _PHI * slope[:k]
        error = y[:k, t] - expected
        carry(error, k)
        level[:k] = expected + _ALPHA * error
        slope[:k] = _PHI * slope[:k] + _ALPHA * _BETA * error


def aicc(sse, n, k):
    with np.errstate(divide="ignore", invalid="ignore"):
        fit = n * np.log(np.maximum(sse, 1e-300) / n) + 2 * k + 2 * k * (k + 1) / (n - k - 1)
    return np.where(n - k - 1 > 0, fit, np.inf)


def _whole_series(batches):
    """Best ETS and best Theta parameter per series, with the final states."""
    for batch in B.pieces(batches, "values"):
        values, lengths = B.padded(batch.column("values"))
        first, line, rise = (np.asarray(batch.column(c)) for c in ("first", "line", "rise"))
        picked = {name: np.zeros(len(lengths)) for name in ("ets_l", "ets_b", "theta_l")}
        index = {name: np.zeros(len(lengths), dtype=np.int32) for name in ("ets", "theta")}
        order = np.argsort(-lengths, kind="stable")
        for rows in np.array_split(order, max(1, len(order) * _N // 500_000)):
            if not len(rows):
                continue
            level = np.where(_LEVEL, first[rows, None], line[rows, None])
            slope = np.where(_LEVEL, 0.0, rise[rows, None])
            sse = np.zeros_like(level)

            def carry(error, k, sse=sse):
                sse[:k] += error * error

            _scan(values[rows][:, : lengths[rows].max(), None], lengths[rows], level, slope, carry)
            n = lengths[rows][:, None].astype(float)
            score = aicc(sse, n, _K)
            shortest = ~np.isfinite(score).any(axis=1)
            score[shortest] = np.where(_LEVEL, sse[shortest], np.inf)
            theta = np.where(_LEVEL, sse, np.inf).argmin(axis=1)
            ets, at = score.argmin(axis=1), np.arange(len(rows))
            index["ets"][rows], index["theta"][rows] = ets, theta
            picked["ets_l"][rows], picked["ets_b"][rows] = level[at, ets], slope[at, ets]
            picked["theta_l"][rows] = level[at, theta]
        yield pa.RecordBatch.from_arrays(
            [batch.column("series_id"), batch.column("n"),
             pa.array(index["ets"]), pa.array(picked["ets_l"]), pa.array(picked["ets_b"]),
             pa.array(index["theta"]), pa.array(picked["theta_l"])],
            names=["series_id", "n", "ets", "ets_l", "ets_b", "theta", "theta_l"],
        )


def _chunk_summaries(batches):
    """Per chunk and parameter: the end state as a linear map of (l, b, 1) and the squared errors as a
    quadratic form of it; 12 numbers each, flattened."""
    upper = [(i, j) for i in range(3) for j in range(i, 3)]
    for batch in B.pieces(batches, "values"):
        values, lengths = B.padded(batch.column("values"))
        out = [None] * len(lengths)
        order = np.argsort(-lengths, kind="stable")
        for rows in np.array_split(order, max(1, len(order) * _N * 3 // 500_000)):
            if not len(rows):
                continue
            y = values[rows][:, : lengths[rows].max()]
            y = np.stack([np.zeros_like(y), np.zeros_like(y), y], axis=2)[:, :, :, None]
            level, slope = np.zeros((len(rows), 3, _N)), np.zeros((len(rows), 3, _N))
            level[:, 0], slope[:, 1] = 1.0, 1.0
            squares = np.zeros((len(rows), 6, _N))

            def carry(error, k, squares=squares):
                for s, (i, j) in enumerate(upper):
                    squares[:k, s] += error[:, i] * error[:, j] * (1 if i == j else 2)

            _scan(y, lengths[rows], level, slope, carry)
            summary = np.concatenate([level, slope, squares], axis=1).transpose(0, 2, 1)
            for i, r in enumerate(rows):
                out[r] = summary[i].ravel()
        yield pa.RecordBatch.from_arrays(
            [batch.column("series_id"), batch.column("chunk"), B.lists(out)],
            names=["series_id", "chunk", "summary"],
        )


def _grid_column(i: int):
    return F.array(*[F.lit(g[i]) for g in GRID])


FAN = 256  # summaries that one task puts one after the other


def _after(a, b):
    """The summary of two neighbouring stretches: the map of the first, then that of the second, and the squared errors of
    both as one quadratic form of the state before the first."""
    (x, y, z), (u, v, w) = [a[i] for i in range(3)], [a[i] for i in range(3, 6)]
    maps = [b[r] * p + b[r + 1] * q + (b[r + 2] if c == 2 else 0.0) for r in (0, 3) for c, (p, q) in enumerate(((x, u), (y, v), (z, w)))]
    ll, lb, l, bb, b_, one = (b[i] for i in range(6, 12))
    squares = [
        ll * x * x + lb * x * u + bb * u * u,
        2 * ll * x * y + lb * (x * v + y * u) + 2 * bb * u * v,
        2 * ll * x * z + lb * (x * w + z * u) + l * x + 2 * bb * u * w + b_ * u,
        ll * y * y + lb * y * v + bb * v * v,
        2 * ll * y * z + lb * (y * w + z * v) + l * y + 2 * bb * v * w + b_ * v,
        ll * z * z + lb * z * w + l * z + bb * w * w + b_ * w + one,
    ]
    return F.array(*maps, *[a[6 + i] + s for i, s in enumerate(squares)])


def _shortened(rows: DataFrame) -> DataFrame:
    """Summaries of FAN neighbouring chunks as one, again and again, until a series has at most FAN: composition is
    associative, so no task ever holds more, however long the series is."""
    last = rows.agg(F.max("chunk")).first()[0] or 0
    while last >= FAN:
        run = F.sort_array(F.collect_list(F.struct("chunk", "m")))
        grouped = rows.groupBy("series_id", "g", F.floor(F.col("chunk") / FAN).alias("next")).agg(run.alias("run"))
        rest = F.slice("run", F.lit(2), F.greatest(F.size("run") - 1, F.lit(0)))
        one = F.aggregate(rest, F.col("run")[0]["m"], lambda m, c: _after(m, c["m"]))
        rows = cut_lineage(grouped.select("series_id", F.col("next").alias("chunk"), "g", one.alias("m")))
        last //= FAN
    return rows


def _compose(summaries: DataFrame, begin: DataFrame) -> DataFrame:
    """Put the chunk summaries of each series and parameter one after the other and pick the best."""
    per_parameter = summaries.select(
        "series_id", "chunk", "summary", F.explode(F.sequence(F.lit(0), F.lit(_N - 1))).alias("g")
    ).select("series_id", "chunk", "g", F.slice("summary", F.col("g") * 12 + 1, F.lit(12)).alias("m"))
    runs = _shortened(per_parameter).groupBy("series_id", "g").agg(
        F.sort_array(F.collect_list(F.struct("chunk", "m"))).alias("run")
    )
    form = F.get(_grid_column(0), F.col("g"))
    state = F.struct(
        F.when(form == "level", F.col("first")).otherwise(F.col("line")).alias("l"),
        F.when(form == "level", F.lit(0.0)).otherwise(F.col("rise")).alias("b"),
        F.lit(0.0).alias("sse"),
    )

    def step(u, c):
        l, b, m = u["l"], u["b"], c["m"]
        squares = m[6] * l * l + m[7] * l * b + m[8] * l + m[9] * b * b + m[10] * b + m[11]
        return F.struct(
            (m[0] * l + m[1] * b + m[2]).alias("l"),
            (m[3] * l + m[4] * b + m[5]).alias("b"),
            (u["sse"] + squares).alias("sse"),
        )

    ends = runs.join(begin, "series_id").withColumn("end", F.aggregate("run", state, step))
    n, k = F.col("n").cast("double"), F.get(F.array(*[F.lit(float(v)) for v in _K]), F.col("g"))
    sse = F.col("end.sse")
    room = n - k - 1
    score = F.when(room > 0, n * F.log(F.greatest(sse, F.lit(1e-300)) / n) + 2 * k + 2 * k * (k + 1) / F.when(room > 0, room))
    level = form == "level"
    ets = F.struct(F.coalesce(score, F.lit(float("inf"))).alias("score"), "g")
    theta = F.when(level, F.struct(sse.alias("sse"), F.col("g").alias("g")))
    best = ends.groupBy("series_id").agg(
        F.max("n").alias("n"),
        F.min_by(F.struct("g", "end"), ets).alias("e"),
        F.min_by(F.struct("g", "end"), theta).alias("t"),
    )
    return best.select(
        "series_id", "n", F.col("e.g").alias("ets"), F.col("e.end.l").alias("ets_l"), F.col("e.end.b").alias("ets_b"),
        F.col("t.g").alias("theta"), F.col("t.end.l").alias("theta_l"),
    )


def smoothing_fits(clean: DataFrame, layout: Layout = DEFAULT) -> DataFrame:
    """Per series the ETS form and parameters with the lowest AICc, the Theta smoothing parameter with
    the lowest squared error, the final states, and the slope of the straight line for Theta."""
    begin = starts(clean)
    arrays = chunk_arrays(clean, "n", 0, layout)
    if layout.whole:
        ready = arrays.join(begin.drop("n"), "series_id").select("series_id", "n", "first", "line", "rise", "values")
        fits = ready.mapInArrow(
            _whole_series,
            "series_id string, n bigint, ets int, ets_l double, ets_b double, theta int, theta_l double",
        )
    else:
        summaries = arrays.select("series_id", "chunk", "values").mapInArrow(
            _chunk_summaries, "series_id string, chunk bigint, summary array<double>"
        )
        fits = _compose(cut_lineage(summaries), begin)
    lines = clean.groupBy("series_id").agg(F.coalesce(F.regr_slope("value", F.col("pos") + 1), F.lit(0.0)).alias("slope"))
    named = fits.join(lines, "series_id")
    return named.select(
        "series_id",
        "n",
        F.get(_grid_column(0), F.col("ets")).alias("ets_form"),
        *[F.get(_grid_column(i), F.col("ets")).alias(f"ets_{p}") for i, p in ((1, "alpha"), (2, "beta"), (3, "phi"))],
        "ets_l",
        "ets_b",
        F.get(_grid_column(1), F.col("theta")).alias("theta_alpha"),
        "theta_l",
        "slope",
    )


def smoothing_forecasts(fits: DataFrame, horizons: DataFrame) -> DataFrame:
    """(series_id, model_name, step, predicted) for ETS and Theta, steps 1..horizon, in closed form."""
    h, phi, alpha = F.col("step"), F.col("ets_phi"), F.col("theta_alpha")
    damped = phi * (1 - F.pow(phi, h)) / F.when(phi != 1, 1 - phi)
    reach = F.when(phi == 1, h.cast("double")).otherwise(damped)
    ets = F.col("ets_l") + F.col("ets_b") * reach
    drift = h - 1 + 1 / alpha - F.pow(1 - alpha, F.col("n")) / alpha
    theta = F.col("theta_l") + F.col("slope") / 2 * drift
    steps = fits.join(horizons, "series_id").withColumn("step", F.explode(F.sequence(F.lit(1), F.col("horizon"))))
    pairs = F.array(
        F.struct(F.lit("ETS").alias("model_name"), ets.alias("predicted")),
        F.struct(F.lit("Theta").alias("model_name"), theta.alias("predicted")),
    )
    return steps.select("series_id", "step", F.explode(pairs).alias("p")).select("series_id", "p.model_name", "step", "p.predicted")
