"""Least squares of the value on each series' own features, for all series at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.functions import batch as B
from panelcast.functions.frequency import FREQUENCIES, per_frequency
from panelcast.operators.features import SLOTS, WAVE_SLOTS
from panelcast.operators.layout import DEFAULT, Layout, add_totals, attach

# No frequency offers more than two calendar components, so two regressors are enough for them.
CALENDAR_PAIR = ("calendar_a", "calendar_b")
REGRESSORS = (
    *CALENDAR_PAIR, "time_index", "lag_1", "lag_season", "roll_mean", "roll_std", *WAVE_SLOTS, "holiday",
)
LEVEL_COLUMNS = ("lag_1", "lag_season", "roll_mean")
K = len(REGRESSORS) + 1  # with the constant


def design(features: DataFrame, layout: Layout = DEFAULT) -> DataFrame:
    """Rows that have a value and all features the series uses, with regressors x1.. and target y.

    Unused regressors are 0. Values are taken relative to the series mean and the time index to its
    middle, which changes the constant only and keeps the sums of products accurate.
    """
    complete = F.col("value").isNotNull()
    for s in SLOTS:
        complete = complete & (~F.col(f"use_{s}") | F.col(s).isNotNull())
    rows = add_totals(features, ["series_id"], {"mean": F.avg("value")}, "n_obs", layout).filter(complete)

    def calendar(i: int):
        picked = {n: F.col(f.calendar[i]) for n, f in FREQUENCIES.items() if len(f.calendar) > i}
        return per_frequency(picked)

    columns = {"calendar_a": calendar(0), "calendar_b": calendar(1)}
    columns["time_index"] = F.col("time_index") - (F.col("n_obs") - 1) / 2
    columns |= {c: F.col(c) - F.col("mean") for c in LEVEL_COLUMNS}
    columns |= {c: F.when(F.abs(c) > 1e-9, F.col(c)) for c in WAVE_SLOTS}
    xs = [F.coalesce(columns.get(c, F.col(c)).cast("double"), F.lit(0.0)) for c in REGRESSORS]
    return rows.select(
        "series_id", "frequency", "timestamp", "chunk", "n_obs", "mean",
        (F.col("value") - F.col("mean")).alias("y"), *[x.alias(f"x{i}") for i, x in enumerate(xs, 1)],
    )


def _fits(batches):
    for batch in batches:
        flat = np.stack([np.asarray(c, dtype=float) for c in batch.columns[1:]], axis=1)
        gram = np.zeros((len(flat), K + 1, K + 1))
        i, j = np.tril_indices(K + 1)
        gram[:, i, j] = gram[:, j, i] = flat
        lower = B.factor(gram)
        left = B.residual_squares(lower)
        total, rest = left[:, 1], left[:, K]
        with np.errstate(divide="ignore", invalid="ignore"):
            r2 = np.where(total > 0, np.clip(1 - rest / total, 0.0, 1.0), 1.0)
        used = (np.abs(lower[:, 1:K, 1:K].diagonal(axis1=1, axis2=2)) > 0).any(axis=1)
        r2 = np.where(used, r2, 0.0)
        yield pa.RecordBatch.from_arrays(
            [batch.column("series_id"), B.lists(list(B.coefficients(lower))), pa.array(r2)],
            names=["series_id", "beta", "r_squared"],
        )


def ols(rows: DataFrame) -> DataFrame:
    """beta (constant first, then REGRESSORS) and r_squared per series. The sums of products are plain
    aggregates, added up before the shuffle; only one small solve per series runs outside the JVM."""
    terms = [F.lit(1.0), *[F.col(f"x{i}") for i in range(1, K)], F.col("y")]
    sums = [F.sum(terms[i] * terms[j]).alias(f"g{i}_{j}") for i in range(K + 1) for j in range(i + 1)]
    return rows.groupBy("series_id").agg(*sums).mapInArrow(
        _fits, "series_id string, beta array<double>, r_squared double"
    )


def residuals(rows: DataFrame, fits: DataFrame, layout: Layout = DEFAULT) -> DataFrame:
    """The panel of residuals: same series and timestamps, value = what the features leave."""
    sizes = rows.groupBy("series_id").agg(F.max("n_obs").alias("n_obs"))
    fitted = attach(rows, fits.join(sizes, "series_id"), "n_obs", layout)
    beta = F.col("beta")
    explained = beta[0]
    for i in range(1, K):
        explained = explained + beta[i] * F.col(f"x{i}")
    return fitted.select("series_id", "timestamp", (F.col("y") - explained).alias("value"), "frequency")
