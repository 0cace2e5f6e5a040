"""Holdout, forecast metrics, best model, leaderboard and run status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bounds and share of the holdout.
MIN_HORIZON, MAX_HORIZON, HORIZON_SHARE = 7, 30, 0.1

MODELS = ("ARIMA", "ETS", "Theta", "GBT_leaf", "GBT_depth")
METRICS = ("mae", "rmse", "smape")


def horizon(n: Column) -> Column:
    """A tenth of the rows, halves to even, within 7..30."""
    tenth = F.rint(n * F.lit(HORIZON_SHARE)).cast("int")
    return F.greatest(F.lit(MIN_HORIZON), F.least(F.lit(MAX_HORIZON), tenth))


def holdout(numbered: DataFrame) -> DataFrame:
    """Add horizon, is_test (the last `horizon` rows) and step (1.. inside the test rows)."""
    first = F.col("n_obs") - F.col("horizon")
    return (
        numbered.withColumn("horizon", horizon(F.col("n_obs")))
        .withColumn("is_test", F.col("pos") >= first)
        .withColumn("step", F.when(F.col("is_test"), F.col("pos") - F.greatest(first, F.lit(0)) + 1).cast("int"))
    )


def metrics(pairs: DataFrame) -> DataFrame:
    """mae, rmse and smape per (series_id, model_name) of rows with actual and predicted; rows that lack
    one of the two do not count, and a pair of zeros adds 0 to smape."""
    error = F.col("actual") - F.col("predicted")
    size = F.abs("actual") + F.abs("predicted")
    share = F.when(error.isNull(), None).when(size != 0, 2 * F.abs(error) / size).otherwise(F.lit(0.0))
    return pairs.groupBy("series_id", "model_name").agg(
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (100 * F.avg(share)).alias("smape"),
    )


def best_model(scores: DataFrame, order: Sequence[str] = MODELS) -> DataFrame:
    """The model with the smallest smape per series; on a tie the earlier one in `order`. A model
    without a score never wins."""
    place = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("model_name"))
    ranked = F.when(F.col("smape").isNotNull(), F.struct("smape", place.alias("place"), "model_name"))
    return scores.groupBy("series_id").agg(F.min_by("model_name", ranked).alias("best_model"))


def upsert_scores(current: DataFrame, new: DataFrame) -> DataFrame:
    """One entry per (series_id, model_name): the metrics and job of the latest run (`run_seq`), and the
    time the entry was first written."""
    fields = F.struct(*METRICS, "job_id")
    return (
        current.unionByName(new)
        .groupBy("series_id", "model_name")
        .agg(
            F.max_by(fields, "run_seq").alias("latest"),
            F.min_by("computed_at", "run_seq").alias("computed_at"),
            F.max("run_seq").alias("run_seq"),
        )
        .select("series_id", "model_name", "latest.*", "computed_at", "run_seq")
    )


def leaderboard(entries: DataFrame) -> DataFrame:
    """Averages per model over the series it has a score for, best first (ordered before rounding)."""
    means = entries.groupBy("model_name").agg(
        *[F.avg(m).alias(f"avg_{m}") for m in METRICS], F.count("smape").alias("n_series")
    )
    return means.orderBy("avg_smape", "model_name").select(
        "model_name", *[F.bround(f"avg_{m}", 4).alias(f"avg_{m}") for m in METRICS], "n_series"
    )


def ranked_leaderboard(entries: DataFrame) -> DataFrame:
    """The leaderboard with its position; the window runs over one row per model."""
    means = entries.groupBy("model_name").agg(
        *[F.avg(m).alias(f"avg_{m}") for m in METRICS], F.count("smape").alias("n_series")
    )
    place = F.row_number().over(Window.orderBy("avg_smape", "model_name"))
    return means.select(
        place.alias("rank"),
        "model_name",
        *[F.bround(f"avg_{m}", 4).alias(f"avg_{m}") for m in METRICS],
        "n_series",
    )


def run_status(index: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row about a benchmark run: `outcomes` holds series_id and error (NULL when it went well).
    A failed series is a row with an error, it does not stop the others."""
    joined = index.select("series_id").join(
        outcomes.select("series_id", "error", F.lit(True).alias("seen")), "series_id", "left"
    )
    totals = joined.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("seen") & F.col("error").isNull()).alias("done"),
        F.count("error").alias("failed"),
        F.min("error").alias("error"),
    )
    total, done, failed = F.col("total"), F.col("done"), F.col("failed")
    status = F.when(failed > 0, "failed").when(done == total, "succeeded").otherwise("running")
    return totals.select(
        status.alias("status"),
        F.when(total > 0, F.bround(100 * done / F.when(total > 0, total), 2)).otherwise(F.lit(100.0)).alias("progress_pct"),
        F.when(status == "succeeded", F.concat(F.lit("leaderboard:"), total, F.lit("_series"))).alias("result_ref"),
        "error",
        "total",
        "done",
        "failed",
    )
