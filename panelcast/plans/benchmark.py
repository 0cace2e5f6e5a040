"""Backtests: forecasts of all models over a holdout, their scores, and the result per series."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.operators.arima import arima, arima_forecasts
from panelcast.operators.arima_likelihood import arima_likelihood
from panelcast.operators.features import feature_catalog, slot_features, slot_plan, toggle
from panelcast.operators.layout import Layout, by_length, compact, number_rows
from panelcast.operators.scores import MODELS, best_model, holdout, metrics, run_status, upsert_scores
from panelcast.operators.smoothing import smoothing_fits, smoothing_forecasts
from panelcast.operators.trees import TREES, training_table, tree_forecasts
from panelcast.plans.profile import diagnostic_deltas, flags
from panelcast.session import cut_lineage

STATISTICAL, TREE = "multi_step", "one_step"


def train_rows(panel: DataFrame, layout: Layout) -> tuple[DataFrame, DataFrame]:
    """The panel without its holdout, numbered and compacted, and the horizon per series."""
    split = holdout(number_rows(panel, layout))
    horizons = split.groupBy("series_id").agg(F.max("horizon").alias("horizon"))
    train = split.filter("NOT is_test").select("series_id", "timestamp", "value", "frequency")
    return compact(number_rows(train, layout), layout), horizons


def statistical_forecasts(panel: DataFrame, likelihood: bool = False) -> DataFrame:
    """ARIMA, ETS and Theta, several steps ahead of the training rows. They depend on the panel only,
    not on any feature switch, so they are computed once per panel. ARIMA is fitted by regression, or by exact likelihood."""

    def run(rows: DataFrame, layout: Layout) -> DataFrame:
        clean, horizons = train_rows(rows, layout)
        clean, horizons = cut_lineage(clean), cut_lineage(horizons)
        smooth = smoothing_forecasts(cut_lineage(smoothing_fits(clean, layout)), horizons)
        fit = arima_likelihood if likelihood else arima
        return smooth.unionByName(arima_forecasts(fit(clean, horizons, layout=layout)))

    return by_length(panel, run)


def feature_forecasts(
    panel: DataFrame,
    catalog: DataFrame,
    frequencies: Iterable[str] | None = None,
    presets: Iterable[str] | None = None,
    trees: int = TREES,
) -> DataFrame:
    """The tree models on the enabled features of each series."""
    plan = cut_lineage(slot_plan(catalog))

    def table(rows: DataFrame, layout: Layout) -> DataFrame:
        features = slot_features(number_rows(rows, layout), plan, frequencies, layout)
        return training_table(holdout(features), layout)

    extra = {} if presets is None else {"presets": presets}
    return tree_forecasts(by_length(panel, table), frequencies, trees=trees, **extra)


def with_actuals(panel: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Forecasts joined to the holdout rows they belong to."""
    test = holdout(number_rows(panel)).filter("is_test").select(
        "series_id", "step", "timestamp", F.col("value").alias("actual")
    )
    return test.join(forecasts, ["series_id", "step"])


@dataclass
class Backtest:
    forecasts: DataFrame  # series_id, model_name, forecast_kind, step, timestamp, actual, predicted
    scores: DataFrame  # series_id, model_name, forecast_kind, mae, rmse, smape
    best: DataFrame  # series_id, best_model
    config: DataFrame  # series_id, config: {feature name: enabled}


def kind_of() -> Column:
    return F.when(F.col("model_name").startswith("GBT"), TREE).otherwise(STATISTICAL)


def backtest(
    panel: DataFrame,
    profile: DataFrame,
    switches: DataFrame | None = None,
    frequencies: Iterable[str] | None = None,
    statistical: DataFrame | None = None,
    trees: int = TREES,
) -> Backtest:
    """Score every model on every series. `switches` holds `{name: bool}` configs per series;
    `statistical` takes forecasts already computed for this panel."""
    panel = cut_lineage(panel)
    catalog = feature_catalog(flags(profile))
    if switches is not None:
        catalog = toggle(catalog, switches)
    catalog = cut_lineage(catalog)
    if statistical is None:
        statistical = statistical_forecasts(panel)
    every = statistical.unionByName(feature_forecasts(panel, catalog, frequencies, trees=trees))
    rows = cut_lineage(with_actuals(panel, every)).withColumn("forecast_kind", kind_of())
    scores = metrics(rows).withColumn("forecast_kind", kind_of())
    pairs = F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "enabled"))))
    return Backtest(rows, scores, best_model(scores), catalog.groupBy("series_id").agg(pairs.alias("config")))


def refit(
    panel: DataFrame,
    profile: DataFrame,
    switches: DataFrame | None = None,
    frequencies: Iterable[str] | None = None,
    statistical: DataFrame | None = None,
    trees: int = TREES,
) -> DataFrame:
    """One row per series of the profile: scores of all models, the best one, forecasts beside the actual values, the feature config and
    the deltas. A series that lacks the score of a model has a row with the reason in `error`, and NULL for what it lacks."""
    test = backtest(panel, profile, switches, frequencies, statistical, trees)
    catalog = feature_catalog(flags(profile))
    if switches is not None:
        catalog = toggle(catalog, switches)
    fields = F.struct("model_name", "forecast_kind", "mae", "rmse", "smape")
    scores = test.scores.groupBy("series_id").agg(F.sort_array(F.collect_list(fields)).alias("metrics"))
    point = F.struct("step", "timestamp", "actual", "predicted")  # at most a holdout of 30 rows a model
    ahead = test.forecasts.groupBy("series_id", "model_name").agg(F.sort_array(F.collect_list(point)).alias("points"))
    ahead = ahead.groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct("model_name", "points"))).alias("forecasts"))
    deltas = diagnostic_deltas(panel, profile, catalog, frequencies)
    deltas = deltas.select("series_id", F.struct(*[c for c in deltas.columns if c != "series_id"]).alias("deltas"))
    out = outcomes(panel, profile, test.scores)
    for part in (scores, test.best, ahead, test.config, deltas):
        out = out.join(part, "series_id", "left")
    return out


def run_benchmark(
    panel: DataFrame,
    index: DataFrame,
    profile: DataFrame,
    job_id: str,
    run_seq: int,
    now: Column,
    current: DataFrame | None = None,
    frequencies: Iterable[str] | None = None,
    trees: int = TREES,
) -> tuple[DataFrame, DataFrame]:
    """Score every indexed series with the default catalog; returns the leaderboard entries (merged into
    `current`) and the run's status row. A series that lacks the score of a model is a failure with a reason, the others
    are not affected by it."""
    scores = cut_lineage(backtest(panel, profile, frequencies=frequencies, trees=trees).scores)
    entries = scores.drop("forecast_kind").withColumns(
        {"job_id": F.lit(job_id), "run_seq": F.lit(run_seq), "computed_at": now}
    )
    return entries if current is None else upsert_scores(current, entries), run_status(index, outcomes(panel, index, scores))


def outcomes(panel: DataFrame, index: DataFrame, scores: DataFrame) -> DataFrame:
    """series_id and error of every indexed series: NULL if every model has a score, else what was in the way."""
    split = holdout(number_rows(panel))
    rows = split.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~F.col("is_test")).alias("train"),
        F.count(F.when(~F.col("is_test"), F.col("value"))).alias("known"),
        F.count(F.when(F.col("is_test"), F.col("value"))).alias("actual"),
    )
    scored = scores.filter("smape IS NOT NULL").groupBy("series_id").agg(F.collect_set("model_name").alias("models"))
    absent = F.array_except(F.array(*[F.lit(m) for m in MODELS]), F.coalesce("models", F.array().cast("array<string>")))
    error = (
        F.when(F.size(absent) == 0, None)
        .when(F.col("rows").isNull(), "no rows")
        .when(F.col("train") == 0, "too few rows to hold out and train")
        .when(F.col("known") == 0, "no values before the holdout")
        .when(F.col("actual") == 0, "no values in the holdout")
        .otherwise(F.concat(F.lit("no score of "), F.array_join(F.sort_array(absent), ", ")))
    )
    return index.select("series_id").join(rows, "series_id", "left").join(scored, "series_id", "left").select("series_id", error.alias("error"))
