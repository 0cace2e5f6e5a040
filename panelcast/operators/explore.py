"""Listing, searching, comparing and charting series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.frequency import ANCHOR

MAX_COMPARED = 5
CHART_ROWS = 150


def series_list(index: DataFrame, profile: DataFrame) -> DataFrame:
    """Index rows with a summary of the profile, NULL for a series that has none, ordered by id."""
    summary = profile.select(
        "series_id",
        F.struct(
            F.col("trend.detected").alias("trend_detected"),
            F.col("seasonality.detected").alias("seasonality_detected"),
            F.col("seasonality.period").alias("seasonality_period"),
            F.col("stationarity.stationary").alias("stationary"),
            F.col("intermittency.category").alias("intermittency_category"),
        ).alias("profile_summary"),
    )
    return (
        index.select("series_id", "dataset", "frequency", "n_obs")
        .join(summary, "series_id", "left")
        .orderBy("series_id")
    )


def matches(
    search: str = "",
    frequency: str | None = None,
    seasonal_only: bool = False,
    trend_only: bool = False,
    category: str | None = None,
) -> Column:
    """Predicate over series_list; a series without a profile fails every test of the profile."""
    keep = F.lit(True)
    if search:
        keep = keep & F.contains(F.lower("series_id"), F.lit(search.lower()))
    if frequency:
        keep = keep & (F.col("frequency") == frequency)
    if seasonal_only:
        keep = keep & F.col("profile_summary.seasonality_detected")
    if trend_only:
        keep = keep & F.col("profile_summary.trend_detected")
    if category:
        keep = keep & (F.col("profile_summary.intermittency_category") == category)
    return F.coalesce(keep, F.lit(False))


def facets(listed: DataFrame) -> DataFrame:
    """The values the filters offer: facet, value."""
    category = F.col("profile_summary.intermittency_category")
    pairs = F.explode(
        F.array(
            F.struct(F.lit("frequency").alias("facet"), F.col("frequency").alias("value")),
            F.struct(F.lit("intermittency_category").alias("facet"), category.alias("value")),
        )
    )
    return (
        listed.select(pairs.alias("p")).select("p.*").filter(F.col("value").isNotNull()).distinct()
        .orderBy("facet", "value")
    )


def filter_counts(listed: DataFrame, keep: Column) -> DataFrame:
    return listed.agg(F.count_if(keep).alias("n_shown"), F.count(F.lit(1)).alias("n_total"))


def compare(panel: DataFrame, ids: Sequence[str]) -> DataFrame:
    """The rows of up to five different series."""
    if len(ids) > MAX_COMPARED:
        raise ValueError(f"at most {MAX_COMPARED} series can be compared")
    if len(set(ids)) != len(ids):
        raise ValueError("each series can be selected once")
    return panel.filter(F.col("series_id").isin(list(ids)))


def day_offset(ts: Column) -> Column:
    """Whole days since the anchor date, halves up."""
    seconds = F.timestamp_diff("SECOND", F.lit(ANCHOR).cast("timestamp_ntz"), ts)
    return F.floor(seconds / 86400 + 0.5).cast("int")


def from_day_offset(offset: Column) -> Column:
    return F.date_add(F.lit(ANCHOR).cast("date"), offset)


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def overlay(numbered: DataFrame, forecasts: DataFrame, best: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Chart rows of the selected series: the last 150 actual values and the best model's forecast.
    `numbered` has row positions and totals, so the last rows need no window."""
    actual = compare(numbered, ids).filter(F.col("pos") >= F.col("n_obs") - CHART_ROWS)
    chosen = best.filter(F.col("series_id").isin(list(ids))).withColumnRenamed("best_model", "model_name")
    predicted = forecasts.join(chosen, ["series_id", "model_name"])
    offset = day_offset(F.col("timestamp"))
    columns = [offset.alias("x"), from_day_offset(offset).alias("day"), iso(F.col("timestamp")).alias("at")]
    label = F.concat(F.col("series_id"), F.lit(" forecast ("), F.col("model_name"), F.lit(")"))
    return actual.select(
        "series_id", F.concat(F.col("series_id"), F.lit(" actual")).alias("label"), *columns, "value"
    ).unionByName(predicted.select("series_id", label.alias("label"), *columns, F.col("predicted").alias("value")))
