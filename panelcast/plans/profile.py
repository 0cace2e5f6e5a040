"""The complete profile of a panel, and what features change about it."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.operators import profile_basic as B
from panelcast.operators import season as S
from panelcast.operators import unit_root as U
from panelcast.operators.features import feature_catalog, slot_features, slot_plan
from panelcast.operators.layout import Layout, by_length, compact, keep, number_rows
from panelcast.operators.ols import design, ols, residuals
from panelcast.session import cut_lineage

PROFILE_SCHEMA = """series_id STRING, frequency STRING, n_obs BIGINT,
  start_timestamp TIMESTAMP_NTZ, end_timestamp TIMESTAMP_NTZ,
  missing STRUCT<expected_n: BIGINT, missing_count: BIGINT, missing_pct: DOUBLE>,
  seasonality STRUCT<detected: BOOLEAN, period: INT, strength: DOUBLE>,
  trend STRUCT<detected: BOOLEAN, slope: DOUBLE, strength: DOUBLE>,
  stationarity STRUCT<adf_statistic: DOUBLE, adf_pvalue: DOUBLE, adf_stationary: BOOLEAN,
    kpss_statistic: DOUBLE, kpss_pvalue: DOUBLE, kpss_stationary: BOOLEAN, stationary: BOOLEAN, error: STRING>,
  intermittency STRUCT<zero_pct: DOUBLE, adi: DOUBLE, cv2: DOUBLE, category: STRING, is_intermittent: BOOLEAN>,
  outliers STRUCT<count: BIGINT, pct: DOUBLE>"""


def _nested(df: DataFrame, name: str) -> DataFrame:
    fields = [c for c in df.columns if c not in ("series_id", "n")]
    return df.select("series_id", F.struct(*fields).alias(name))


def profile_numbered(
    panel: DataFrame,
    numbered: DataFrame,
    frequencies: Iterable[str] | None,
    layout: Layout,
    adf_lags: int | None = None,
) -> DataFrame:
    clean = compact(numbered, layout)
    parts = keep(S.decompose(clean, frequencies, layout=layout), layout)
    season = cut_lineage(S.best_period(clean, S.strengths(parts)))
    scored = S.robust_z(S.outlier_signal(clean, parts, season, layout), layout)
    head = numbered.groupBy("series_id", "frequency").agg(
        F.count(F.lit(1)).alias("n_obs"),
        F.min("timestamp").alias("start_timestamp"),
        F.max("timestamp").alias("end_timestamp"),
    )
    sections = {
        "missing": B.missing(panel),
        "seasonality": season,
        "trend": B.trend(clean),
        "stationarity": U.stationarity(clean, adf_lags, layout),
        "intermittency": B.intermittency(panel),
        "outliers": S.outlier_counts(scored, head),
    }
    out = head
    for name, part in sections.items():
        out = out.join(_nested(part, name), "series_id", "left")
    defaults = {  # a series without any value
        "seasonality": F.struct(F.lit(False).alias("detected"), F.lit(None).cast("int").alias("period"), F.lit(0.0).alias("strength")),
        "trend": F.struct(F.lit(False).alias("detected"), F.lit(0.0).alias("slope"), F.lit(0.0).alias("strength")),
    }
    return out.withColumns({name: F.coalesce(F.col(name), v) for name, v in defaults.items()}).withColumn(
        "stationarity",
        F.coalesce(
            F.col("stationarity"),
            F.struct(
                *[F.lit(None).cast("double").alias(n) for n in ("adf_statistic", "adf_pvalue")],
                F.lit(False).alias("adf_stationary"),
                *[F.lit(None).cast("double").alias(n) for n in ("kpss_statistic", "kpss_pvalue")],
                F.lit(False).alias("kpss_stationary"),
                F.lit(False).alias("stationary"),
                F.lit(U.TOO_SHORT).alias("error"),
            ),
        ),
    )


def profile_panel(
    panel: DataFrame, frequencies: Iterable[str] | None = None, adf_lags: int | None = None
) -> DataFrame:
    """One nested profile per series (PROFILE_SCHEMA). Naming the frequencies of the panel keeps the
    periods of the others out of the plan; `adf_lags` caps the lags the unit root test may use. The timestamps of the outliers are not a list in
    the profile, which could grow without bound, but a table: see operators.season.outlier_points."""

    def run(rows: DataFrame, layout: Layout) -> DataFrame:
        numbered = keep(number_rows(rows, layout), layout)
        return profile_numbered(rows, numbered, frequencies, layout, adf_lags)

    return by_length(panel, run)


def flags(profile: DataFrame) -> DataFrame:
    """The flat columns the catalog is built from."""
    return profile.select(
        "series_id",
        "frequency",
        F.col("trend.detected").alias("trend_detected"),
        F.col("seasonality.detected").alias("seasonality_detected"),
        F.col("seasonality.period").alias("seasonality_period"),
    )


def diagnostic_deltas(
    panel: DataFrame,
    profile: DataFrame,
    catalog: DataFrame | None = None,
    frequencies: Iterable[str] | None = None,
    adf_lags: int | None = None,
) -> DataFrame:
    """Per series: r_squared of its enabled features and the profile before and after taking them out.
    `catalog` defaults to the catalog of the profile, everything enabled."""
    plan = cut_lineage(slot_plan(catalog if catalog is not None else feature_catalog(flags(profile))))

    def run(rows: DataFrame, layout: Layout) -> DataFrame:
        numbered = keep(number_rows(rows, layout), layout)
        x = keep(design(slot_features(numbered, plan, frequencies, layout), layout), layout)
        fits = cut_lineage(ols(x))
        left = cut_lineage(residuals(x, fits, layout))
        after = profile_numbered(left, keep(number_rows(left, layout), layout), frequencies, layout, adf_lags)
        return fits.select("series_id", "r_squared").join(after, "series_id").select(
            "series_id",
            "r_squared",
            F.col("trend.strength").alias("trend_strength_after"),
            F.col("seasonality.strength").alias("seasonality_strength_after"),
            F.col("stationarity.stationary").alias("stationary_after"),
            F.col("outliers.count").alias("outlier_count_after"),
        )

    after = by_length(panel, run)
    before = profile.select(
        "series_id",
        F.col("trend.strength").alias("trend_strength_before"),
        F.col("seasonality.strength").alias("seasonality_strength_before"),
        F.col("stationarity.stationary").alias("stationary_before"),
        F.col("outliers.count").alias("outlier_count_before"),
    )
    out = after.join(before, "series_id")
    pairs = ("trend_strength", "seasonality_strength", "stationary", "outlier_count")
    return out.select(
        "series_id",
        "r_squared",
        *[f"{p}_{side}" for p in pairs for side in ("before", "after")],
        *[
            (F.col(f"{p}_after") < F.col(f"{p}_before")).alias(f"{p}_fell")
            for p in ("trend_strength", "seasonality_strength", "outlier_count")
        ],
    )
