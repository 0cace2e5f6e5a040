"""Feature columns with one spec list for the whole panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.operators.features import FeatureSpec, apply_features, features_long
from panelcast.operators.layout import by_length, number_rows
from panelcast.queries.q_panel import rounded
from panelcast.queries.registry import query
from panelcast.sources.tables import panel, panel_sql

KEYS = ("series_id", "timestamp")


def build(spark, sf, name, specs, places=4):
    names = [s.name for s in specs if s.enabled]
    wide = apply_features(number_rows(panel(spark, sf, name)), specs)
    floats = [s.name for s in specs if s.enabled and s.feature_type in ("lag", "rolling_stat", "fourier")]
    return rounded(wide.select(*KEYS, *names), places, *floats) if floats else wide.select(*KEYS, *names)


def calendar_specs(*components):
    return [FeatureSpec(f"calendar_{c}", "calendar", component=c) for c in components]


@query(
    "feature_calendar",
    f"""SELECT series_id, timestamp, (isodow(timestamp) - 1)::INT AS calendar_day_of_week,
    (isodow(timestamp) >= 6)::INT AS calendar_is_weekend, month(timestamp)::INT AS calendar_month,
    quarter(timestamp)::INT AS calendar_quarter, hour(timestamp)::INT AS calendar_hour_of_day
  FROM ({panel_sql("events_hourly")})""",
)
def feature_calendar(spark, sf):
    specs = calendar_specs("day_of_week", "is_weekend", "month", "quarter", "hour_of_day")
    return build(spark, sf, "events_hourly", specs)


@query(
    "feature_time_index",
    f"""SELECT series_id, timestamp, row_number() OVER (PARTITION BY series_id ORDER BY timestamp) - 1 AS time_index
  FROM ({panel_sql("part_monthly")})""",
)
def feature_time_index(spark, sf):
    return build(spark, sf, "part_monthly", [FeatureSpec("time_index", "calendar", component="time_index")])


@query(
    "feature_lag",
    f"""SELECT series_id, timestamp, round_even(lag(value, 1) OVER w, 2) AS lag_1, round_even(lag(value, 7) OVER w, 2) AS lag_7,
    round_even(lag(value, 365) OVER w, 2) AS lag_365
  FROM ({panel_sql("orders_daily")}) WINDOW w AS (PARTITION BY series_id ORDER BY timestamp)""",
)
def feature_lag(spark, sf):
    return build(spark, sf, "orders_daily", [FeatureSpec(f"lag_{k}", "lag", k=k) for k in (1, 7, 365)], 2)


@query(
    "feature_rolling",
    f"""SELECT series_id, timestamp,
    CASE WHEN count(value) OVER w = 7 THEN round_even(avg(value) OVER w, 4) END AS rolling_mean_7,
    CASE WHEN count(value) OVER w = 7 THEN round_even(stddev_samp(value) OVER w, 4) END AS rolling_std_7
  FROM ({panel_sql("flag_daily")})
  WINDOW w AS (PARTITION BY series_id ORDER BY timestamp ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)""",
)
def feature_rolling(spark, sf):
    specs = [FeatureSpec(f"rolling_{s}_7", "rolling_stat", window=7, stat=s) for s in ("mean", "std")]
    return build(spark, sf, "flag_daily", specs)


@query(
    "feature_fourier",
    f"""WITH p AS (SELECT series_id, timestamp, row_number() OVER (PARTITION BY series_id ORDER BY timestamp) - 1 AS t
    FROM ({panel_sql("part_monthly")}))
  SELECT series_id, timestamp, """
    + ", ".join(
        f"round_even({f}(2 * pi() * {k} * t / 12), 6) + 0.0 AS fourier_{f}_{k}_p12" for k in (1, 2, 3) for f in ("sin", "cos")
    )
    + " FROM p",
)
def feature_fourier(spark, sf):
    specs = [
        FeatureSpec(f"fourier_{f}_{k}_p12", "fourier", order=k, period=12, func=f)
        for k in (1, 2, 3)
        for f in ("sin", "cos")
    ]
    return build(spark, sf, "part_monthly", specs, 6)


HOLIDAY_SQL = """
  (((month({d}) = 1 AND day({d}) = 1) OR (month({d}) = 6 AND day({d}) = 19 AND year({d}) >= 2021)
   OR (month({d}) = 7 AND day({d}) = 4) OR (month({d}) = 11 AND day({d}) = 11) OR (month({d}) = 12 AND day({d}) = 25)))"""


def us_holiday_sql(d: str) -> str:
    day_after, day_before = f"({d} + INTERVAL 1 DAY)", f"({d} - INTERVAL 1 DAY)"
    return f"""({HOLIDAY_SQL.format(d=d)}
    OR (isodow({d}) = 5 AND {HOLIDAY_SQL.format(d=day_after)}) OR (isodow({d}) = 1 AND {HOLIDAY_SQL.format(d=day_before)})
    OR (isodow({d}) = 1 AND ((month({d}) IN (1, 2) AND day({d}) BETWEEN 15 AND 21) OR (month({d}) = 5 AND day({d}) >= 25)
      OR (month({d}) = 9 AND day({d}) <= 7) OR (month({d}) = 10 AND day({d}) BETWEEN 8 AND 14)))
    OR (isodow({d}) = 4 AND month({d}) = 11 AND day({d}) BETWEEN 22 AND 28))"""


@query(
    "feature_holiday",
    f"""SELECT series_id, timestamp, {us_holiday_sql("timestamp")}::INT AS holiday_US FROM ({panel_sql("orders_daily")})""",
)
def feature_holiday(spark, sf):
    return build(spark, sf, "orders_daily", [FeatureSpec("holiday_US", "holiday", country="US")])


@query(
    "feature_holiday_other_country",
    f"""SELECT series_id, timestamp, (day(timestamp) IN (1, 15))::INT AS holiday_XX FROM ({panel_sql("orders_daily")})""",
)
def feature_holiday_other_country(spark, sf):
    """A country whose calendar is a table: the first and the fifteenth of every month there are orders in."""
    rows = panel(spark, sf, "orders_daily")
    days = rows.select(F.lit("XX").alias("country"), F.col("timestamp").cast("date").alias("date")).distinct()
    spec = FeatureSpec("holiday_XX", "holiday", country="XX")
    return by_length(
        rows,
        lambda part, layout: apply_features(
            number_rows(part, layout), [spec], days.filter(F.day("date").isin(1, 15)), layout
        ).select("series_id", "timestamp", "holiday_XX"),
    )


WIDE_SPECS = [
    *calendar_specs("month"),
    FeatureSpec("time_index", "calendar", component="time_index"),
    FeatureSpec("lag_1", "lag", k=1),
    FeatureSpec("lag_12", "lag", k=12, enabled=False),
    FeatureSpec("rolling_mean_12", "rolling_stat", window=12, stat="mean"),
    FeatureSpec("rolling_std_12", "rolling_stat", window=12, stat="std"),
    FeatureSpec("fourier_sin_1_p12", "fourier", order=1, period=12, func="sin"),
    FeatureSpec("holiday_US", "holiday", country="US"),
]
WIDE_SQL = f"""SELECT series_id, timestamp, month(timestamp)::INT AS calendar_month,
    row_number() OVER w - 1 AS time_index, round_even(lag(value, 1) OVER w, 4) AS lag_1,
    CASE WHEN count(value) OVER r = 12 THEN round_even(avg(value) OVER r, 4) END AS rolling_mean_12,
    CASE WHEN count(value) OVER r = 12 THEN round_even(stddev_samp(value) OVER r, 4) END AS rolling_std_12,
    round_even(sin(2 * pi() * (row_number() OVER w - 1) / 12), 4) + 0.0 AS fourier_sin_1_p12,
    {us_holiday_sql("timestamp")}::INT AS "holiday_US"
  FROM ({panel_sql("part_monthly")})
  WINDOW w AS (PARTITION BY series_id ORDER BY timestamp),
    r AS (PARTITION BY series_id ORDER BY timestamp ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)"""


@query("features_wide", WIDE_SQL)
def features_wide(spark, sf):
    return build(spark, sf, "part_monthly", WIDE_SPECS)


@query(
    "features_long",
    f"""WITH f AS (SELECT series_id, timestamp, lag_1, rolling_mean_12, calendar_month::DOUBLE AS calendar_month FROM ({WIDE_SQL}))
  SELECT series_id, timestamp, 'lag_1' AS name, lag_1 AS feature FROM f
  UNION ALL SELECT series_id, timestamp, 'rolling_mean_12', rolling_mean_12 FROM f
  UNION ALL SELECT series_id, timestamp, 'calendar_month', calendar_month FROM f""",
)
def features_long_query(spark, sf):
    names = ["lag_1", "rolling_mean_12", "calendar_month"]
    return features_long(build(spark, sf, "part_monthly", WIDE_SPECS), names)
