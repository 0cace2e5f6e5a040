"""Complete profile, feature catalog, per-series features, regression and deltas."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.operators.features import feature_catalog, slot_features, slot_plan, toggle
from panelcast.operators.layout import by_length, compact, keep, number_rows
from panelcast.operators import profile_basic as B
from panelcast.operators import season as S
from panelcast.operators.ols import design, ols, residuals
from panelcast.plans.profile import diagnostic_deltas, profile_panel
from panelcast.queries.q_panel import rounded
from panelcast.queries.q_profile import TREND_SQL, best_sql, gram_sql
from panelcast.queries.registry import query
from panelcast.session import cut_lineage
from panelcast.sources.tables import panel, panel_sql


def catalog_flags(spark, sf, name, frequency):
    """The two detections the catalog needs, without the rest of the profile."""

    def run(rows, layout):
        clean = compact(keep(number_rows(rows, layout), layout), layout)
        season = S.best_period(clean, S.strengths(S.decompose(clean, [frequency], layout=layout)))
        return (
            season.join(B.trend(clean).select("series_id", F.col("detected").alias("trend_detected")), "series_id")
            .select(
                "series_id",
                F.lit(frequency).alias("frequency"),
                "trend_detected",
                F.col("detected").alias("seasonality_detected"),
                F.col("period").alias("seasonality_period"),
            )
        )

    return by_length(panel(spark, sf, name), run)


def flags_sql(name: str, *periods: int) -> str:
    return f"""SELECT t.series_id, t.detected AS trend, b.detected AS seasonal, b.period
    FROM ({TREND_SQL.format(panel=panel_sql(name))}) t JOIN ({best_sql(name, *periods)}) b ON b.series_id = t.series_id"""


def catalog_sql(name: str, calendar: list[str], window: int, *periods: int) -> str:
    parts = [f"SELECT series_id, {i} AS o, 'calendar_{c}' AS name, 'calendar' AS feature_type FROM f" for i, c in enumerate(calendar)]
    parts += [
        "SELECT series_id, 10, 'time_index', 'calendar' FROM f WHERE trend",
        "SELECT series_id, 11, 'lag_1', 'lag' FROM f",
        "SELECT series_id, 12, 'lag_' || period, 'lag' FROM f WHERE seasonal",
        f"SELECT series_id, 13, 'rolling_mean_' || coalesce(period, {window}), 'rolling_stat' FROM f",
        f"SELECT series_id, 14, 'rolling_std_' || coalesce(period, {window}), 'rolling_stat' FROM f",
    ]
    for k in (1, 2, 3):
        for i, w in enumerate(("sin", "cos")):
            parts.append(
                f"SELECT series_id, {13 + 2 * k + i}, 'fourier_{w}_{k}_p' || period, 'fourier' FROM f WHERE seasonal"
            )
    return f"""WITH f AS ({flags_sql(name, *periods)}), u AS ({" UNION ALL ".join(parts)})
  SELECT series_id, (row_number() OVER (PARTITION BY series_id ORDER BY o) - 1)::INT AS ord, name, feature_type FROM u"""


@query(
    "feature_catalog",
    f"SELECT *, true AS enabled FROM ({catalog_sql('part_monthly', ['month'], 12, 12)})",
)
def feature_catalog_query(spark, sf):
    return feature_catalog(catalog_flags(spark, sf, "part_monthly", "Monthly")).drop("params")


@query(
    "feature_catalog_hourly",
    f"SELECT *, true AS enabled FROM ({catalog_sql('events_hourly', ['hour_of_day', 'day_of_week'], 24, 24, 168)})",
)
def feature_catalog_hourly(spark, sf):
    return feature_catalog(catalog_flags(spark, sf, "events_hourly", "Hourly")).drop("params")


def configs(catalog):
    """A stored config for every third series: lag_1 off, and a name the catalog does not have."""
    picked = F.pmod(F.length("series_id") + F.ascii("series_id"), F.lit(3)) == 0
    return (
        catalog.select("series_id").distinct().filter(picked)
        .withColumn("config", F.create_map(F.lit("lag_1"), F.lit(False), F.lit("no_such_feature"), F.lit(True)))
    )


@query(
    "toggle_state",
    f"""SELECT series_id, ord, name, feature_type,
    NOT (name = 'lag_1' AND (length(series_id) + ascii(series_id)) % 3 = 0) AS enabled
  FROM ({catalog_sql('part_monthly', ['month'], 12, 12)})""",
)
def toggle_state(spark, sf):
    catalog = feature_catalog(catalog_flags(spark, sf, "part_monthly", "Monthly"))
    return toggle(catalog, configs(catalog)).drop("params")


@query(
    "features_per_series",
    f"""WITH f AS ({flags_sql("part_monthly", 12)}),
  p AS (SELECT series_id, timestamp, value, row_number() OVER (PARTITION BY series_id ORDER BY timestamp) - 1 AS t FROM ({panel_sql("part_monthly")})),
  h AS (SELECT *, lag(value, 1) OVER w AS l1, lag(value, 12) OVER w AS l12, count(value) OVER r AS c, avg(value) OVER r AS m, stddev_samp(value) OVER r AS s
    FROM p WINDOW w AS (PARTITION BY series_id ORDER BY t), r AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING))
  SELECT h.series_id, timestamp, month(timestamp)::DOUBLE AS month, CASE WHEN trend THEN t::DOUBLE END AS time_index,
    round_even(l1, 4) AS lag_1, CASE WHEN seasonal THEN round_even(l12, 4) END AS lag_season,
    CASE WHEN c = 12 THEN round_even(m, 4) END AS roll_mean, CASE WHEN c = 12 THEN round_even(s, 4) END AS roll_std,
    CASE WHEN seasonal THEN round_even(sin(2 * pi() * t / 12), 6) + 0.0 END AS fourier_sin_1,
    CASE WHEN seasonal THEN round_even(cos(2 * pi() * 3 * t / 12), 6) + 0.0 END AS fourier_cos_3
  FROM h JOIN f ON f.series_id = h.series_id""",
)
def features_per_series(spark, sf):
    plan = cut_lineage(slot_plan(feature_catalog(catalog_flags(spark, sf, "part_monthly", "Monthly"))))
    out = by_length(
        panel(spark, sf, "part_monthly"),
        lambda rows, layout: slot_features(number_rows(rows, layout), plan, ["Monthly"], layout),
    )
    cols = ["month", "time_index", "lag_1", "lag_season", "roll_mean", "roll_std", "fourier_sin_1", "fourier_cos_3"]
    out = out.select("series_id", "timestamp", *cols)
    return rounded(rounded(out, 4, *cols[2:6]), 6, *cols[6:])


def regression(spark, sf, name, frequency, plan):
    def run(rows, layout):
        x = keep(design(slot_features(number_rows(rows, layout), plan, [frequency], layout), layout), layout)
        fits = cut_lineage(ols(x))
        left = residuals(x, fits, layout)
        return left.join(fits.select("series_id", "r_squared"), "series_id")

    return by_length(panel(spark, sf, name), run)


def only_lag_1(catalog):
    return slot_plan(catalog.withColumn("enabled", F.col("name") == "lag_1"))


def lag_1_sql(name: str) -> str:
    """Residuals of the regression on the previous value."""
    return f"""WITH p AS (SELECT series_id, timestamp, value, frequency, lag(value) OVER (PARTITION BY series_id ORDER BY timestamp) AS x FROM ({panel_sql(name)})),
  f AS (SELECT series_id, regr_slope(value, x) AS b, regr_intercept(value, x) AS a, regr_r2(value, x) AS r2 FROM p WHERE x IS NOT NULL GROUP BY 1)
  SELECT p.series_id, timestamp, value - a - b * x AS value, frequency, r2 FROM p JOIN f ON f.series_id = p.series_id WHERE x IS NOT NULL"""


@query(
    "ols_residuals",
    f"""SELECT series_id, timestamp, round_even(value, 4) AS value, frequency, round_even(r2, 6) AS r_squared
  FROM ({lag_1_sql("user_daily")})""",
)
def ols_residuals(spark, sf):
    plan = cut_lineage(only_lag_1(feature_catalog(catalog_flags(spark, sf, "user_daily", "Daily"))))
    out = regression(spark, sf, "user_daily", "Daily", plan)
    return rounded(rounded(out, 4, "value"), 6, "r_squared")


def ols_monthly_sql(name: str) -> str:
    """Regression on all features of the catalog by normal equations: elimination in all rows, column by column; a column that
    the ones before it explain stays out."""
    waves = ", ".join(f"CASE WHEN seasonal THEN {f}(2 * pi() * {k} * t / 12) ELSE 0 END" for k in (1, 2, 3) for f in ("sin", "cos"))
    step = """CASE WHEN a[j * q + j + 1] <= 1e-11 * g[j + 1] THEN a ELSE [CASE WHEN k // q <> j THEN
      a[k + 1] - a[(k // q) * q + j + 1] * a[j * q + k % q + 1] / a[j * q + j + 1] ELSE a[k + 1] END FOR k IN range(q * q)] END"""
    return f"""(
  WITH RECURSIVE f AS ({flags_sql(name, 12)}),
  p AS (SELECT *, row_number() OVER w - 1 AS t, avg(value) OVER (PARTITION BY series_id) AS mu, count(*) OVER (PARTITION BY series_id) AS n
    FROM ({panel_sql(name)}) WINDOW w AS (PARTITION BY series_id ORDER BY timestamp)),
  h AS (SELECT *, lag(value, 1) OVER w AS l1, lag(value, 12) OVER w AS l12, count(value) OVER r AS c, avg(value) OVER r AS m, stddev_samp(value) OVER r AS s
    FROM p WINDOW w AS (PARTITION BY series_id ORDER BY t), r AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)),
  x AS (SELECT h.series_id, timestamp, frequency, 14::BIGINT AS q, [CASE WHEN abs(v) > 1e-9 THEN v::DOUBLE ELSE 0.0 END FOR v IN [1.0, month(timestamp), CASE WHEN trend THEN t - (n - 1) / 2 ELSE 0 END, l1 - mu,
      CASE WHEN seasonal THEN l12 - mu ELSE 0 END, m - mu, s, {waves}, value - mu]] AS x
    FROM h JOIN f ON f.series_id = h.series_id WHERE value IS NOT NULL AND l1 IS NOT NULL AND c = 12 AND (NOT seasonal OR l12 IS NOT NULL)),
  g AS (SELECT *, [a[i * q + i + 1] FOR i IN range(q)] AS g FROM ({gram_sql("x")})),
  steps AS (SELECT series_id, q, g, a, 0::BIGINT AS j, NULL::DOUBLE AS total FROM g
    UNION ALL SELECT series_id, q, g, b, j + 1, CASE WHEN j = 0 THEN b[q * q] ELSE total END FROM (SELECT *, {step} AS b FROM steps WHERE j < q - 1)),
  fit AS (SELECT series_id, total, a[q * q] AS rest, [CASE WHEN a[i * q + i + 1] > 1e-11 * g[i + 1] THEN a[i * q + q] / a[i * q + i + 1] ELSE 0 END FOR i IN range(q - 1)] AS beta
    FROM steps WHERE j = q - 1)
  SELECT x.series_id, timestamp, x[q] - list_sum([beta[i] * x[i] FOR i IN range(1, q)]) AS value, frequency,
    CASE WHEN len([b FOR b IN beta[2:] IF b <> 0]) = 0 THEN 0.0 WHEN total > 0 THEN greatest(0.0, least(1.0, 1 - rest / total)) ELSE 1.0 END AS r_squared
  FROM x JOIN fit ON fit.series_id = x.series_id)"""


@query(
    "ols_residuals_all_features",
    f"SELECT series_id, timestamp, round_even(value, 4) + 0.0 AS value, frequency, round_even(r_squared, 6) AS r_squared FROM {ols_monthly_sql('part_monthly')}",
)
def ols_residuals_all(spark, sf):
    plan = cut_lineage(slot_plan(feature_catalog(catalog_flags(spark, sf, "part_monthly", "Monthly"))))
    return rounded(rounded(regression(spark, sf, "part_monthly", "Monthly", plan), 4, "value"), 6, "r_squared")


@query("diagnostic_deltas")
def deltas(spark, sf):
    rows = cut_lineage(panel(spark, sf, "orders_daily"))
    return diagnostic_deltas(rows, cut_lineage(profile_panel(rows, ["Daily"])), frequencies=["Daily"])
