"""Forecast models and complete backtests."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.operators import arima as A
from panelcast.operators import arima_likelihood as L
from panelcast.operators import smoothing as M
from panelcast.operators.features import feature_catalog
from panelcast.operators.layout import DEFAULT, Layout, by_length
from panelcast.plans import benchmark as K
from panelcast.plans.profile import profile_panel
from panelcast.queries.q_catalog import catalog_flags, configs
from panelcast.queries.q_panel import rounded
from panelcast.queries.q_scores import split_sql
from panelcast.queries.registry import query
from panelcast.session import cut_lineage
from panelcast.sources.tables import panel


def smooth(spark, sf, name, layout=DEFAULT):
    def run(rows, layout):
        clean, horizons = K.train_rows(rows, layout)
        return M.smoothing_forecasts(cut_lineage(M.smoothing_fits(cut_lineage(clean), layout)), horizons)

    return by_length(panel(spark, sf, name), run, layout)


def train_sql(name: str) -> str:
    return f"""s AS ({split_sql(name)}),
  y AS (SELECT series_id, value, row_number() OVER (PARTITION BY series_id ORDER BY pos) AS t, count(*) OVER (PARTITION BY series_id) AS n
    FROM s WHERE NOT is_test AND value IS NOT NULL),
  h AS (SELECT series_id, any_value(h) AS h FROM s GROUP BY 1)"""


def grid_sql() -> str:
    rows = ", ".join(f"({i}, '{f}', {a}::DOUBLE, {b}::DOUBLE, {p}::DOUBLE)" for i, (f, a, b, p) in enumerate(M.GRID))
    return f"g AS (SELECT * FROM (VALUES {rows}) v(i, form, alpha, beta, phi))"


def smooth_sql(name: str) -> str:
    """The recursion row by row for every parameter, then the choice and the closed-form forecasts."""
    return f"""WITH RECURSIVE {train_sql(name)}, {grid_sql()},
  b0 AS (SELECT series_id, any_value(n) AS n, arg_min(value, t) AS f, regr_intercept(value, t) FILTER (WHERE t <= 10) AS a, regr_slope(value, t) FILTER (WHERE t <= 10) AS r FROM y GROUP BY 1),
  r AS (
    SELECT series_id, n, i, form, alpha, beta, phi, 0::BIGINT AS t, CASE WHEN form = 'level' THEN f ELSE coalesce(a, f) END AS l,
      CASE WHEN form = 'level' THEN 0.0::DOUBLE ELSE coalesce(r, 0.0) END AS b, 0.0::DOUBLE AS sse FROM b0, g
    UNION ALL
    SELECT r.series_id, r.n, i, form, alpha, beta, phi, r.t + 1, l + phi * b + alpha * (value - l - phi * b),
      phi * b + alpha * beta * (value - l - phi * b), sse + (value - l - phi * b)**2
    FROM r JOIN y ON y.series_id = r.series_id AND y.t = r.t + 1),
  e AS (SELECT *, CASE form WHEN 'level' THEN 3 WHEN 'trend' THEN 5 ELSE 6 END AS k FROM r WHERE t = n),
  c AS (SELECT *, CASE WHEN n - k - 1 > 0 THEN n * ln(greatest(sse, 1e-300) / n) + 2 * k + 2 * k * (k + 1) / (n - k - 1) END AS score FROM e),
  ets AS (SELECT series_id, arg_min(i, (coalesce(score, 'inf'::DOUBLE), i)) AS i FROM c GROUP BY 1),
  theta AS (SELECT series_id, arg_min(i, (sse, i)) AS i FROM c WHERE form = 'level' GROUP BY 1),
  line AS (SELECT series_id, regr_slope(value, t) AS slope FROM y GROUP BY 1),
  steps AS (SELECT series_id, unnest(generate_series(1, h)) AS step FROM h)
  SELECT c.series_id, 'ETS' AS model_name, step::INT AS step, round_even(l + b * CASE WHEN phi = 1 THEN step WHEN phi = 0 THEN 0 ELSE phi * (1 - phi**step) / (1 - phi) END, 4) AS predicted
  FROM ets JOIN c ON c.series_id = ets.series_id AND c.i = ets.i JOIN steps ON steps.series_id = c.series_id
  UNION ALL
  SELECT c.series_id, 'Theta', step::INT, round_even(l + slope / 2 * (step - 1 + 1 / alpha - (1 - alpha)**n / alpha), 4)
  FROM theta JOIN c ON c.series_id = theta.series_id AND c.i = theta.i JOIN line ON line.series_id = c.series_id JOIN steps ON steps.series_id = c.series_id"""


@query("forecast_ets", f"SELECT * FROM ({smooth_sql('user_daily')}) WHERE model_name = 'ETS'")
def forecast_ets(spark, sf):
    return rounded(smooth(spark, sf, "user_daily").filter("model_name = 'ETS'"), 4, "predicted")


@query("forecast_theta", f"SELECT * FROM ({smooth_sql('user_daily')}) WHERE model_name = 'Theta'")
def forecast_theta(spark, sf):
    return rounded(smooth(spark, sf, "user_daily").filter("model_name = 'Theta'"), 4, "predicted")


CUT = Layout(chunk_rows=512, block_steps=300)  # the layout of series too long for one task, on shorter ones


@query("forecast_smoothing_cut", smooth_sql("orders_daily"))
def forecast_smoothing_cut(spark, sf):
    return rounded(smooth(spark, sf, "orders_daily", CUT), 4, "predicted")


def arima_fits(spark, sf, name, **limits):
    def run(rows, layout):
        clean, horizons = K.train_rows(rows, layout)
        return A.arima(cut_lineage(clean), horizons, layout=layout, **limits)

    return by_length(panel(spark, sf, name), run)


@query(
    "forecast_arima_ar1",
    f"""WITH RECURSIVE {train_sql("part_monthly")},
  x AS (SELECT series_id, n, t, value, lag(value) OVER (PARTITION BY series_id ORDER BY t) AS v FROM y),
  f AS (SELECT series_id, any_value(n) - 1 AS m, avg(value) AS mean, arg_max(value, t) AS last FROM x GROUP BY 1),
  o AS (SELECT series_id, regr_slope(value, v) AS b, regr_intercept(value, v) AS a, regr_syy(value, v) AS s0, regr_avgy(value, v) AS c0,
      regr_syy(value, v) - regr_slope(value, v)**2 * regr_sxx(value, v) AS s1 FROM x WHERE v IS NOT NULL GROUP BY 1),
  q AS (SELECT f.series_id, last, mean, c0, a, b, CASE WHEN m - 3 > 0 THEN m * ln(greatest(s0, 1e-300) / m) + 4 + 12 / (m - 3) END AS z0,
      CASE WHEN m - 4 > 0 AND abs(b) < 1 THEN m * ln(greatest(s1, 1e-300) / m) + 6 + 24 / (m - 4) END AS z1 FROM f LEFT JOIN o ON o.series_id = f.series_id),
  k AS (SELECT series_id, last, CASE WHEN z1 < z0 THEN 1 ELSE 0 END AS p, CASE WHEN z1 < z0 THEN a WHEN z0 IS NULL THEN mean ELSE c0 END AS a, CASE WHEN z1 < z0 THEN b ELSE 0 END AS b FROM q),
  r AS (SELECT k.series_id, p, a, b, h, 1 AS step, a + b * last AS v FROM k JOIN h ON h.series_id = k.series_id
    UNION ALL SELECT series_id, p, a, b, h, step + 1, a + b * v FROM r WHERE step < h)
  SELECT series_id, p::INT AS p, step::INT AS step, round_even(v, 4) AS predicted FROM r""",
)
def forecast_arima_ar1(spark, sf):
    fits = arima_fits(spark, sf, "part_monthly", max_p=1, max_q=0, max_d=0)
    steps = fits.select("series_id", "p", F.posexplode("predicted").alias("i", "predicted"))
    return rounded(steps.select("series_id", "p", (F.col("i") + 1).alias("step"), "predicted"), 4, "predicted")


@query("forecast_arima")
def forecast_arima(spark, sf):
    return A.arima_forecasts(arima_fits(spark, sf, "part_monthly"))


@query("forecast_arima_likelihood")
def forecast_arima_likelihood(spark, sf):
    """Orders of up to (2, 2, 2) and forecasts of every user series by exact likelihood."""

    def run(rows, layout):
        clean, horizons = K.train_rows(rows, layout)
        return L.arima_likelihood(cut_lineage(clean), horizons, max_p=2, max_q=2, layout=layout)

    fits = by_length(panel(spark, sf, "user_daily"), run)
    steps = fits.select("series_id", "d", "p", "q", F.posexplode("predicted").alias("i", "predicted"))
    return steps.select("series_id", "d", "p", "q", (F.col("i") + 1).alias("step"), "predicted")


def trees(spark, sf, preset):
    catalog = feature_catalog(catalog_flags(spark, sf, "user_daily", "Daily"))
    return K.feature_forecasts(panel(spark, sf, "user_daily"), catalog, ["Daily"], [preset])


@query("forecast_gbt_leaf")
def forecast_gbt_leaf(spark, sf):
    return trees(spark, sf, "GBT_leaf")


@query("forecast_gbt_depth")
def forecast_gbt_depth(spark, sf):
    return trees(spark, sf, "GBT_depth")


def refit_rows(out):
    """The rows of a refit (a written table), told apart by `part`: `best`, error and deltas of a series, `score` of a model, `forecast` of a
    model and step, `config` of a feature."""
    best = out.select("series_id", F.lit("best").alias("part"), F.col("best_model").alias("model_name"), "error", "deltas.*")
    score = out.select("series_id", F.lit("score").alias("part"), F.inline("metrics"))
    model = out.select("series_id", F.lit("forecast").alias("part"), F.inline("forecasts"))
    ahead = model.select("series_id", "part", "model_name", F.inline("points"))
    config = out.select("series_id", F.lit("config").alias("part"), F.explode("config").alias("feature", "enabled"))
    rows = best
    for more in (score, ahead, config):
        rows = rows.unionByName(more, allowMissingColumns=True)
    return rows


@query("refit")
def refit(spark, sf):
    """Every daily event series with lag_1 switched off for some: best model and deltas, and the scores, forecasts with actuals and
    config of all models, in rows (`refit_rows`)."""
    rows = cut_lineage(panel(spark, sf, "events_daily"))
    profile = cut_lineage(profile_panel(rows, ["Daily"]))
    switches = configs(profile.select("series_id"))
    out = K.refit(rows, profile, switches, ["Daily"])
    return refit_rows(cut_lineage(out))


@query("benchmark_scores")
def benchmark_scores(spark, sf):
    """Every user series against every model with the default catalog."""
    rows = cut_lineage(panel(spark, sf, "user_daily"))
    profile = cut_lineage(profile_panel(rows, ["Daily"]))
    return K.backtest(rows, profile, frequencies=["Daily"]).scores
