"""The statistical profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.operators import profile_basic as B
from panelcast.operators import season as S
from panelcast.operators import unit_root as U
from panelcast.operators.layout import DEFAULT, Layout, by_length, compact, keep, number_rows
from panelcast.queries.q_panel import rounded
from panelcast.queries.registry import query
from panelcast.sources import panel as P
from panelcast.session import cut_lineage
from panelcast.sources.tables import panel, panel_sql

MISSING_SQL = """
  SELECT series_id, expected_n, expected_n - present AS missing_count,
    round_even((expected_n - present) / expected_n, 6) AS missing_pct FROM (
    SELECT series_id, {grid} AS expected_n, count(value) AS present FROM ({panel}) GROUP BY 1)"""


@query("profile_missing", MISSING_SQL.format(
    grid="date_diff('hour', min(timestamp), max(timestamp)) + 1", panel=panel_sql("events_hourly")))
def profile_missing(spark, sf):
    return rounded(B.missing(panel(spark, sf, "events_hourly")), 6, "missing_pct")


@query("profile_missing_monthly", MISSING_SQL.format(
    grid="date_diff('month', min(timestamp), max(timestamp)) + 1", panel=panel_sql("part_monthly")))
def profile_missing_monthly(spark, sf):
    return rounded(B.missing(panel(spark, sf, "part_monthly")), 6, "missing_pct")


# sales panels: a month without sales is zero demand
ZERO_FILLED_SQL = f"""
  SELECT g.series_id, g.timestamp, coalesce(p.value, 0) AS value FROM
    (SELECT series_id, unnest(generate_series(min(timestamp), max(timestamp), INTERVAL 1 MONTH)) AS timestamp
     FROM ({panel_sql("part_monthly")}) GROUP BY 1) g
  LEFT JOIN ({panel_sql("part_monthly")}) p ON p.series_id = g.series_id AND p.timestamp = g.timestamp"""

INTERMITTENCY_SQL = """
  WITH s AS (SELECT series_id, count(value) AS n, count(CASE WHEN value <> 0 THEN 1 END) AS k,
      stddev_pop(CASE WHEN value <> 0 THEN value END) AS sd, avg(CASE WHEN value <> 0 THEN value END) AS m
    FROM ({rows}) GROUP BY 1),
  c AS (SELECT series_id, (n - k) / n AS zero_pct, CASE WHEN k > 0 THEN n / k ELSE 'inf'::DOUBLE END AS adi,
      CASE WHEN k > 0 AND m <> 0 THEN (sd / m) * (sd / m) ELSE 0.0 END AS cv2 FROM s),
  t AS (SELECT *, CASE WHEN adi < 1.32 AND cv2 < 0.49 THEN 'smooth' WHEN cv2 < 0.49 THEN 'intermittent'
      WHEN adi < 1.32 THEN 'erratic' ELSE 'lumpy' END AS category FROM c)
  SELECT series_id, round_even(zero_pct, 10) AS zero_pct, round_even(adi, 10) AS adi, cv2::FLOAT::DOUBLE AS cv2,
    category, category IN ('intermittent', 'lumpy') AS is_intermittent FROM t"""


def demand_columns(rows):
    """Integer demand makes cv2 a short decimal that ties when rounded; single precision does not."""
    out = rounded(B.intermittency(rows), 10, "zero_pct", "adi")
    return out.withColumn("cv2", F.col("cv2").cast("float").cast("double"))


@query("profile_intermittency", INTERMITTENCY_SQL.format(rows=ZERO_FILLED_SQL))
def profile_intermittency(spark, sf):
    filled = P.zero_filled(panel(spark, sf, "part_monthly"))
    return demand_columns(filled)


T_SQL = "[" + ", ".join(str(t) for t in B.T_975) + "]"
TREND_SQL = f"""
  WITH p AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY timestamp) - 1 AS pos FROM ({{panel}}) WHERE value IS NOT NULL),
  f AS (SELECT series_id, count(*) AS n, regr_slope(value, pos) AS slope, least(power(corr(value, pos), 2), 1.0) AS r2,
      min(value) = max(value) AS flat FROM p GROUP BY 1),
  c AS (SELECT *, CASE WHEN n - 2 <= 30 THEN ({T_SQL})[n - 2] ELSE z + (z**3 + z) / (4 * (n - 2))
      + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * (n - 2)**2) + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / (384 * (n - 2)**3) END AS crit
    FROM (SELECT *, 1.959963985::DOUBLE AS z FROM f))
  SELECT series_id, CASE WHEN n < 2 OR flat THEN false WHEN n = 2 OR r2 >= 1 THEN true
      ELSE sqrt(r2) * sqrt((n - 2) / (1 - r2)) > crit END AS detected,
    CASE WHEN n < 2 OR flat THEN 0 ELSE round_even(slope, 4) END AS slope,
    CASE WHEN n < 2 OR flat THEN 0 ELSE round_even(r2, 6) END AS strength FROM c"""


@query("profile_trend", TREND_SQL.format(panel=panel_sql("part_monthly")))
def profile_trend(spark, sf):
    clean = compact(number_rows(panel(spark, sf, "part_monthly")))
    return B.trend(clean).select(
        "series_id", "detected", F.bround("slope", 4).alias("slope"), F.bround("strength", 6).alias("strength")
    )


FLAT_SQL = f"""
  WITH p AS ({panel_sql("events_hourly")}),
  m AS ({MISSING_SQL.format(grid="date_diff('hour', min(timestamp), max(timestamp)) + 1", panel=panel_sql("events_hourly"))}),
  i AS ({INTERMITTENCY_SQL.format(rows=panel_sql("events_hourly"))}),
  t AS ({TREND_SQL.format(panel=panel_sql("events_hourly"))}),
  n AS (SELECT series_id, count(*) AS n_obs, min(timestamp) AS start_timestamp, max(timestamp) AS end_timestamp FROM p GROUP BY 1)
  SELECT n.*, expected_n, missing_count, missing_pct, zero_pct, adi, cv2, category, is_intermittent,
    detected AS trend_detected, slope AS trend_slope, strength AS trend_strength
  FROM n JOIN m USING (series_id) JOIN i USING (series_id) JOIN t USING (series_id)"""


@query("profile_flat", FLAT_SQL)
def profile_flat(spark, sf):
    rows = panel(spark, sf, "events_hourly")
    base = P.series_index(rows, "", "").select("series_id", "n_obs", "start_timestamp", "end_timestamp")
    slope = B.trend(compact(number_rows(rows))).select(
        "series_id",
        F.col("detected").alias("trend_detected"),
        F.bround("slope", 4).alias("trend_slope"),
        F.bround("strength", 6).alias("trend_strength"),
    )
    gaps = rounded(B.missing(rows), 6, "missing_pct")
    demand = demand_columns(rows)
    return base.join(gaps, "series_id").join(demand, "series_id").join(slope, "series_id")


def season_sql(name: str, period: int) -> str:
    """Rows with season and residual at one period, straight from the definition."""
    h = period // 2
    inner = (
        f"(sum(value) OVER f - 0.5 * first_value(value) OVER f - 0.5 * last_value(value) OVER f) / {period}"
        if period % 2 == 0
        else "avg(value) OVER f"
    )
    whole = "OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    return f"""(
  WITH c AS (SELECT series_id, timestamp, value, row_number() OVER (PARTITION BY series_id ORDER BY timestamp) - 1 AS pos,
      count(*) OVER (PARTITION BY series_id) AS n FROM ({panel_sql(name)}) WHERE value IS NOT NULL),
  a AS (SELECT *, CASE WHEN pos BETWEEN {h} AND n - 1 - {h} THEN {inner} END AS t FROM c WHERE n >= {4 * period}
    WINDOW f AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING)),
  d AS (SELECT *, value - CASE WHEN pos < {h} THEN first_value(t IGNORE NULLS) {whole}
      WHEN pos > n - 1 - {h} THEN last_value(t IGNORE NULLS) {whole} ELSE t END AS detrended FROM a),
  m AS (SELECT series_id, pos % {period} AS phase, quantile_cont(detrended, 0.5) AS med FROM d GROUP BY 1, 2),
  s AS (SELECT series_id, phase, med - avg(med) OVER (PARTITION BY series_id) AS season FROM m)
  SELECT d.series_id, timestamp, value, pos, n, {period} AS period, detrended, season, detrended - season AS resid
  FROM d JOIN s ON s.series_id = d.series_id AND s.phase = d.pos % {period})"""


def strength_sql(name: str, *periods: int) -> str:
    parts = " UNION ALL ".join(f"SELECT * FROM {season_sql(name, p)}" for p in periods)
    return f"""SELECT series_id, period,
      CASE WHEN var_pop(detrended) > 0 THEN greatest(0.0, 1 - var_pop(resid) / var_pop(detrended)) ELSE 0.0 END AS ss,
      CASE WHEN var_pop(value - season) > 0 THEN greatest(0.0, 1 - var_pop(resid) / var_pop(value - season)) ELSE 0.0 END AS ts
    FROM ({parts}) GROUP BY 1, 2"""


def best_sql(name: str, *periods: int) -> str:
    return f"""SELECT i.series_id, coalesce(s >= 0.3, false) AS detected, CASE WHEN s >= 0.3 THEN p END AS period,
      coalesce(round_even(s, 4), 0.0) AS strength
    FROM (SELECT DISTINCT series_id FROM ({panel_sql(name)})) i
    LEFT JOIN (SELECT series_id, max(ss) AS s, arg_max(period, (ss, -period)) AS p FROM ({strength_sql(name, *periods)}) GROUP BY 1) b
    ON b.series_id = i.series_id"""


def outlier_sql(name: str, *periods: int) -> str:
    parts = " UNION ALL ".join(f"SELECT * FROM {season_sql(name, p)}" for p in periods)
    return f"""
  WITH parts AS ({parts}), best AS ({best_sql(name, *periods)}),
  sig AS (SELECT p.series_id, p.timestamp, p.value AS signal FROM ({panel_sql(name)}) p JOIN best b ON b.series_id = p.series_id AND b.period IS NULL
    UNION ALL SELECT p.series_id, p.timestamp, p.resid FROM parts p JOIN best b ON b.series_id = p.series_id AND b.period = p.period),
  med AS (SELECT series_id, quantile_cont(signal, 0.5) AS m FROM sig GROUP BY 1),
  mad AS (SELECT s.series_id, any_value(m) AS m, quantile_cont(abs(signal - m), 0.5) AS d FROM sig s JOIN med USING (series_id) GROUP BY 1),
  z AS (SELECT s.*, CASE WHEN d > 0 THEN 0.6745 * (signal - m) / d ELSE 0.0 END AS z FROM sig s JOIN mad USING (series_id))"""


CUT = Layout(chunk_rows=512, block_steps=300, group_rows=200)  # the layout of series too long for one task, on shorter ones


def seasons(clean, frequency, layout):
    """Decomposition and best period."""
    parts = keep(S.decompose(clean, [frequency], layout=layout), layout)
    return parts, cut_lineage(S.best_period(clean, S.strengths(parts)))


@query(
    "seasonal_strength",
    f"""SELECT series_id, period, round_even(ss, 6) AS seasonal_strength, round_even(ts, 6) AS trend_strength
  FROM ({strength_sql("orders_daily", 7, 30, 365)})""",
)
def seasonal_strength(spark, sf):
    def run(rows, layout):
        return S.strengths(S.decompose(compact(number_rows(rows, layout), layout), ["Daily"], layout=layout))

    out = by_length(panel(spark, sf, "orders_daily"), run)
    return rounded(out, 6, "seasonal_strength", "trend_strength")


def best_periods(rows, frequency):
    def run(part, layout):
        clean = compact(number_rows(part, layout), layout)
        return S.best_period(clean, S.strengths(S.decompose(clean, [frequency], layout=layout)))

    return by_length(rows, run).drop("n")


@query("profile_seasonality", best_sql("events_hourly", 24, 168))
def profile_seasonality(spark, sf):
    return best_periods(panel(spark, sf, "events_hourly"), "Hourly")


@query("profile_seasonality_monthly", best_sql("part_monthly", 12))
def profile_seasonality_monthly(spark, sf):
    return best_periods(panel(spark, sf, "part_monthly"), "Monthly")


def scored(numbered, frequency, layout):
    clean = compact(numbered, layout)
    parts, season = seasons(clean, frequency, layout)
    return S.robust_z(S.outlier_signal(clean, parts, season, layout), layout)


@query(
    "profile_outliers",
    outlier_sql("part_monthly", 12)
    + f""" SELECT n.series_id, coalesce(k, 0) AS count, round_even(coalesce(k, 0) / n, 8) AS pct
  FROM (SELECT series_id, count(*) AS n FROM ({panel_sql("part_monthly")}) GROUP BY 1) n
  LEFT JOIN (SELECT series_id, count(*) FILTER (WHERE abs(z) > 3.5) AS k FROM z GROUP BY 1) k ON k.series_id = n.series_id""",
)
def profile_outliers(spark, sf):
    def run(rows, layout):
        numbered = number_rows(rows, layout)
        n_obs = numbered.groupBy("series_id").agg(F.max("n_obs").alias("n_obs"))
        return S.outlier_counts(scored(numbered, "Monthly", layout), n_obs)

    return rounded(by_length(panel(spark, sf, "part_monthly"), run), 8, "pct")


@query(
    "outlier_points",
    outlier_sql("flag_daily", 7, 30, 365)
    + " SELECT series_id, timestamp, round_even(signal, 4) AS signal, round_even(z, 9) AS z FROM z WHERE abs(z) > 3.5",
)
def outlier_points(spark, sf):
    def run(rows, layout):
        return S.outlier_points(scored(number_rows(rows, layout), "Daily", layout))

    return rounded(rounded(by_length(panel(spark, sf, "flag_daily"), run), 4, "signal"), 9, "z")


def kpss_sql(name: str) -> str:
    """KPSS from its definition: autocovariances by a join on the lag."""
    return f"""(
  WITH c AS (SELECT series_id, value, row_number() OVER (PARTITION BY series_id ORDER BY timestamp) - 1 AS pos,
      count(*) OVER (PARTITION BY series_id) AS n, avg(value) OVER (PARTITION BY series_id) AS m FROM ({panel_sql(name)}) WHERE value IS NOT NULL),
  e AS (SELECT series_id, pos, n, value - m AS e, sum(value - m) OVER (PARTITION BY series_id ORDER BY pos) AS s FROM c),
  eta AS (SELECT series_id, any_value(n) AS n, sum(s * s) / any_value(n)**2 AS eta, sum(e * e) / any_value(n) AS g0,
      floor(pow(any_value(n), 2.0::DOUBLE / 9.0::DOUBLE)) AS l0 FROM e GROUP BY 1),
  acov AS (SELECT a.series_id, a.pos - b.pos AS lag, sum(a.e * b.e) AS c FROM e a JOIN e b ON a.series_id = b.series_id AND b.pos < a.pos GROUP BY 1, 2),
  s AS (SELECT t.series_id, any_value(t.n) AS n, any_value(t.eta) AS eta, any_value(t.g0) AS g0,
      any_value(t.g0) + sum(c / (t.n / 2)) AS s0, sum(lag * c / (t.n / 2)) AS s1
    FROM eta t JOIN acov a ON a.series_id = t.series_id AND a.lag <= t.l0 GROUP BY 1),
  w AS (SELECT *, least(floor(1.1447 * pow(pow(s1 / s0, 2), 1.0::DOUBLE / 3) * pow(n, 1.0::DOUBLE / 3)), n - 1) AS lags FROM s),
  v AS (SELECT w.series_id, any_value(eta) AS eta, any_value(lags) AS lags,
      any_value(g0) + 2.0 / any_value(n) * coalesce(sum((1 - lag / (lags + 1)) * c), 0) AS var
    FROM w LEFT JOIN acov a ON a.series_id = w.series_id AND a.lag <= w.lags GROUP BY 1)
  SELECT series_id, eta / var AS statistic, lags::INT AS lags,
    CASE WHEN eta / var <= 0.347 THEN 0.10 WHEN eta / var <= 0.463 THEN 0.10 - (eta / var - 0.347) * 0.05 / 0.116
      WHEN eta / var <= 0.574 THEN 0.05 - (eta / var - 0.463) * 0.025 / 0.111
      WHEN eta / var <= 0.739 THEN 0.025 - (eta / var - 0.574) * 0.015 / 0.165 ELSE 0.01 END AS pvalue FROM v)"""


def adf_no_lags_sql(name: str) -> str:
    """Dickey-Fuller without lags: t value of y[t-1] in the regression of dy[t] on it."""
    return f"""(
  WITH c AS (SELECT series_id, lag(value) OVER w AS x, value - lag(value) OVER w AS d FROM ({panel_sql(name)})
    WHERE value IS NOT NULL WINDOW w AS (PARTITION BY series_id ORDER BY timestamp)),
  r AS (SELECT series_id, regr_slope(d, x) AS b, regr_sxx(d, x) AS sxx, regr_syy(d, x) AS syy, regr_count(d, x) AS m
    FROM c WHERE x IS NOT NULL GROUP BY 1)
  SELECT series_id, b / sqrt((syy - b * b * sxx) / (m - 2) / sxx) AS statistic FROM r)"""


def eliminated(a: str, q: str, j: str) -> str:
    """A matrix of q columns (a list, row by row) after one step of elimination with pivot j."""
    row, pivot = f"{a}[(k // {q}) * {q} + {j} + 1]", f"{a}[{j} * {q} + {j} + 1]"
    return f"[CASE WHEN k // {q} > {j} THEN {a}[k + 1] - {row} * {a}[{j} * {q} + k % {q} + 1] / {pivot} ELSE {a}[k + 1] END FOR k IN range({q} * {q})]"


def gram_sql(rows: str) -> str:
    """Gram matrices by series from rows (series_id, q, x: a list of q values)."""
    cell = "SELECT series_id, any_value(q) AS q, k, sum(x[k // q + 1] * x[k % q + 1]) AS v FROM (SELECT *, unnest(range(q * q)) AS k FROM {}) GROUP BY series_id, k"
    return f"SELECT series_id, any_value(q) AS q, list(v ORDER BY k) AS a FROM ({cell.format(rows)}) GROUP BY series_id"


def adf_sql(name: str) -> str:
    """Augmented Dickey-Fuller by normal equations: elimination column by column gives the residual squares of all lags
    on their common rows; the lag with the lowest AIC is fitted again on all its rows."""
    changes = "CASE WHEN {lags} > 0 THEN [d[t - i + 1] FOR i IN range(1, {lags} + 1)] ELSE []::DOUBLE[] END"
    return f"""(
  WITH RECURSIVE c AS (SELECT series_id, value, timestamp, avg(value) OVER w AS mu, stddev_pop(value) OVER w AS sd FROM ({panel_sql(name)})
    WHERE value IS NOT NULL WINDOW w AS (PARTITION BY series_id)),
  y AS (SELECT series_id, count(*)::BIGINT AS n, max(value) = min(value) AS constant, list((value - mu) / nullif(sd, 0) ORDER BY timestamp) AS y,
      least(ceil(12 * pow(count(*) / 100, 0.25::DOUBLE)), floor(count(*) / 2) - 2)::BIGINT AS lags FROM c GROUP BY 1),
  d AS (SELECT *, [y[i + 1] - y[i] FOR i IN range(1, n)] AS d FROM y WHERE lags >= 0 AND NOT constant),
  common AS (SELECT series_id, lags + 3 AS q, list_concat([1.0::DOUBLE, y[t + 1]], {changes.format(lags="lags")}, [d[t + 1]]) AS x
    FROM (SELECT *, unnest(range(lags, n - 1)) AS t FROM d)),
  steps AS (SELECT series_id, q, a, 0::BIGINT AS j, NULL::DOUBLE AS ssr FROM ({gram_sql("common")})
    UNION ALL SELECT series_id, q, b, j + 1, b[q * q] FROM (SELECT *, {eliminated("a", "q", "j")} AS b FROM steps WHERE j < q - 1)),
  best AS (SELECT s.series_id, min_by(j - 2, (n - 1 - lags) * ln(greatest(ssr, 1e-300)) + 2 * (j - 2)) AS b
    FROM steps s JOIN d USING (series_id) WHERE j >= 2 GROUP BY 1),
  own AS (SELECT series_id, b + 3 AS q, list_concat([1.0::DOUBLE], {changes.format(lags="b")}, [y[t + 1], d[t + 1]]) AS x
    FROM (SELECT d.*, b, unnest(range(b, n - 1)) AS t FROM d JOIN best USING (series_id))),
  last AS (SELECT series_id, q, a, 0::BIGINT AS j FROM ({gram_sql("own")})
    UNION ALL SELECT series_id, q, {eliminated("a", "q", "j")}, j + 1 FROM last WHERE j < q - 2),
  fit AS (SELECT series_id, q - 3 AS lags, a[(q - 1) * q - 1] AS yy, a[(q - 1) * q] AS yt, a[q * q] AS tt FROM last WHERE j = q - 2),
  test AS (SELECT f.series_id, f.lags, yt / sqrt(yy * (tt - yt * yt / yy) / (n - 1 - f.lags - (f.lags + 2))) AS statistic
    FROM fit f JOIN d USING (series_id) WHERE n - 1 - f.lags - (f.lags + 2) > 0)
  SELECT series_id, statistic, lags::INT AS lags, {adf_pvalue_sql("statistic")} AS pvalue,
    CASE WHEN constant THEN 'series is constant' WHEN statistic IS NULL THEN 'series too short' END AS error
  FROM (SELECT y.series_id, y.constant, t.statistic, t.lags FROM y LEFT JOIN test t ON t.series_id = y.series_id))"""


def adf_pvalue_sql(t: str) -> str:
    """The response surface as a normal probability, by its power series."""
    z = f"CASE WHEN {t} <= -1.61 THEN 2.1659 + 1.4412 * {t} + 0.038269 * {t}**2 ELSE 1.7339 + 0.93202 * {t} - 0.12745 * {t}**2 - 0.010368 * {t}**3 END"
    odd = f"list_sum([({z}) * exp(k * ln(greatest(pow({z}, 2), 1e-300)) - (k + 1) * ln(2.0) - lgamma(k + 1.5) + 0.5 * ln(pi())) FOR k IN range(200)])"
    return f"CASE WHEN {t} > 2.74 THEN 1.0 WHEN {t} < -18.83 THEN 0.0 WHEN {t} IS NOT NULL THEN 0.5 + exp(-pow({z}, 2) / 2) / sqrt(2 * pi()) * {odd} END"


@query(
    "profile_kpss",
    f"SELECT series_id, round_even(statistic, 8) AS statistic, round_even(pvalue, 6) AS pvalue, lags FROM {kpss_sql('part_monthly')}",
)
def profile_kpss(spark, sf):
    def run(rows, layout):
        return U.kpss(compact(number_rows(rows, layout), layout), layout)

    out = by_length(panel(spark, sf, "part_monthly"), run).drop("error")
    return rounded(rounded(out, 8, "statistic"), 6, "pvalue")


@query(
    "profile_adf_no_lags",
    f"SELECT series_id, round_even(statistic, 6) AS statistic FROM {adf_no_lags_sql('part_monthly')}",
)
def profile_adf_no_lags(spark, sf):
    def run(rows, layout):
        return U.adf(compact(number_rows(rows, layout), layout), 0, layout)

    return rounded(by_length(panel(spark, sf, "part_monthly"), run).select("series_id", "statistic"), 6, "statistic")


def adf_one_lag_sql(name: str) -> str:
    """Dickey-Fuller with zero or one lag, chosen by AIC on common rows; two-regressor normal equations."""
    return f"""
  WITH c AS (SELECT series_id, lag(value) OVER w AS x, value - lag(value) OVER w AS d, lag(value) OVER w - lag(value, 2) OVER w AS z
    FROM ({panel_sql(name)}) WHERE value IS NOT NULL WINDOW w AS (PARTITION BY series_id ORDER BY timestamp)),
  s AS (SELECT series_id, count(*) AS m, regr_sxx(d, x) AS xx, regr_sxx(d, z) AS zz, regr_sxy(z, x) AS xz, regr_sxy(d, x) AS xd,
      regr_sxy(d, z) AS zd, regr_syy(d, x) AS dd FROM c WHERE z IS NOT NULL GROUP BY 1),
  b AS (SELECT *, xx * zz - xz * xz AS det, (xd * zz - zd * xz) / (xx * zz - xz * xz) AS b1, (zd * xx - xd * xz) / (xx * zz - xz * xz) AS b2 FROM s),
  r AS (SELECT *, dd - xd * xd / xx AS ssr0, dd - b1 * xd - b2 * zd AS ssr1 FROM b)
  SELECT r.series_id, CASE WHEN m * ln(ssr1) + 2 < m * ln(ssr0) THEN 1 ELSE 0 END::INT AS lags,
    round_even(CASE WHEN m * ln(ssr1) + 2 < m * ln(ssr0) THEN b1 / sqrt(ssr1 / (m - 3) * zz / det) ELSE a.statistic END, 6) AS statistic
  FROM r JOIN {adf_no_lags_sql(name)} a ON a.series_id = r.series_id"""


@query("profile_adf_one_lag", adf_one_lag_sql("part_monthly"))
def profile_adf_one_lag(spark, sf):
    def run(rows, layout):
        return U.adf(compact(number_rows(rows, layout), layout), 1, layout)

    return rounded(by_length(panel(spark, sf, "part_monthly"), run).select("series_id", "lags", "statistic"), 6, "statistic")


@query("profile_adf", f"SELECT series_id, round_even(statistic, 6) AS statistic, round_even(pvalue, 6) AS pvalue, lags, error FROM {adf_sql('part_monthly')}")
def profile_adf(spark, sf):
    def run(rows, layout):
        return U.adf(compact(number_rows(rows, layout), layout), layout=layout)

    return rounded(by_length(panel(spark, sf, "part_monthly"), run), 6, "statistic", "pvalue")


def stationarity_sql(name: str) -> str:
    return f"""SELECT a.series_id, round_even(a.statistic, 6) AS adf_statistic, round_even(a.pvalue, 6) AS adf_pvalue,
    coalesce(a.pvalue < 0.05, false) AS adf_stationary, round_even(k.statistic, 6) AS kpss_statistic, round_even(k.pvalue, 6) AS kpss_pvalue,
    coalesce(k.pvalue >= 0.05, false) AS kpss_stationary, coalesce(a.pvalue < 0.05, false) AND coalesce(k.pvalue >= 0.05, false) AS stationary, a.error
  FROM {adf_sql(name)} a JOIN {kpss_sql(name)} k ON k.series_id = a.series_id"""


def tested(spark, sf, name, layout=DEFAULT):
    def run(rows, layout):
        return U.stationarity(compact(number_rows(rows, layout), layout), layout=layout)

    out = by_length(panel(spark, sf, name), run, layout)
    return rounded(out, 6, "adf_statistic", "adf_pvalue", "kpss_statistic", "kpss_pvalue")


@query("profile_stationarity", stationarity_sql("part_monthly"))
def profile_stationarity(spark, sf):
    return tested(spark, sf, "part_monthly")


@query("profile_stationarity_cut", stationarity_sql("orders_daily"))
def profile_stationarity_cut(spark, sf):
    return tested(spark, sf, "orders_daily", CUT)


@query(
    "seasonal_strength_cut",
    f"""SELECT series_id, period, round_even(ss, 6) AS seasonal_strength, round_even(ts, 6) AS trend_strength
  FROM ({strength_sql("orders_daily", 7, 30, 365)})""",
)
def seasonal_strength_cut(spark, sf):
    def run(rows, layout):
        return S.strengths(S.decompose(compact(number_rows(rows, layout), layout), ["Daily"], layout=layout))

    out = by_length(panel(spark, sf, "orders_daily"), run, CUT)
    return rounded(out, 6, "seasonal_strength", "trend_strength")


@query(
    "outlier_points_cut",
    outlier_sql("flag_daily", 7, 30, 365)
    + " SELECT series_id, timestamp, round_even(signal, 4) AS signal, round_even(z, 9) AS z FROM z WHERE abs(z) > 3.5",
)
def outlier_points_cut(spark, sf):
    def run(rows, layout):
        return S.outlier_points(scored(number_rows(rows, layout), "Daily", layout))

    return rounded(rounded(by_length(panel(spark, sf, "flag_daily"), run, CUT), 4, "signal"), 9, "z")
