"""Series list, filters, notes and result tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.operators import explore as X
from panelcast.operators import notes as N
from panelcast.operators import profile_basic as B
from panelcast.operators.features import feature_catalog, toggle
from panelcast.plans.profile import diagnostic_deltas, flags, profile_panel
from panelcast.queries.q_catalog import catalog_flags, catalog_sql, configs, lag_1_sql
from panelcast.queries.q_features import us_holiday_sql
from panelcast.queries.q_panel import index_of, index_sql, rounded
from panelcast.queries.q_profile import INTERMITTENCY_SQL, MISSING_SQL, TREND_SQL, adf_no_lags_sql, adf_pvalue_sql, adf_sql, best_sql, kpss_sql, outlier_sql
from panelcast.queries.registry import query
from panelcast.session import cut_lineage
from panelcast.sources import stores as T
from panelcast.sources.tables import panel, panel_sql

LISTED = ("user_daily", "orders_daily", "flag_weekly")


def profile_sql(name: str, grid: str, *periods: int, adf: str | None = None) -> str:
    """The whole profile in SQL; `adf` may give another unit root test (series_id, statistic)."""
    p = panel_sql(name)
    adf = adf or adf_sql(name)
    return f"""(
  WITH n AS (SELECT series_id, any_value(frequency) AS frequency, count(*) AS n_obs, min(timestamp) AS start_timestamp, max(timestamp) AS end_timestamp FROM ({p}) GROUP BY 1),
  m AS ({MISSING_SQL.format(grid=grid, panel=p)}), i AS ({INTERMITTENCY_SQL.format(rows=p)}),
  t AS ({TREND_SQL.format(panel=p)}), b AS ({best_sql(name, *periods)}), k AS (SELECT * FROM {kpss_sql(name)}), a AS (SELECT series_id, statistic, {adf_pvalue_sql('statistic')} AS pvalue FROM {adf}),
  o AS ({outlier_sql(name, *periods)} SELECT series_id, count(*) FILTER (WHERE abs(z) > 3.5) AS hits FROM z GROUP BY 1)
  SELECT n.series_id, n.frequency, n.n_obs, n.start_timestamp, n.end_timestamp, m.expected_n, m.missing_count, m.missing_pct,
    b.detected AS seasonality_detected, b.period AS seasonality_period, b.strength AS seasonality_strength,
    t.detected AS trend_detected, t.slope AS trend_slope, t.strength AS trend_strength,
    round_even(a.statistic, 6) AS adf_statistic, round_even(k.statistic, 6) AS kpss_statistic,
    coalesce(a.pvalue < 0.05, false) AS adf_stationary,
    coalesce(k.statistic <= 0.463, false) AS kpss_stationary,
    i.zero_pct, i.adi, i.cv2, i.category, i.is_intermittent, o.hits AS outlier_count, round_even(o.hits / n.n_obs, 8) AS outlier_pct
  FROM n JOIN m USING (series_id) JOIN i USING (series_id) JOIN t USING (series_id) JOIN b USING (series_id)
    JOIN k USING (series_id) JOIN a USING (series_id) JOIN o USING (series_id))"""


DAYS = "date_diff('day', min(timestamp), max(timestamp)) + 1"
MONTHS = "date_diff('month', min(timestamp), max(timestamp)) + 1"
USER_PROFILE_SQL = profile_sql("user_daily", DAYS, 7, 30, 365)


def flat(profile: DataFrame) -> DataFrame:
    s = lambda path, name=None: F.col(path).alias(name or path.split(".")[1])
    out = profile.select(
        "series_id", "frequency", "n_obs", "start_timestamp", "end_timestamp",
        s("missing.expected_n"), s("missing.missing_count"), F.bround("missing.missing_pct", 6).alias("missing_pct"),
        s("seasonality.detected", "seasonality_detected"), s("seasonality.period", "seasonality_period"),
        s("seasonality.strength", "seasonality_strength"), s("trend.detected", "trend_detected"),
        F.bround("trend.slope", 4).alias("trend_slope"), F.bround("trend.strength", 6).alias("trend_strength"),
        F.bround("stationarity.adf_statistic", 6).alias("adf_statistic"),
        F.bround("stationarity.kpss_statistic", 6).alias("kpss_statistic"),
        s("stationarity.adf_stationary"), s("stationarity.kpss_stationary"),
        F.bround("intermittency.zero_pct", 10).alias("zero_pct"), F.bround("intermittency.adi", 10).alias("adi"),
        F.col("intermittency.cv2").cast("float").cast("double").alias("cv2"),
        s("intermittency.category"), s("intermittency.is_intermittent"),
        s("outliers.count", "outlier_count"), F.bround("outliers.pct", 8).alias("outlier_pct"),
    )
    return out


@query("series_profile", f"SELECT * FROM {profile_sql('part_monthly', MONTHS, 12)}")
def series_profile(spark, sf):
    return flat(profile_panel(panel(spark, sf, "part_monthly"), ["Monthly"]))


def user_profile(spark, sf):
    return profile_panel(panel(spark, sf, "user_daily"), ["Daily"])


@query("series_profile_daily", f"SELECT * FROM {USER_PROFILE_SQL}")
def series_profile_daily(spark, sf):
    return flat(user_profile(spark, sf))


@query("series_profile_no_lags", f"SELECT * FROM {profile_sql('user_daily', DAYS, 7, 30, 365, adf=adf_no_lags_sql('user_daily'))}")
def series_profile_no_lags(spark, sf):
    """The unit root test without lags is a parameter of the profile."""
    return flat(profile_panel(panel(spark, sf, "user_daily"), ["Daily"], adf_lags=0))


@query("profile_json_roundtrip", f"SELECT * FROM {USER_PROFILE_SQL}")
def profile_json_roundtrip(spark, sf):
    return flat(T.profiles_from_documents(T.profile_documents(user_profile(spark, sf))))


def listed(spark, sf):
    index = reduce(DataFrame.unionByName, [index_of(spark, sf, n) for n in LISTED])
    return X.series_list(index, user_profile(spark, sf))


LIST_SQL = f"""(SELECT i.series_id, i.dataset, i.frequency, i.n_obs, p.trend_detected, p.seasonality_detected, p.seasonality_period,
    p.adf_stationary AND p.kpss_stationary AS stationary, p.category AS intermittency_category
  FROM ({" UNION ALL ".join(index_sql(n) for n in LISTED)}) i LEFT JOIN {USER_PROFILE_SQL} p ON p.series_id = i.series_id)"""


def flat_list(rows: DataFrame) -> DataFrame:
    return rows.select("series_id", "dataset", "frequency", "n_obs", "profile_summary.*")


@query("series_list", f"SELECT * FROM {LIST_SQL}")
def series_list(spark, sf):
    return flat_list(listed(spark, sf))


FILTER = dict(search="1", frequency="Daily", category="smooth")
FILTER_SQL = "contains(lower(series_id), '1') AND frequency = 'Daily' AND coalesce(intermittency_category = 'smooth', false)"


@query("explore_filter", f"SELECT * FROM {LIST_SQL} WHERE {FILTER_SQL}")
def explore_filter(spark, sf):
    return flat_list(listed(spark, sf).filter(X.matches(**FILTER)))


@query(
    "explore_filter_flags",
    f"SELECT * FROM {LIST_SQL} WHERE coalesce(seasonality_detected, false) OR coalesce(trend_detected, false)",
)
def explore_filter_flags(spark, sf):
    rows = listed(spark, sf)
    return flat_list(rows.filter(X.matches(seasonal_only=True) | X.matches(trend_only=True)))


@query(
    "facets",
    f"""SELECT DISTINCT 'frequency' AS facet, frequency AS value FROM {LIST_SQL}
  UNION ALL SELECT DISTINCT 'intermittency_category', intermittency_category FROM {LIST_SQL} WHERE intermittency_category IS NOT NULL""",
)
def facets(spark, sf):
    return X.facets(listed(spark, sf))


@query("filter_counts", f"SELECT count(*) FILTER (WHERE {FILTER_SQL}) AS n_shown, count(*) AS n_total FROM {LIST_SQL}")
def filter_counts(spark, sf):
    return X.filter_counts(listed(spark, sf), X.matches(**FILTER))


COMPARED = ("click", "view", "purchase", "error", "signup")


@query(
    "compare_select",
    f"SELECT series_id, timestamp, round_even(value, 2) AS value, frequency FROM ({panel_sql('events_hourly')}) WHERE series_id IN {COMPARED}",
)
def compare_select(spark, sf):
    return rounded(X.compare(panel(spark, sf, "events_hourly"), COMPARED))


AFTER_SQL = profile_sql(lag_1_sql("user_daily"), DAYS, 7, 30, 365)


@query(
    "diagnostic_deltas_lag_1",
    f"""WITH b AS (SELECT * FROM {USER_PROFILE_SQL}), a AS (SELECT * FROM {AFTER_SQL}),
  r AS (SELECT series_id, any_value(r2) AS r2 FROM ({lag_1_sql("user_daily")}) GROUP BY 1)
  SELECT r.series_id, round_even(r2, 6) AS r_squared, b.trend_strength AS trend_strength_before, a.trend_strength AS trend_strength_after,
    b.seasonality_strength AS seasonality_strength_before, a.seasonality_strength AS seasonality_strength_after,
    b.adf_stationary AND b.kpss_stationary AS stationary_before, a.adf_stationary AND a.kpss_stationary AS stationary_after,
    b.outlier_count AS outlier_count_before, a.outlier_count AS outlier_count_after, a.outlier_count < b.outlier_count AS outlier_count_fell,
    a.trend_strength < b.trend_strength AS trend_strength_fell, a.seasonality_strength < b.seasonality_strength AS seasonality_strength_fell
  FROM r JOIN a ON a.series_id = r.series_id JOIN b ON b.series_id = r.series_id""",
)
def diagnostic_deltas_lag_1(spark, sf):
    """Deltas with only the previous value as a feature."""
    rows = cut_lineage(panel(spark, sf, "user_daily"))
    profile = cut_lineage(profile_panel(rows, ["Daily"]))
    only = feature_catalog(flags(profile)).withColumn("enabled", F.col("name") == "lag_1")
    out = diagnostic_deltas(rows, profile, only, ["Daily"])
    return rounded(out, 6, "r_squared", "trend_strength_before", "trend_strength_after")


# ---- result tables --------------------------------------------------------------------------


def cached_demand(rows):
    return B.intermittency(rows).select("series_id", "zero_pct", "adi", "category")


@query(
    "profile_incremental",
    f"""WITH old AS ({INTERMITTENCY_SQL.format(rows=f"SELECT * FROM ({panel_sql('part_monthly')}) WHERE timestamp < '1995-07-01'")}),
  new AS ({INTERMITTENCY_SQL.format(rows=f"SELECT * FROM ({panel_sql('part_monthly')}) WHERE series_id NOT IN (SELECT l_partkey::VARCHAR FROM lineitem WHERE l_shipdate < '1995-07-01')")})
  SELECT series_id, zero_pct, adi, category FROM old UNION ALL SELECT series_id, zero_pct, adi, category FROM new""",
)
def profile_incremental(spark, sf):
    rows = panel(spark, sf, "part_monthly")
    early = rows.filter(F.col("timestamp") < F.lit("1995-07-01").cast("timestamp_ntz"))
    return rounded(T.compute_missing(rows, cached_demand(early), cached_demand), 10, "zero_pct", "adi")


@query("profile_refreshed", f"SELECT * FROM {USER_PROFILE_SQL}")
def profile_refreshed(spark, sf):
    """A cache that lacks a third of the series and holds outdated profiles of another third."""
    rows = cut_lineage(panel(spark, sf, "user_daily"))
    third = F.pmod(F.col("series_id").cast("int"), F.lit(3))
    early = F.col("timestamp") < F.lit("2024-01-20").cast("timestamp_ntz")
    whole = lambda part: profile_panel(part, ["Daily"])
    cache = cut_lineage(whole(rows.filter((third == 0) | ((third == 1) & early))))
    return flat(T.compute_missing(rows, cache, whole, refresh=True))


CONFIG_CATALOG = catalog_sql("user_daily", ["day_of_week", "is_weekend"], 7, 7, 30, 365)


@query(
    "feature_config",
    f"""WITH c AS ({CONFIG_CATALOG}), s AS (SELECT series_id, name, name <> 'lag_1' AS enabled FROM c)
  SELECT i.series_id, coalesce(config, '') AS config FROM (SELECT DISTINCT series_id FROM ({panel_sql("user_daily")})
    UNION ALL SELECT DISTINCT series_id FROM ({panel_sql("flag_weekly")})) i
  LEFT JOIN (SELECT series_id, string_agg(name || '=' || enabled::VARCHAR, ',' ORDER BY name) AS config FROM s GROUP BY 1) g ON g.series_id = i.series_id""",
)
def feature_config(spark, sf):
    catalog = feature_catalog(catalog_flags(spark, sf, "user_daily", "Daily"))
    stored = T.store_configs(catalog.select("series_id", "name", (F.col("name") != "lag_1").alias("enabled")))
    index = index_of(spark, sf, "user_daily").unionByName(index_of(spark, sf, "flag_weekly"))
    pairs = F.transform(
        F.sort_array(F.map_entries("config")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))
    )
    return T.read_configs(index, stored).select("series_id", F.array_join(pairs, ",").alias("config"))


# ---- notes ----------------------------------------------------------------------------------


@query(
    "notes_payload_batches",
    f"""SELECT (row_number() OVER (ORDER BY series_id) - 1) // 20 AS batch, least(20, count(*) OVER () - 20 * ((row_number() OVER (ORDER BY series_id) - 1) // 20)) AS n_series,
    series_id, n_obs, category FROM {USER_PROFILE_SQL}""",
)
def notes_payload_batches(spark, sf):
    """Batches of twenty, taken apart again."""
    payloads = N.payload(user_profile(spark, sf))
    batches = N.payload_batches(payloads, 20, panel(spark, sf, "user_daily").select("series_id").distinct().count())
    schema = "ARRAY<STRUCT<series_id: STRING, n_obs: BIGINT, intermittency: STRUCT<category: STRING>>>"
    notes = batches.select("batch", "n_series", F.explode(F.from_json("payload", schema)).alias("p"))
    return notes.select("batch", "n_series", "p.series_id", "p.n_obs", "p.intermittency.category")


@query(
    "notes_payload",
    f"""SELECT series_id, frequency, n_obs, strftime(start_timestamp, '%Y-%m-%dT%H:%M:%S') AS first_date,
    strftime(end_timestamp, '%Y-%m-%dT%H:%M:%S') AS last_date, expected_n, seasonality_period, category, outlier_count
  FROM {USER_PROFILE_SQL}""",
)
def notes_payload(spark, sf):
    schema = """series_id STRING, frequency STRING, n_obs BIGINT, date_range ARRAY<STRING>, missing STRUCT<expected_n: BIGINT>,
      seasonality STRUCT<period: INT>, intermittency STRUCT<category: STRING>, outliers STRUCT<count: BIGINT>"""
    p = N.payload(user_profile(spark, sf)).select(F.from_json("payload", schema).alias("p"))
    return p.select(
        "p.series_id", "p.frequency", "p.n_obs", F.col("p.date_range")[0].alias("first_date"),
        F.col("p.date_range")[1].alias("last_date"), "p.missing.expected_n",
        F.col("p.seasonality.period").alias("seasonality_period"), "p.intermittency.category",
        F.col("p.outliers.count").alias("outlier_count"),
    )


def answers(index: DataFrame) -> DataFrame:
    """Answer texts made from the index, one per series: some suggestions are not valid, some countries
    unknown, one series unknown, and a series with an odd row count gets an unreadable text."""
    n = F.col("n_obs")

    def feature(name, kind, confidence, country):
        return F.struct(
            F.lit(name).alias("name"), kind.alias("feature_type"), F.lit("d").alias("description"),
            F.lit("r").alias("rationale"), confidence.alias("confidence"), country.alias("holiday_country"),
        )

    features = F.array(
        feature("weekday", F.lit("calendar"), F.lit(0.5), F.lit(None).cast("string")),
        feature("wave", F.when(n % 5 == 0, "seasonal").otherwise("fourier"), n / 24, F.lit(None).cast("string")),
        feature("holiday", F.lit("holiday"), F.lit(0.7), F.when(n % 3 == 0, "ZZ").when(n % 3 == 1, "")),
    )
    models = F.array(F.struct(F.lit("ETS").alias("name"), F.lit("fits").alias("rationale")))

    def note(series):
        return F.struct(
            series.alias("series_id"), F.concat(F.lit("rows: "), n).alias("narrative"),
            features.alias("suggested_features"), models.alias("suggested_models"),
        )

    text = F.to_json(F.struct(F.array(note(F.col("series_id")), note(F.lit("unknown"))).alias("results")))
    return index.select(F.when(n % 2 == 1, F.lit("no json")).otherwise(text).alias("text"))


ANSWERS_SQL = f"""i AS (SELECT series_id, count(*) AS n, min(timestamp) AS a, max(timestamp) AS b FROM ({panel_sql("user_daily")}) GROUP BY 1),
  f AS (SELECT series_id, a, b, 0 AS ord, 'weekday' AS name, 'calendar' AS feature_type, 0.5::DOUBLE AS confidence, NULL AS country FROM i WHERE n % 2 = 0
    UNION ALL SELECT series_id, a, b, 1, 'wave', 'fourier', n / 24, NULL FROM i WHERE n % 2 = 0 AND n % 5 <> 0 AND n <= 24
    UNION ALL SELECT series_id, a, b, 2, 'holiday', 'holiday', 0.7, CASE WHEN n % 3 = 0 THEN 'ZZ' ELSE 'US' END FROM i WHERE n % 2 = 0)"""


def ingested(spark, sf):
    index = index_of(spark, sf, "user_daily")
    return N.ingest_notes(answers(index), index)


@query(
    "notes_ingest",
    f"WITH {ANSWERS_SQL} SELECT series_id, ord, name, feature_type, round_even(confidence, 6) AS confidence FROM f",
)
def notes_ingest(spark, sf):
    _, features, _ = ingested(spark, sf)
    return rounded(features.select("series_id", "ord", "name", "feature_type", "confidence"), 6, "confidence")


@query(
    "notes_rejects",
    f"""WITH {ANSWERS_SQL}
  SELECT series_id, 'wave' AS name, CASE WHEN n % 5 = 0 THEN 'unknown feature type' ELSE 'confidence outside 0..1' END AS reason
    FROM i WHERE n % 2 = 0 AND (n % 5 = 0 OR n > 24)
  UNION ALL SELECT NULL, NULL, 'note is not readable' FROM i WHERE n % 2 = 1""",
)
def notes_rejects(spark, sf):
    return ingested(spark, sf)[2]


CHECKED_SQL = f"""c AS (SELECT f.*, CASE WHEN feature_type <> 'holiday' THEN NULL WHEN country = 'US' THEN
      (SELECT count(*) FROM (SELECT unnest(generate_series(TIMESTAMP '2023-12-01', TIMESTAMP '2024-03-01', INTERVAL 1 DAY)) AS d)
       WHERE {us_holiday_sql("d")} AND d BETWEEN a AND b) ELSE 0 END AS m FROM f)"""


@query(
    "holiday_crosscheck",
    f"""WITH {ANSWERS_SQL}, {CHECKED_SQL}
  SELECT series_id, ord, name, country AS holiday_country, m > 0 AS holiday_confirmed, m::INT AS holiday_match_count FROM c""",
)
def holiday_crosscheck(spark, sf):
    _, features, _ = ingested(spark, sf)
    return N.cross_check(features).select(
        "series_id", "ord", "name", "holiday_country", "holiday_confirmed", "holiday_match_count"
    )


@query(
    "feature_panel",
    f"""WITH {ANSWERS_SQL}, {CHECKED_SQL}, cat AS ({CONFIG_CATALOG}),
  g AS (SELECT series_id, string_agg(name || CASE WHEN name = 'lag_1' AND (length(series_id) + ascii(series_id)) % 3 = 0 THEN ':off' ELSE ':on' END, ',' ORDER BY ord) AS catalog FROM cat GROUP BY 1),
  h AS (SELECT series_id, string_agg(name, ',' ORDER BY ord) AS suggested FROM c GROUP BY 1)
  SELECT g.series_id, catalog, CASE WHEN n % 2 = 0 THEN 'rows: ' || n END AS narrative, coalesce(suggested, '') AS suggested,
    CASE WHEN n % 2 = 0 THEN 1 END::INT AS n_models
  FROM g JOIN i ON i.series_id = g.series_id LEFT JOIN h ON h.series_id = g.series_id""",
)
def feature_panel(spark, sf):
    catalog = feature_catalog(catalog_flags(spark, sf, "user_daily", "Daily"))
    notes, features, _ = ingested(spark, sf)
    out = N.feature_panel(toggle(catalog, configs(catalog)), notes, N.cross_check(features))
    switch = lambda c: F.concat(c["name"], F.when(c["enabled"], ":on").otherwise(":off"))
    names = F.transform("suggested_features", lambda f: f["name"])
    return out.select(
        "series_id",
        F.array_join(F.transform("catalog", switch), ",").alias("catalog"),
        "narrative",
        F.coalesce(F.array_join(names, ","), F.lit("")).alias("suggested"),
        F.when(F.col("suggested_models").isNotNull(), F.size("suggested_models")).alias("n_models"),
    )
