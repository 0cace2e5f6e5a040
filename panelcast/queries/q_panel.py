"""Panel sources, index and grid."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.operators.layout import number_rows
from panelcast.queries.registry import query
from panelcast.sources import panel as P
from panelcast.sources.tables import PANELS, panel, panel_sql

SPEC_PANELS = ["events_hourly", "events_daily", "flag_weekly", "orders_monthly", "orders_quarterly", "orders_yearly"]


def rounded(df: DataFrame, places: int = 2, *cols: str) -> DataFrame:
    return df.withColumns({c: F.bround(c, places) for c in cols or ("value",)})


def _panel_query(name: str):
    query(
        f"panel_{name}",
        f"SELECT series_id, timestamp, round_even(value, 2) AS value, frequency FROM ({panel_sql(name)})",
    )(lambda spark, sf: rounded(panel(spark, sf, name)))


for _name in PANELS:
    _panel_query(_name)


def raw_steps(spark, sf, name: str) -> DataFrame:
    """A panel as a raw step panel: its rows counted from 1."""
    return number_rows(panel(spark, sf, name)).select(
        F.concat_ws("_", "series_id", "frequency").alias("unique_id"),
        (F.col("pos") + 1).cast("int").alias("ds"),
        F.col("value").alias("y"),
    )


_ALL = " UNION ALL ".join(f"({panel_sql(n)})" for n in SPEC_PANELS)
STEPS_SQL = f"""SELECT series_id || '_' || frequency AS unique_id, frequency, value AS y,
  (row_number() OVER (PARTITION BY series_id, frequency ORDER BY timestamp))::INT AS ds FROM ({_ALL})"""


@query(
    "normalize_steps",
    f"""SELECT unique_id AS series_id, frequency, round_even(y, 2) AS value,
  (CASE frequency
    WHEN 'Hourly' THEN TIMESTAMP '2013-01-01' + to_hours(ds - 1)
    WHEN 'Daily' THEN TIMESTAMP '2013-01-01' + to_days(ds - 1)
    WHEN 'Weekly' THEN TIMESTAMP '2013-01-06' + to_days(7 * (ds - 1))
    WHEN 'Monthly' THEN TIMESTAMP '2013-01-01' + to_months(ds - 1)
    WHEN 'Quarterly' THEN TIMESTAMP '2013-01-01' + to_months(3 * (ds - 1))
    ELSE TIMESTAMP '2013-01-01' + to_months(12 * (ds - 1)) END)::TIMESTAMP AS timestamp
  FROM ({STEPS_SQL})""",
)
def normalize_steps(spark, sf):
    parts = [P.normalize_steps(raw_steps(spark, sf, n), PANELS[n][-1]) for n in SPEC_PANELS]
    return rounded(reduce(DataFrame.unionByName, parts))


@query(
    "sample_first_n",
    f"""WITH p AS ({panel_sql("part_monthly")})
  SELECT series_id, timestamp, round_even(value, 2) AS value FROM p
  WHERE series_id IN (SELECT DISTINCT series_id FROM p ORDER BY series_id LIMIT 50)""",
)
def sample_first_n(spark, sf):
    return rounded(P.first_series(panel(spark, sf, "part_monthly"), 50).select("series_id", "timestamp", "value"))


def index_of(spark, sf, name: str) -> DataFrame:
    return P.series_index(panel(spark, sf, name), "sales", f"{name}.parquet")


def index_sql(name: str) -> str:
    return f"""SELECT series_id, 'sales' AS dataset, frequency, count(*) AS n_obs, min(timestamp) AS start_timestamp,
  max(timestamp) AS end_timestamp, '{name}.parquet' AS source_path FROM ({panel_sql(name)}) GROUP BY series_id, frequency"""


@query("series_index", index_sql("part_monthly"))
def series_index(spark, sf):
    return index_of(spark, sf, "part_monthly")


@query(
    "series_index_upsert",
    f"""WITH p AS ({panel_sql("part_monthly")}),
  o AS (SELECT series_id, count(*) AS n, min(timestamp) AS s, max(timestamp) AS e FROM p WHERE timestamp < '1999-01-01' GROUP BY 1),
  f AS (SELECT series_id, count(*) AS n, min(timestamp) AS s, max(timestamp) AS e FROM p WHERE timestamp >= '1997-01-01' GROUP BY 1)
  SELECT coalesce(f.series_id, o.series_id) AS series_id, 'sales' AS dataset, 'Monthly' AS frequency,
    coalesce(f.n, o.n) AS n_obs, coalesce(f.s, o.s) AS start_timestamp, coalesce(f.e, o.e) AS end_timestamp,
    CASE WHEN f.series_id IS NULL THEN 'first.parquet' ELSE 'second.parquet' END AS source_path,
    CASE WHEN o.series_id IS NULL THEN TIMESTAMP '2024-02-01' ELSE TIMESTAMP '2024-01-01' END AS created_at
  FROM o FULL OUTER JOIN f ON o.series_id = f.series_id""",
)
def series_index_upsert(spark, sf):
    p = panel(spark, sf, "part_monthly")
    stamp = lambda s: F.lit(s).cast("timestamp_ntz")
    old = P.series_index(p.filter(F.col("timestamp") < stamp("1999-01-01")), "sales", "first.parquet")
    new = P.series_index(p.filter(F.col("timestamp") >= stamp("1997-01-01")), "sales", "second.parquet")
    return P.upsert_index(old.withColumn("created_at", stamp("2024-01-01")), new, stamp("2024-02-01"))


@query(
    "load_series",
    f"SELECT timestamp, round_even(value, 2) AS value, frequency FROM ({panel_sql('orders_daily')}) WHERE series_id = '1-URGENT'",
)
def load_series(spark, sf):
    p = panel(spark, sf, "orders_daily")
    return rounded(P.load_series(p, P.series_index(p, "sales", "orders.parquet"), "1-URGENT"))


@query(
    "grid_reindex",
    f"""WITH p AS ({panel_sql("events_hourly")}),
  g AS (SELECT series_id, unnest(generate_series(min(timestamp), max(timestamp), INTERVAL 1 HOUR)) AS timestamp FROM p GROUP BY 1)
  SELECT g.series_id, g.timestamp, round_even(p.value, 2) AS value, 'Hourly' AS frequency
  FROM g LEFT JOIN p ON p.series_id = g.series_id AND p.timestamp = g.timestamp""",
)
def grid_reindex(spark, sf):
    return rounded(P.reindex(panel(spark, sf, "events_hourly")))


@query(
    "grid_reindex_weekly",
    f"""WITH p AS ({panel_sql("orders_daily")}),
  s AS (SELECT series_id, min(timestamp) AS a, max(timestamp) AS b FROM p GROUP BY 1),
  g AS (SELECT series_id, unnest(generate_series(a + to_days(((7 - dayofweek(a)) % 7)::INT), b, INTERVAL 7 DAY)) AS timestamp FROM s)
  SELECT g.series_id, g.timestamp, round_even(p.value, 2) AS value, 'Weekly' AS frequency
  FROM g LEFT JOIN p ON p.series_id = g.series_id AND p.timestamp = g.timestamp""",
)
def grid_reindex_weekly(spark, sf):
    daily = panel(spark, sf, "orders_daily").withColumn("frequency", F.lit("Weekly"))
    return rounded(P.reindex(daily))


@query(
    "duplicate_steps",
    "SELECT user_id::VARCHAR AS series_id, date_trunc('hour', ts)::TIMESTAMP AS timestamp, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1",
)
def duplicate_steps(spark, sf):
    from panelcast.functions.frequency import floor_to_step
    from panelcast.sources.tables import table

    rows = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("series_id"), floor_to_step(F.col("ts"), "Hourly").alias("timestamp")
    )
    return P.duplicate_steps(rows)
