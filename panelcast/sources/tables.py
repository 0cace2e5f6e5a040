"""Panels over the star-schema and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.sources.panel import panel_from_rows

# name -> (table, series expression, time column, value column, frequency)
PANELS = {
    "events_hourly": ("events", "event_type", "ts", "value", "Hourly"),
    "events_daily": ("events", "event_type", "ts", "value", "Daily"),
    "user_daily": ("events", "user_id", "ts", "value", "Daily"),
    "orders_daily": ("orders", "o_orderpriority", "o_orderdate", "o_totalprice", "Daily"),
    "orders_monthly": ("orders", "o_orderpriority", "o_orderdate", "o_totalprice", "Monthly"),
    "orders_quarterly": ("orders", "o_orderpriority", "o_orderdate", "o_totalprice", "Quarterly"),
    "orders_yearly": ("orders", "o_orderpriority", "o_orderdate", "o_totalprice", "Yearly"),
    "part_monthly": ("lineitem", "l_partkey", "l_shipdate", "l_quantity", "Monthly"),
    "flag_daily": ("lineitem", "l_returnflag || l_linestatus", "l_shipdate", "l_quantity", "Daily"),
    "flag_weekly": ("lineitem", "l_returnflag || l_linestatus", "l_shipdate", "l_quantity", "Weekly"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def panel(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, series, ts, value, frequency = PANELS[name]
    return panel_from_rows(
        table(spark, sf_dir, source), F.expr(series), F.col(ts), F.col(value), frequency
    )


def panel_sql(name: str) -> str:
    """The same panel in DuckDB SQL; any other text is taken as the SQL of a panel itself."""
    if name not in PANELS:
        return name
    source, series, ts, value, frequency = PANELS[name]
    label = {
        "Hourly": f"date_trunc('hour', {ts})",
        "Daily": f"date_trunc('day', {ts})",
        "Weekly": f"date_trunc('day', {ts}) + to_days(((7 - dayofweek({ts})) % 7)::INT)",
        "Monthly": f"date_trunc('month', {ts})",
        "Quarterly": f"date_trunc('quarter', {ts})",
        "Yearly": f"date_trunc('year', {ts})",
    }[frequency]
    return (
        f"SELECT ({series})::VARCHAR AS series_id, ({label})::TIMESTAMP AS timestamp, "
        f"sum({value}) AS value, '{frequency}' AS frequency FROM {source} GROUP BY 1, 2"
    )
