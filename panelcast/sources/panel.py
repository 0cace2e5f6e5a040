"""Panels: building, normalizing, sampling, indexing and reading them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.functions.frequency import (
    ANCHOR,
    FREQUENCIES,
    add_steps,
    first_on_grid,
    floor_to_step,
    on_anchor,
    step_phase,
    steps_between,
)
from panelcast.functions.values import no_nan
from panelcast.operators.layout import DEFAULT, Layout

PANEL = "series_id STRING, timestamp TIMESTAMP_NTZ, value DOUBLE, frequency STRING"
RAW_STEPS = "unique_id STRING, ds INT, y DOUBLE"


def panel_from_rows(
    rows: DataFrame, series: Column, ts: Column, value: Column, frequency: str
) -> DataFrame:
    """Sum raw rows per series and step. A busy (series, step) is pre-added on the map side."""
    return (
        rows.groupBy(series.cast("string").alias("series_id"), floor_to_step(ts, frequency).alias("timestamp"))
        .agg(F.sum(no_nan(value.cast("double"))).alias("value"))
        .withColumn("frequency", F.lit(frequency))
    )


def read_raw_steps(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Long raw panel `unique_id, ds, y` from Parquet or CSV (with a header line)."""
    reader = spark.read.schema(RAW_STEPS)
    raw = reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)
    return raw.withColumn("y", no_nan(F.col("y")))


def normalize_steps(raw: DataFrame, frequency: str, limit: int | None = None) -> DataFrame:
    """`unique_id, ds, y` with 1-based steps -> panel, every series anchored to the same first date."""
    if frequency not in FREQUENCIES:
        raise ValueError(f"unknown frequency: {frequency}")
    if limit is not None:
        raw = first_series(raw, limit, "unique_id")
    group = F.lit(frequency)
    start = first_on_grid(F.lit(ANCHOR).cast("timestamp_ntz"), group)
    return raw.select(
        F.col("unique_id").alias("series_id"),
        add_steps(start, F.col("ds").cast("int") - 1, group).alias("timestamp"),
        no_nan(F.col("y").cast("double")).alias("value"),
        group.alias("frequency"),
    )


def first_series(rows: DataFrame, limit: int, id_col: str = "series_id") -> DataFrame:
    """All rows of the first `limit` ids in string order (a sampling operator)."""
    ids = rows.select(id_col).distinct().orderBy(id_col).limit(limit)
    return rows.join(ids, id_col, "left_semi")


def write_panel(panel: DataFrame, path: str) -> None:
    panel.write.mode("overwrite").partitionBy("frequency").parquet(path)


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PANEL).parquet(path).withColumn("value", no_nan(F.col("value")))


def series_index(panel: DataFrame, dataset: str, source_path: str) -> DataFrame:
    return panel.groupBy("series_id", "frequency").agg(
        F.count(F.lit(1)).alias("n_obs"),
        F.min("timestamp").alias("start_timestamp"),
        F.max("timestamp").alias("end_timestamp"),
    ).select(
        "series_id",
        F.lit(dataset).alias("dataset"),
        "frequency",
        "n_obs",
        "start_timestamp",
        "end_timestamp",
        F.lit(source_path).alias("source_path"),
    )


def upsert_index(current: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Newer values win, except created_at, which stays as first written."""
    fields = [c for c in new.columns if c != "series_id"]
    old, fresh = current.alias("old"), new.alias("new")
    return old.join(fresh, F.col("old.series_id") == F.col("new.series_id"), "full_outer").select(
        F.coalesce("new.series_id", "old.series_id").alias("series_id"),
        *[
            F.when(F.col("new.series_id").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c)
            for c in fields
        ],
        F.coalesce(F.col("old.created_at"), now).alias("created_at"),
    )


def select_series(panel: DataFrame, ids: Sequence[str]) -> DataFrame:
    return panel.filter(F.col("series_id").isin(list(ids)))


def load_series(panel: DataFrame, index: DataFrame, series_id: str) -> DataFrame:
    """Timestamps and values of one indexed series; the id filter reaches the Parquet scan."""
    if index.filter(F.col("series_id") == series_id).isEmpty():
        raise KeyError(f"the index has no series {series_id!r}")
    return select_series(panel, [series_id]).select("timestamp", "value", "frequency")


def duplicate_steps(panel: DataFrame) -> DataFrame:
    return (
        panel.groupBy("series_id", "timestamp").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    )


def require_unique_steps(panel: DataFrame) -> DataFrame:
    """Raise when a series has two rows at one timestamp; an action on the counts only."""
    found = duplicate_steps(panel).limit(3).collect()
    if found:
        raise ValueError(f"duplicate timestamps: {[(r.series_id, r.timestamp) for r in found]}")
    return panel


def grid_span(panel: DataFrame) -> DataFrame:
    """Per series: first grid point, number of grid points, and how many of them hold a value.

    Rows are counted per (series, place inside the step) first, which is one group for a series on
    its grid, so the heavy part is a map-side count. The group with the earliest row is the grid's.
    """
    ts = F.col("timestamp")
    by_phase = panel.groupBy("series_id", "frequency", step_phase(ts).alias("phase")).agg(
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
        F.count(F.when(on_anchor(ts), F.col("value"))).alias("present"),
    )
    spans = by_phase.groupBy("series_id", "frequency").agg(
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
        F.min_by("present", "first_ts").alias("present"),
    )
    start = first_on_grid(F.col("first_ts"))
    points = F.when(start <= F.col("last_ts"), steps_between(start, F.col("last_ts")) + 1)
    points = F.coalesce(points, F.lit(0)).cast("bigint")
    message = F.concat(F.lit("more rows than grid points, so duplicate timestamps, in series "), F.col("series_id"))
    present = F.when(F.col("present") > points, F.raise_error(message).cast("bigint")).otherwise(F.col("present"))
    return spans.select(
        "series_id",
        "frequency",
        start.alias("grid_start"),
        points.alias("expected_n"),
        F.when(points > 0, present).otherwise(F.col("present")).alias("present"),
    )


def reindex(panel: DataFrame, layout: Layout = DEFAULT) -> DataFrame:
    """The panel on its full calendar grid: absent points appear with NULL, off-grid rows vanish.

    The grid is generated in two steps, chunks first, so that a long grid is built by many tasks.
    """
    c = layout.chunk_rows
    spans = grid_span(panel).filter("expected_n > 0")
    chunks = spans.select(
        "*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("expected_n") - 1) / c))).alias("chunk")
    ).repartition("series_id", "chunk")
    last = F.least(F.col("expected_n"), (F.col("chunk") + 1) * c) - 1
    grid = chunks.select(
        "series_id", "frequency", "grid_start", F.explode(F.sequence(F.col("chunk") * c, last)).alias("step")
    ).select(
        "series_id", "frequency", add_steps(F.col("grid_start"), F.col("step")).alias("timestamp")
    )
    return grid.join(panel.select("series_id", "timestamp", "value"), ["series_id", "timestamp"], "left").select(
        "series_id", "timestamp", "value", "frequency"
    )


def zero_filled(panel: DataFrame, layout: Layout = DEFAULT) -> DataFrame:
    """Grid with absent demand as 0, the usual reading of sales panels."""
    return reindex(panel, layout).withColumn("value", F.coalesce("value", F.lit(0.0)))
