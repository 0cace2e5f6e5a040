"""How a panel is laid out over tasks.

Series of at most `chunk_rows` rows are kept whole: one shuffle on series_id, and every window,
median and total after it runs without another one. A longer series must not sit in one task, so it
is cut: rows get their position in two levels (position inside a time block plus the number of rows
in earlier blocks), positions are cut into chunks of fixed size, and windows run inside
(series_id, chunk). Where a frame reaches over a chunk edge, the few rows it needs are given to the
neighbouring chunk as well (`spread`). Values per series travel to the rows by a join on
(series_id, chunk), so a long series is not gathered by that join either (`attach`).

`by_length` measures a panel and gives the short and the long series to the same operator with the
layout each of them needs. Both layouts give the same results; without a measurement an operator
assumes that any series may be long.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from panelcast.functions.frequency import FREQUENCIES, day_number, per_frequency
from panelcast.functions.values import no_nan
from panelcast.session import cut_lineage


@dataclass(frozen=True)
class Layout:
    chunk_rows: int = 4096  # positions per chunk
    block_steps: int = 4096  # steps per time block
    group_rows: int = 65536  # a median of at most this many values is taken in one buffer
    whole: bool = False  # no series is longer than one chunk


DEFAULT = Layout()
BROADCAST_IDS = 100_000


def by_length(
    panel: DataFrame, run: Callable[[DataFrame, Layout], DataFrame], layout: Layout = DEFAULT
) -> DataFrame:
    """`run` on the panel, its long series cut and all others whole. Writes the panel once (it is
    read several times from here on) and counts its rows per series."""
    panel = cut_lineage(panel.withColumn("value", no_nan(F.col("value"))))
    counts = panel.groupBy("series_id").agg(F.count(F.lit(1)).alias("rows"))
    too_long = F.col("rows") > layout.chunk_rows
    n_long = counts.agg(F.count_if(too_long)).first()[0]
    whole = replace(layout, whole=True)
    if n_long == 0:
        return run(panel, whole)
    long_ids = cut_lineage(counts.filter(too_long).select("series_id"))
    if n_long <= BROADCAST_IDS:  # beyond that the join splits a series that is too big for one task
        long_ids = F.broadcast(long_ids)
    short = panel.join(long_ids, "series_id", "left_anti")
    long = panel.join(long_ids, "series_id", "left_semi")
    return run(short, whole).unionByName(run(long, layout))


def time_block(layout: Layout) -> Column:
    days = {
        n: F.lit(max(1, layout.block_steps // 24) if f.step_days == 0 else layout.block_steps * f.step_days)
        for n, f in FREQUENCIES.items()
    }
    width = F.coalesce(per_frequency(days), F.lit(layout.block_steps))
    return F.floor(day_number(F.col("timestamp")) / width)


def number_rows(panel: DataFrame, layout: Layout = DEFAULT) -> DataFrame:
    """Add pos (0-based row number in time), cpos (the same over non-null values only, NULL on a
    null value), n_obs and n_clean (the two totals) and chunk (pos div chunk_rows). Two rows of a series at one
    timestamp are an error."""
    if layout.whole:
        inside = Window.partitionBy("series_id").orderBy("timestamp")
        series = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        blocked = panel.withColumns(
            {
                "rows_before": F.lit(0).cast("bigint"),
                "filled_before": F.lit(0).cast("bigint"),
                "n_obs": F.count(F.lit(1)).over(series),
                "n_clean": F.count("value").over(series),
            }
        )
    else:
        blocked = panel.withColumn("block", time_block(layout))
        counts = blocked.groupBy("series_id", "block").agg(
            F.count(F.lit(1)).alias("rows"), F.count("value").alias("filled")
        )
        series = Window.partitionBy("series_id")
        earlier = series.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.select(
            "series_id",
            "block",
            F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"),
            F.coalesce(F.sum("filled").over(earlier), F.lit(0)).alias("filled_before"),
            F.sum("rows").over(series).alias("n_obs"),
            F.sum("filled").over(series).alias("n_clean"),
        )
        blocked = blocked.join(offsets, ["series_id", "block"])
        inside = Window.partitionBy("series_id", "block").orderBy("timestamp")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    filled = F.when(F.col("value").isNotNull(), F.col("filled_before") + F.count("value").over(upto) - 1)
    twice = F.lag("timestamp").over(inside) == F.col("timestamp")
    message = F.concat(F.lit("duplicate timestamp "), F.col("timestamp").cast("string"), F.lit(" in series "), F.col("series_id"))
    place = F.col("rows_before") + F.row_number().over(inside) - 1
    return (
        blocked.withColumn("pos", F.when(twice, F.raise_error(message).cast("bigint")).otherwise(place))
        .withColumn("cpos", filled)
        .withColumn("chunk", chunk_of("pos", layout))
        .drop("block", "rows_before", "filled_before")
    )


def chunk_of(pos: str, layout: Layout) -> Column:
    return F.lit(0).cast("bigint") if layout.whole else F.floor(F.col(pos) / layout.chunk_rows)


def compact(numbered: DataFrame, layout: Layout = DEFAULT) -> DataFrame:
    """Rows with a value, positions counted over those rows: series_id, frequency, timestamp, value,
    pos, n, chunk."""
    return numbered.filter(F.col("value").isNotNull()).select(
        "series_id",
        "frequency",
        "timestamp",
        "value",
        F.col("cpos").alias("pos"),
        F.col("n_clean").alias("n"),
        chunk_of("cpos", layout).alias("chunk"),
    )


def spread(
    rows: DataFrame, size: str, back: Column | int, ahead: Column | int = 0, layout: Layout = DEFAULT
) -> DataFrame:
    """Give each row to its own chunk and to the neighbours whose frames reach it. `back` rows before
    and `ahead` rows after a chunk become visible in it; `own` tells the chunk's own rows."""
    if layout.whole:
        return rows.withColumn("own", F.lit(True))
    for width in (back, ahead):
        if isinstance(width, int) and width > layout.chunk_rows:
            raise ValueError("a frame must not reach further than one chunk, see `reaching`")
    back = F.lit(back) if isinstance(back, int) else back
    ahead = F.lit(ahead) if isinstance(ahead, int) else ahead
    home = F.floor(F.col("pos") / layout.chunk_rows)
    place = F.col("pos") % layout.chunk_rows
    has_next = (home + 1) * layout.chunk_rows < F.col(size)
    targets = F.array_compact(
        F.array(
            home,
            F.when((place >= layout.chunk_rows - back) & has_next, home + 1),
            F.when((place < ahead) & (home > 0), home - 1),
        )
    )
    return rows.withColumn("chunk", F.explode(targets)).withColumn("own", F.col("chunk") == home)


def own_rows(rows: DataFrame, layout: Layout) -> DataFrame:
    """Back to one copy of each row, in the layout's own chunk."""
    return rows.filter("own").drop("own").withColumn("chunk", chunk_of("pos", layout))


def reaching(layout: Layout, rows: int) -> Layout:
    """The layout with chunks no shorter than a frame of `rows` rows."""
    return replace(layout, chunk_rows=max(layout.chunk_rows, rows))


def in_chunk(layout: Layout) -> WindowSpec:
    """Rows in order. Whole series use the window they were numbered with, so nothing is sorted again."""
    if layout.whole:
        return Window.partitionBy("series_id").orderBy("timestamp")
    return Window.partitionBy("series_id", "chunk").orderBy("pos")


def all_of_chunk(layout: Layout) -> WindowSpec:
    return in_chunk(layout).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def keep(rows: DataFrame, layout: Layout) -> DataFrame:
    """Rows that are read several times. Cut series are written; whole ones are left to Spark, which
    computes them again from the one shuffle all operators of a panel share."""
    return rows if layout.whole else cut_lineage(rows)


def attach(
    rows: DataFrame,
    stats: DataFrame,
    size: str,
    layout: Layout = DEFAULT,
    also: Sequence[str] = (),
    how: str = "inner",
) -> DataFrame:
    """Join values per series to its rows. With cut series the values (with the series' row count in
    column `size`) are repeated once per chunk, so the join key is as fine as the chunks. `also` names
    further key columns."""
    keys = ["series_id", *also]
    if not layout.whole:
        last = F.greatest(F.floor((F.col(size) - 1) / layout.chunk_rows), F.lit(0))
        stats = stats.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
        keys.append("chunk")
    drop = [c for c in stats.columns if c in rows.columns and c not in keys]
    return rows.join(stats.drop(*drop), keys, how)


def add_totals(
    rows: DataFrame, keys: Sequence[str], totals: dict[str, Column], size: str, layout: Layout = DEFAULT
) -> DataFrame:
    """Add aggregates over all rows of a key (keys start with series_id) to each of its rows."""
    if layout.whole:
        group = Window.partitionBy(*keys)
        return rows.withColumns({name: agg.over(group) for name, agg in totals.items()})
    stats = rows.groupBy(*keys).agg(F.max(size).alias(size), *[agg.alias(n) for n, agg in totals.items()])
    return attach(rows, stats, size, layout, also=[k for k in keys if k != "series_id"])


def chunk_arrays(rows: DataFrame, size: str, back: Column | int, layout: Layout = DEFAULT) -> DataFrame:
    """One row per (series, chunk): the chunk's values in order, led by up to `back` earlier ones.
    An array holds at most chunk_rows + back values."""
    seen = spread(rows, size, back, layout=layout)
    in_order = F.sort_array(F.collect_list(F.struct("pos", "value")))
    return seen.groupBy("series_id", "chunk").agg(
        F.max(size).alias(size), F.transform(in_order, lambda r: r["value"]).alias("values")
    )


def sum_arrays(parts: DataFrame, array: str, layout: Layout = DEFAULT) -> DataFrame:
    """Element-wise sum of one array per chunk over the chunks of a series; the other columns are
    equal in all chunks of a series."""
    keys = [c for c in parts.columns if c not in (array, "chunk")]
    if layout.whole:
        return parts.select(*keys, array)
    by_element = (
        parts.select(*keys, F.posexplode(array).alias("i", "x")).groupBy(*keys, "i").agg(F.sum("x").alias("x"))
    )
    in_order = F.sort_array(F.collect_list(F.struct("i", "x")))
    return by_element.groupBy(*keys).agg(F.transform(in_order, lambda r: r["x"]).alias(array))
