"""Boosted trees on the engineered features, one model per series and preset.

Rows of a series are brought together as arrays, and a task grows the trees of many series in the same passes (`functions.boosting`). Series
too long for that stay cut: their features are binned once, and every level of a tree is one pass over the chunks that adds up histograms,
the trees of all such series growing in the same passes.

A training row needs all features its series uses; a test row may lack some, behind a gap for example, and is routed by the trees. Forecasts
are one step ahead, because the features of a test row hold the true values before it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.functions.batch import pieces
from panelcast.functions.boosting import Preset, boosted
from panelcast.operators.features import SLOTS
from panelcast.operators.layout import DEFAULT, Layout, add_totals
from panelcast.operators.long_trees import long_forecasts
from panelcast.session import cut_lineage

TREES = 100
# The defaults of the two usual kinds of boosted trees.
PRESETS = {
    "GBT_leaf": Preset(rate=0.1, shrink=0.0, rows=20, leaves=31),
    "GBT_depth": Preset(rate=0.3, shrink=1.0, rows=1, depth=6),
}
LONG = 32_768  # rows of a series from which it stays cut
TOGETHER = 40_000  # rows of the series whose trees grow in the same passes of a task
PER_TASK = 50_000  # rows that a task fits, about
FORECAST = "series_id string, model_name string, step int, predicted double"


def training_table(features: DataFrame, layout: Layout = DEFAULT) -> DataFrame:
    """Feature rows (with is_test) as model input: label and x_<slot> columns, NULL where a series does not use a slot or a row lacks it.
    Training rows are those that know their value and all used features. A series without one cannot be forecast and is left
    out, as is one that uses no feature."""
    complete, any_used = F.col("value").isNotNull(), F.lit(False)
    for s in SLOTS:
        complete = complete & (~F.col(f"use_{s}") | F.col(s).isNotNull())
        any_used = any_used | F.col(f"use_{s}")
    rows = features.withColumn("complete", complete).filter(any_used)
    rows = add_totals(rows, ["series_id"], {"usable": F.count_if(~F.col("is_test") & F.col("complete"))}, "n_obs", layout)
    return rows.filter("usable > 0 AND (is_test OR complete)").select(
        "series_id", "frequency", "timestamp", "step", "is_test", F.col("value").alias("label"),
        *[F.col(s).cast("double").alias(f"x_{s}") for s in SLOTS],
    )


def _fit(presets: dict[str, Preset], trees: int):
    """Forecasts of the series of a task; a row holds all rows of a series."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "rows", TOGETHER):
            held = part.column("rows")
            size = np.asarray(pa.compute.list_value_length(held), dtype=np.int64)
            series, rows = np.repeat(np.arange(len(part)), size), held.flatten()
            test, step, x = np.asarray(rows.field("is_test")), rows.field("step"), rows.field("x")
            y = rows.field("label").to_numpy(zero_copy_only=False).astype(float)
            x = x.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(y), -1)
            x = x[:, ~np.isnan(x).all(axis=0)]
            ids = part.column("series_id").take(pa.array(series[test]))
            for name, found in boosted(x, y, series, ~test, presets, trees).items():
                same = pa.array([name]).take(pa.array(np.zeros(len(ids), np.int64)))
                columns = [ids, same, step.filter(pa.array(test)), pa.array(found[test])]
                yield pa.RecordBatch.from_arrays(columns, ["series_id", "model_name", "step", "predicted"])

    return run


def tree_forecasts(
    table: DataFrame, frequencies: Iterable[str] | None = None, presets: Iterable[str] = tuple(PRESETS), trees: int = TREES, long: int = LONG
) -> DataFrame:
    """(series_id, model_name, step, predicted) of every test row of `table` (see `training_table`). The table is written and counted;
    models of long series take several Spark jobs a tree, those of all others none of their own."""
    if frequencies is not None:
        table = table.filter(F.col("frequency").isin(*frequencies))
    table, chosen = cut_lineage(table), {name: PRESETS[name] for name in presets}
    counts = cut_lineage(table.groupBy("series_id").agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count_if(F.col("n") > long).alias("long")).first()
    rows = table
    if total.long:  # few, as each has more rows than `long`
        ids = counts.filter(F.col("n") > long).select("series_id")
        rows = table.join(ids, "series_id", "left_anti")
    tasks = max(table.sparkSession.sparkContext.defaultParallelism, total.rows // PER_TASK)
    point = F.struct("is_test", "timestamp", "step", "label", F.array(*[f"x_{s}" for s in SLOTS]).alias("x"))
    held = rows.repartition(tasks, "series_id").groupBy("series_id").agg(F.sort_array(F.collect_list(point)).alias("rows"))
    found = held.mapInArrow(_fit(chosen, trees), FORECAST)
    if total.long:
        found = found.unionByName(long_forecasts(table.join(ids, "series_id", "left_semi"), chosen, trees))
    return found
