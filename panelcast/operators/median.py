"""Exact medians of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.operators.layout import DEFAULT, Layout, attach
from panelcast.session import cut_lineage

SKETCH = 10_000  # rank error of the sketch is at most rows / SKETCH


def add_median(
    rows: DataFrame,
    keys: Sequence[str],
    value: str,
    out: str,
    size: str,
    layout: Layout = DEFAULT,
    share: int | str = 1,
) -> DataFrame:
    """Add the median of `value` over all rows of a key to each of them. With cut series the rows
    are written first, because the median reads them several times."""
    if layout.whole:
        return rows.withColumn(out, F.percentile(value, F.lit(0.5)).over(Window.partitionBy(*keys)))
    rows = cut_lineage(rows)
    medians = exact_median(rows, keys, value, size, layout, share).withColumnRenamed("median", out)
    return attach(rows, medians, size, layout, also=[k for k in keys if k != "series_id"])


def exact_median(
    rows: DataFrame, keys: Sequence[str], value: str, size: str, layout: Layout = DEFAULT, share: int | str = 1
) -> DataFrame:
    """Median of `value` per key (keys start with series_id), as numpy gives it.

    `size` is the series' row count and `share` the number of groups it is divided into. Small groups
    are answered by one aggregate. For a large one, a sketch of bounded size brackets the middle
    ranks, rows below the bracket are only counted, and only the distinct values inside it (about
    4 / SKETCH of the rows) are ranked.
    """
    share = F.col(share) if isinstance(share, str) else F.lit(share)
    small = F.col(size) <= layout.group_rows * share
    direct = rows.filter(small).groupBy(*keys).agg(
        F.max(size).alias(size), F.percentile(value, F.lit(0.5)).alias("median")
    )

    large = rows.filter(~small)
    edges = F.percentile_approx(value, [0.5 - 2 / SKETCH, 0.5 + 2 / SKETCH], SKETCH)
    bracket = large.groupBy(*keys).agg(F.max(size).alias(size), edges.alias("_edges"))
    bracket = bracket.withColumns({"_low": F.col("_edges")[0], "_high": F.col("_edges")[1]}).drop("_edges")
    marked = attach(large, bracket, size, layout, also=[k for k in keys if k != "series_id"])

    v = F.col(value)
    counts = marked.groupBy(*keys).agg(
        F.max(size).alias(size), F.count(v).alias("_n"), F.count(F.when(v < F.col("_low"), v)).alias("below")
    )
    inside = marked.filter(v.between(F.col("_low"), F.col("_high"))).groupBy(*keys, v.alias("v")).agg(
        F.count(F.lit(1)).alias("times")
    )
    upto = Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = inside.withColumn("upto", F.sum("times").over(upto)).join(counts, list(keys))
    rank = F.col("below") + F.col("upto")
    lower, upper = F.floor((F.col("_n") + 1) / 2), F.ceil((F.col("_n") + 1) / 2)
    wide = ranked.groupBy(*keys).agg(
        F.max(size).alias(size),
        ((F.min(F.when(rank >= lower, F.col("v"))) + F.min(F.when(rank >= upper, F.col("v")))) / 2).alias("median"),
    )
    return direct.unionByName(wide)
