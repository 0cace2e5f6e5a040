"""Seasonal decomposition, its strengths, the best period, and outliers of what is left.

The decomposition is the classical one: centred moving average as trend, median per phase as season.
It differs from the robust local regression of the reference in the smoother only; the strengths are
the same ratios of variances.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.frequency import FREQUENCIES
from panelcast.operators.layout import DEFAULT, Layout, add_totals, all_of_chunk, attach, in_chunk, own_rows, reaching, spread
from panelcast.operators.median import add_median

STRENGTH_CUT = 0.3
MIN_CYCLES = 4
Z_CUT = 3.5
MAD_TO_SD = 0.6745


def _detrended(clean: DataFrame, period: int, names: list[str], min_cycles: int, layout: Layout) -> DataFrame:
    """value minus centred moving average, for the series that have this candidate period."""
    h = period // 2
    rows = clean.filter(F.col("frequency").isin(names) & (F.col("n") >= min_cycles * period))
    rows = spread(rows, "n", 2 * h, h, reaching(layout, 2 * h + 1))
    w, whole = in_chunk(layout), all_of_chunk(layout)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("level", F.avg("value").over(whole))
    rows = rows.withColumn("through", F.sum(F.col("value") - F.col("level")).over(upto))
    rows = rows.withColumn("until", F.col("through") - (F.col("value") - F.col("level")))
    ahead, behind = (lambda c: F.lead(c, h).over(w)), (lambda c: F.lag(c, h).over(w))
    if period % 2:
        total = ahead("through") - behind("until")
    else:
        total = (ahead("through") - behind("through") + ahead("until") - behind("until")) / 2
    inner = F.col("pos").between(h, F.col("n") - 1 - h)
    rows = rows.withColumn("average", F.when(inner, F.col("level") + total / period))
    trend = (
        F.when(F.col("pos") < h, F.first("average", ignorenulls=True).over(whole))
        .when(F.col("pos") > F.col("n") - 1 - h, F.last("average", ignorenulls=True).over(whole))
        .otherwise(F.col("average"))
    )
    return own_rows(rows.withColumn("trend", trend), layout).select(
        "series_id",
        F.lit(period).alias("period"),
        "chunk",
        "pos",
        "n",
        "timestamp",
        "value",
        (F.col("value") - F.col("trend")).alias("detrended"),
        (F.col("pos") % period).cast("int").alias("phase"),
    )


def decompose(
    clean: DataFrame, frequencies: Iterable[str] | None = None, min_cycles: int = MIN_CYCLES, layout: Layout = DEFAULT
) -> DataFrame:
    """Rows of `clean` per candidate period with `detrended`, `season` and `resid`. One branch per
    period, because frame widths must be constants; `frequencies` keeps unused ones out."""
    wanted = FREQUENCIES if frequencies is None else {f: FREQUENCIES[f] for f in frequencies}
    users: dict[int, list[str]] = {}
    for name, f in wanted.items():
        for p in f.periods:
            users.setdefault(p, []).append(name)
    if not users:
        users = {4: ["Quarterly"]}
    parts = [_detrended(clean, p, names, min_cycles, layout) for p, names in sorted(users.items())]
    rows = reduce(DataFrame.unionByName, parts)

    rows = add_median(rows, ["series_id", "period", "phase"], "detrended", "middle", "n", layout, share="period")
    # the mean of the phase medians: each row carries its phase's median over the phase's row count
    in_phase = F.floor((F.col("n") - 1 - F.col("phase")) / F.col("period")) + 1
    rows = add_totals(
        rows.withColumn("part", F.col("middle") / in_phase / F.col("period")),
        ["series_id", "period"], {"centre": F.sum("part")}, "n", layout,
    )
    return (
        rows.withColumn("season", F.col("middle") - F.col("centre"))
        .withColumn("resid", F.col("detrended") - F.col("season"))
        .drop("middle", "part", "centre", "phase")
    )


def strengths(parts: DataFrame) -> DataFrame:
    """Seasonal and trend strength per (series, period)."""
    sums = parts.groupBy("series_id", "period").agg(
        F.var_pop("resid").alias("r"),
        F.var_pop("detrended").alias("rs"),  # resid + season
        F.var_pop(F.col("value") - F.col("season")).alias("rt"),  # resid + trend
    )
    ratio = lambda whole: F.when(
        F.col(whole) > 0, F.greatest(F.lit(0.0), 1 - F.col("r") / F.col(whole))
    ).otherwise(F.lit(0.0))
    return sums.select(
        "series_id", "period", ratio("rs").alias("seasonal_strength"), ratio("rt").alias("trend_strength")
    )


def best_period(clean: DataFrame, strength: DataFrame) -> DataFrame:
    """detected, period, strength for every series; the largest strength wins, the shorter period on
    a tie, and a period counts only from STRENGTH_CUT on (tested before rounding)."""
    order = F.struct("seasonal_strength", -F.col("period"))
    best = strength.groupBy("series_id").agg(
        F.max("seasonal_strength").alias("s"), F.max_by("period", order).alias("p")
    )
    found = F.coalesce(F.col("s") >= STRENGTH_CUT, F.lit(False))
    series = clean.groupBy("series_id").agg(F.max("n").alias("n"))
    return series.join(best, "series_id", "left").select(
        "series_id",
        "n",
        found.alias("detected"),
        F.when(found, F.col("p")).alias("period"),
        F.coalesce(F.bround("s", 4), F.lit(0.0)).alias("strength"),
    )


def outlier_signal(clean: DataFrame, parts: DataFrame, season: DataFrame, layout: Layout = DEFAULT) -> DataFrame:
    """The seasonal residual where a season was detected, else the value."""
    chosen = season.select("series_id", "n", F.col("period").alias("best"))
    plain = attach(clean, chosen.filter("best IS NULL"), "n", layout)
    seasonal = attach(
        parts, chosen.filter("best IS NOT NULL").withColumnRenamed("best", "period"), "n", layout, also=["period"]
    )
    cols = ["series_id", "chunk", "pos", "n", "timestamp"]
    return plain.select(*cols, F.col("value").alias("signal")).unionByName(
        seasonal.select(*cols, F.col("resid").alias("signal"))
    )


def robust_z(signal: DataFrame, layout: Layout = DEFAULT) -> DataFrame:
    """Signal rows with z = 0.6745 (x - median) / MAD, 0 where the MAD is 0."""
    rows = add_median(signal, ["series_id"], "signal", "middle", "n", layout)
    rows = rows.withColumn("off", F.abs(F.col("signal") - F.col("middle")))
    rows = add_median(rows, ["series_id"], "off", "mad", "n", layout)
    z = F.when(F.col("mad") > 0, MAD_TO_SD * (F.col("signal") - F.col("middle")) / F.col("mad")).otherwise(F.lit(0.0))
    return rows.select("series_id", "chunk", "timestamp", "signal", z.alias("z"))


def outlier_points(scored: DataFrame) -> DataFrame:
    return scored.filter(F.abs("z") > Z_CUT).select("series_id", "timestamp", "signal", "z")


def outlier_counts(scored: DataFrame, n_obs: DataFrame) -> DataFrame:
    """count and share of all rows of the series, those without a value included."""
    hits = scored.groupBy("series_id").agg(F.count_if(F.abs("z") > Z_CUT).alias("hits"))
    count = F.coalesce("hits", F.lit(0))
    return n_obs.join(hits, "series_id", "left").select(
        "series_id", count.alias("count"), (count / F.col("n_obs")).alias("pct")
    )
