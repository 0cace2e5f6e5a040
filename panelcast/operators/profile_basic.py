"""Missing data, intermittency and linear trend: plain aggregates, no window."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.sources.panel import grid_span

# Limits of the demand classes.
ADI_CUT = 1.32
CV2_CUT = 0.49

# Two-sided 5 % points of Student's t for 1..30 degrees of freedom.
T_975 = (
    12.7062047362, 4.3026527297, 3.1824463053, 2.7764451052, 2.5705818356, 2.4469118511,
    2.3646242516, 2.3060041352, 2.2621571628, 2.2281388520, 2.2009851601, 2.1788128297,
    2.1603686565, 2.1447866879, 2.1314495456, 2.1199052992, 2.1098155778, 2.1009220402,
    2.0930240544, 2.0859634473, 2.0796138447, 2.0738730679, 2.0686576104, 2.0638985616,
    2.0595385528, 2.0555294386, 2.0518305165, 2.0484071418, 2.0452296421, 2.0422724563,
)
Z_975 = 1.959963985


def missing(panel: DataFrame) -> DataFrame:
    """Grid points without a value, counted from the grid's closed-form length."""
    absent = F.col("expected_n") - F.col("present")
    return grid_span(panel).select(
        "series_id",
        "expected_n",
        F.when(F.col("expected_n") > 0, absent).otherwise(F.lit(0)).alias("missing_count"),
        F.when(F.col("expected_n") > 0, absent / F.col("expected_n")).otherwise(F.lit(0.0)).alias("missing_pct"),
    )


def intermittency(panel: DataFrame) -> DataFrame:
    demand = F.when(F.col("value") != 0, F.col("value"))
    sums = panel.groupBy("series_id").agg(
        F.count("value").alias("n"),
        F.count(demand).alias("nonzero"),
        F.stddev_pop(demand).alias("sd"),
        F.avg(demand).alias("mean"),
    )
    n, nonzero = F.col("n"), F.col("nonzero")
    adi = F.when(nonzero > 0, n / nonzero).otherwise(F.lit(math.inf))
    cv2 = F.when((nonzero > 0) & (F.col("mean") != 0), F.pow(F.col("sd") / F.col("mean"), 2)).otherwise(F.lit(0.0))
    rare, erratic = F.col("adi") >= ADI_CUT, F.col("cv2") >= CV2_CUT
    category = (
        F.when(~rare & ~erratic, "smooth")
        .when(rare & ~erratic, "intermittent")
        .when(~rare & erratic, "erratic")
        .otherwise("lumpy")
    )
    return (
        sums.select(
            "series_id",
            F.when(n > 0, (n - nonzero) / n).otherwise(F.lit(0.0)).alias("zero_pct"),
            adi.alias("adi"),
            cv2.alias("cv2"),
        )
        .withColumn("category", category)
        .withColumn("is_intermittent", F.col("category").isin("intermittent", "lumpy"))
    )


def t_critical(df: Column) -> Column:
    """97.5 % point of Student's t: exact to 30 degrees of freedom, Cornish-Fisher series above."""
    z = Z_975
    terms = (
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
    )
    v = df.cast("double")
    series = F.lit(z) + terms[0] / v + terms[1] / (v * v) + terms[2] / (v * v * v)
    exact = F.get(F.array(*[F.lit(t) for t in T_975]), (df - 1).cast("int"))
    return F.when(df < 1, F.lit(math.inf)).when(df <= len(T_975), exact).otherwise(series)


def trend(clean: DataFrame) -> DataFrame:
    """Least squares of the value on its position (`clean` as given by layout.compact)."""
    fit = clean.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope("value", "pos").alias("slope"),
        F.regr_r2("value", "pos").alias("r2"),
        (F.max("value") == F.min("value")).alias("constant"),
    )
    n, r2 = F.col("n"), F.least(F.col("r2"), F.lit(1.0))
    usable = (n >= 2) & ~F.col("constant")
    perfect = (n == 2) | (r2 >= 1.0)
    df = n - 2
    t = F.sqrt(r2) * F.sqrt(df / F.when(r2 < 1.0, 1 - r2))
    return fit.select(
        "series_id",
        F.when(usable, F.when(perfect, F.lit(True)).otherwise(t > t_critical(df))).otherwise(F.lit(False)).alias("detected"),
        F.when(usable, F.col("slope")).otherwise(F.lit(0.0)).alias("slope"),
        F.when(usable, r2).otherwise(F.lit(0.0)).alias("strength"),
    )
