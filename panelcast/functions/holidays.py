"""Holiday calendars. The United States federal calendar is a rule on the date; any other country's
calendar is a user table `country STRING, date DATE`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUILT_IN = ("US",)

# Holidays on a date (month, day, first year) and on a weekday
# (month, weekday with Monday = 0, first possible day, first year).
FIXED_DATES = ((1, 1, 0), (6, 19, 2021), (7, 4, 0), (11, 11, 0), (12, 25, 0))
WEEKDAY_RULES = ((1, 0, 15, 1986), (2, 0, 15, 0), (5, 0, 25, 0), (9, 0, 1, 0), (10, 0, 8, 0), (11, 3, 22, 0))


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def us_federal(date: Column) -> Column:
    """True on a US federal holiday, or on the weekday a weekend holiday is observed on."""

    def fixed(d: Column) -> Column:
        return _any((F.month(d) == m) & (F.day(d) == day) & (F.year(d) >= since) for m, day, since in FIXED_DATES)

    floating = _any(
        (F.month(date) == m)
        & (F.weekday(date) == weekday)
        & F.day(date).between(first, first + 6)
        & (F.year(date) >= since)
        for m, weekday, first, since in WEEKDAY_RULES
    )
    friday_before = (F.weekday(date) == 4) & fixed(F.date_add(date, 1))
    monday_after = (F.weekday(date) == 0) & fixed(F.date_sub(date, 1))
    return fixed(date) | floating | friday_before | monday_after


def holiday_dates(years: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """`country, year, date` of every known holiday in the given years (column `year`)."""
    days = years.select(
        "year",
        F.explode(
            F.sequence(F.make_date("year", F.lit(1), F.lit(1)), F.make_date("year", F.lit(12), F.lit(31)))
        ).alias("date"),
    )
    built_in = days.filter(us_federal(F.col("date"))).select(F.lit("US").alias("country"), "year", "date")
    if calendar is None:
        return built_in
    extra = calendar.select("country", F.year("date").alias("year"), "date").distinct().join(years, "year", "left_semi")
    return built_in.unionByName(extra.select("country", "year", "date").filter(~F.col("country").isin(*BUILT_IN)))
