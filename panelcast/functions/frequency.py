"""The frequency domain: six step sizes and everything that depends only on the step size.

All calendar arithmetic here stays on DATE / TIMESTAMP_NTZ, so no result depends on the session
time zone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Frequency:
    name: str
    step_days: int  # shortest length of one step in days; 0 = hourly
    periods: tuple[int, ...]  # candidate seasonal periods, in order of preference
    window: int | None  # rolling window when no period is detected
    calendar: tuple[str, ...]  # calendar components offered as features


# The frequency domain of the reference.
FREQUENCIES: dict[str, Frequency] = {
    f.name: f
    for f in (
        Frequency("Yearly", 365, (), None, ()),
        Frequency("Quarterly", 90, (4,), 4, ("quarter",)),
        Frequency("Monthly", 28, (12,), 12, ("month",)),
        Frequency("Weekly", 7, (52,), 4, ("month",)),
        Frequency("Daily", 1, (7, 30, 365), 7, ("day_of_week", "is_weekend")),
        Frequency("Hourly", 0, (24, 168), 24, ("hour_of_day", "day_of_week")),
    )
}
ANCHOR = "2013-01-01"

PERIODS = sorted({p for f in FREQUENCIES.values() for p in f.periods})
WINDOWS = sorted({f.window for f in FREQUENCIES.values() if f.window} | set(PERIODS))


def per_frequency(values: dict[str, Column | None], frequency: Column | str = "frequency") -> Column:
    """One value per known frequency, NULL for an unknown one."""
    frequency = F.col(frequency) if isinstance(frequency, str) else frequency
    out = None
    for name, value in values.items():
        if value is None:
            continue
        out = F.when(frequency == name, value) if out is None else out.when(frequency == name, value)
    return out


def day_number(ts: Column) -> Column:
    return F.date_diff(ts.cast("date"), F.lit("1970-01-01").cast("date"))


def time_of_day(ts: Column) -> Column:
    """Time past midnight as a day-time interval."""
    return ts - ts.cast("date").cast("timestamp_ntz")


def floor_to_step(ts: Column, frequency: str) -> Column:
    """Label of the step a timestamp falls in; a week is labelled by the Sunday that ends it."""
    day = ts.cast("date")
    if frequency == "Hourly":
        return day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.hour(ts))
    label = {
        "Daily": day,
        "Weekly": next_sunday(day),
        "Monthly": F.trunc(day, "month"),
        "Quarterly": F.trunc(day, "quarter"),
        "Yearly": F.trunc(day, "year"),
    }[frequency]
    return label.cast("timestamp_ntz")


def next_sunday(day: Column) -> Column:
    """The day itself when it is a Sunday, else the Sunday after it."""
    return F.next_day(F.date_sub(day, 1), "SUN")


def _next_start(day: Column, unit: str, months: int) -> Column:
    start = F.trunc(day, unit)
    return F.when(start == day, day).otherwise(F.add_months(start, months))


def first_on_grid(ts: Column, frequency: Column | str = "frequency") -> Column:
    """First grid point at or after ts; the time of day is kept."""
    day = ts.cast("date")
    moved = per_frequency(
        {
            "Weekly": next_sunday(day),
            "Monthly": _next_start(day, "month", 1),
            "Quarterly": _next_start(day, "quarter", 3),
            "Yearly": _next_start(day, "year", 12),
        },
        frequency,
    )
    return F.coalesce(moved.cast("timestamp_ntz") + time_of_day(ts), ts)


def on_anchor(ts: Column, frequency: Column | str = "frequency") -> Column:
    """Whether the date can be a grid point at all (Sunday, first of the month, ...)."""
    day = ts.cast("date")
    anchored = per_frequency(
        {
            "Weekly": F.weekday(day) == 6,
            "Monthly": F.trunc(day, "month") == day,
            "Quarterly": F.trunc(day, "quarter") == day,
            "Yearly": F.trunc(day, "year") == day,
        },
        frequency,
    )
    return F.coalesce(anchored, F.lit(True))


def step_phase(ts: Column, frequency: Column | str = "frequency") -> Column:
    """Where inside a step the timestamp lies; equal for all points of one grid."""
    into_day = time_of_day(ts)
    into_hour = into_day - F.make_dt_interval(F.lit(0), F.hour(ts))
    return F.coalesce(per_frequency({"Hourly": into_hour}, frequency), into_day)


def steps_between(start: Column, end: Column, frequency: Column | str = "frequency") -> Column:
    """Whole steps from start to end (both inclusive count is this plus one)."""
    days = F.timestamp_diff("DAY", start, end)
    months = F.timestamp_diff("MONTH", start, end)
    return per_frequency(
        {
            "Hourly": F.timestamp_diff("HOUR", start, end),
            "Daily": days,
            "Weekly": F.floor(days / 7),
            "Monthly": months,
            "Quarterly": F.floor(months / 3),
            "Yearly": F.floor(months / 12),
        },
        frequency,
    ).cast("bigint")


def add_steps(start: Column, steps: Column, frequency: Column | str = "frequency") -> Column:
    n = steps.cast("int")
    return per_frequency(
        {
            "Hourly": start + F.make_dt_interval(F.lit(0), n),
            "Daily": start + F.make_dt_interval(n),
            "Weekly": start + F.make_dt_interval(n * 7),
            "Monthly": start + F.make_ym_interval(F.lit(0), n),
            "Quarterly": start + F.make_ym_interval(F.lit(0), n * 3),
            "Yearly": start + F.make_ym_interval(n),
        },
        frequency,
    )


def candidate_periods(frequency: Column | str = "frequency") -> Column:
    """Array of candidate periods, empty for an unknown frequency."""
    known = per_frequency(
        {n: F.array(*[F.lit(p) for p in f.periods]) for n, f in FREQUENCIES.items() if f.periods}, frequency
    )
    return F.coalesce(known, F.array().cast("array<int>"))


def default_window(frequency: Column | str = "frequency") -> Column:
    return per_frequency({n: F.lit(f.window) for n, f in FREQUENCIES.items() if f.window}, frequency)
