"""Feature catalog and feature columns.

Two ways to build columns: `apply_features` takes one list of specs for the whole panel and names the
columns after the specs; `slot_features` takes a catalog with different specs per series and fills a
fixed set of slots, because a Spark table cannot have different columns per series.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.frequency import FREQUENCIES, WINDOWS, default_window, per_frequency
from panelcast.functions.holidays import us_federal
from panelcast.operators.layout import DEFAULT, Layout, attach, in_chunk, own_rows, reaching, spread

# Orders and types of features.
FOURIER_ORDERS = (1, 2, 3)
FEATURE_TYPES = ("calendar", "lag", "rolling_stat", "fourier", "holiday")
BROADCAST_DAYS, SALTS = 100_000, 32
PARAMS = "struct<component:string,k:int,window:int,stat:string,order:int,period:int,func:string,country:string>"


@dataclass(frozen=True)
class FeatureSpec:
    name: str
    feature_type: str
    component: str | None = None
    k: int | None = None
    window: int | None = None
    stat: str | None = None
    order: int | None = None
    period: int | None = None
    func: str | None = None
    country: str | None = None
    enabled: bool = True


# ---- single columns -------------------------------------------------------------------------


def calendar_component(component: str, ts: Column, pos: Column) -> Column:
    parts = {
        "day_of_week": F.weekday(ts),
        "is_weekend": (F.weekday(ts) >= 5).cast("int"),
        "month": F.month(ts),
        "quarter": F.quarter(ts),
        "hour_of_day": F.hour(ts),
        "time_index": pos,
    }
    if component not in parts:
        raise ValueError(f"no calendar component {component!r}; known: {sorted(parts)}")
    return parts[component]


def lag(k: int, layout: Layout = DEFAULT) -> Column:
    return F.lag("value", k).over(in_chunk(layout))


def rolling(window: int, stat: str, layout: Layout = DEFAULT) -> Column:
    """Statistic of the `window` rows before the current one; NULL unless all of them have values.

    The frame is summed afresh per row and not as a difference of running sums: one spike would
    cost such a difference all digits of the spread of the rows after it.
    """
    frame = in_chunk(layout).rowsBetween(-window, -1)
    stats = {"mean": F.avg, "std": F.stddev_samp}
    if stat not in stats:
        raise ValueError(f"rolling windows have no statistic {stat!r}; known: {sorted(stats)}")
    return F.when(F.count("value").over(frame) == window, stats[stat]("value").over(frame))


def fourier(order: int, period: Column | int, func: str, pos: Column) -> Column:
    angle = F.lit(2.0) * F.pi() * order * pos / period
    return F.sin(angle) if func == "sin" else F.cos(angle)


def holiday(rows: DataFrame, name: str, country: str, calendar: DataFrame | None = None) -> DataFrame:
    """Add a 0/1 column. The US calendar is an expression; another country's is a join by date."""
    date = F.col("timestamp").cast("date")
    if country == "US":
        return rows.withColumn(name, us_federal(date).cast("int"))
    if calendar is None or calendar.filter(F.col("country") == country).isEmpty():
        raise NotImplementedError(f"no holiday calendar for {country}")
    days = calendar.filter(F.col("country") == country).select(F.col("date").alias("_on")).distinct()
    marked = marked_by(rows.withColumn("_on", date), days, ["_on"], "_hit")
    return marked.withColumn(name, F.coalesce("_hit", F.lit(0))).drop("_on", "_hit")


def marked_by(rows: DataFrame, keys: DataFrame, on: list[str], name: str) -> DataFrame:
    """Add `name`, 1 where the row's `on` is among the distinct `keys`, else NULL. All series share a date, so a calendar that
    a count shows to be small is sent to all tasks, and a larger one is joined with the rows of a key dealt over SALTS."""
    keys = keys.withColumn(name, F.lit(1))
    if keys.count() <= BROADCAST_DAYS:
        return rows.join(F.broadcast(keys), on, "left")
    salted = keys.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("series_id"), F.lit(SALTS)).cast("int"))
    return rows.join(salted, [*on, "_salt"], "left").drop("_salt")


# ---- one spec list for the whole panel ------------------------------------------------------


def apply_features(
    numbered: DataFrame,
    specs: Iterable[FeatureSpec],
    calendar: DataFrame | None = None,
    layout: Layout = DEFAULT,
) -> DataFrame:
    """Input columns plus one column per enabled spec."""
    enabled = [s for s in specs if s.enabled]
    for s in enabled:
        if s.feature_type not in FEATURE_TYPES:
            raise ValueError(f"feature {s.name!r} has the type {s.feature_type!r}; known: {FEATURE_TYPES}")
    back = max([s.k for s in enabled if s.feature_type == "lag"]
               + [s.window for s in enabled if s.feature_type == "rolling_stat"], default=0)
    pos, ts = F.col("pos"), F.col("timestamp")
    past, plain = {}, {}
    for s in enabled:
        if s.feature_type == "lag":
            past[s.name] = lag(s.k, layout)
        elif s.feature_type == "rolling_stat":
            past[s.name] = rolling(s.window, s.stat, layout)
        elif s.feature_type == "calendar":
            plain[s.name] = calendar_component(s.component, ts, pos)
        elif s.feature_type == "fourier":
            plain[s.name] = fourier(s.order, s.period, s.func, pos)
    rows = numbered
    if past:
        rows = own_rows(spread(rows, "n_obs", back, layout=reaching(layout, back)).withColumns(past), layout)
    rows = rows.withColumns(plain)
    for s in enabled:
        if s.feature_type == "holiday":
            rows = holiday(rows, s.name, s.country, calendar)
    return rows.select(*numbered.columns, *[s.name for s in enabled])


def features_long(wide: DataFrame, names: Sequence[str]) -> DataFrame:
    """(series_id, timestamp, name, feature) rows from feature columns."""
    columns = [F.col(n).cast("double").alias(n) for n in names]
    return wide.select("series_id", "timestamp", *columns).unpivot(
        ["series_id", "timestamp"], list(names), "name", "feature"
    )


# ---- catalog --------------------------------------------------------------------------------


def _spec(name: Column | str, feature_type: str, **params) -> Column:
    fields = [f.split(":") for f in PARAMS[len("struct<") : -1].split(",")]
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        as_col(name).alias("name"),
        F.lit(feature_type).alias("feature_type"),
        F.struct(*[as_col(params.get(n)).cast(t).alias(n) for n, t in fields]).alias("params"),
    )


def feature_catalog(profile: DataFrame, holiday_country: str | None = None) -> DataFrame:
    """One row per (series, spec) in catalog order. `profile` holds series_id, frequency, the flags
    trend_detected and seasonality_detected, and seasonality_period."""
    frequency = F.col("frequency")
    components = {c for f in FREQUENCIES.values() for c in f.calendar}
    entry = {c: _spec(f"calendar_{c}", "calendar", component=c) for c in components}
    none = F.array().cast(f"array<struct<name:string,feature_type:string,params:{PARAMS}>>")
    by_frequency = per_frequency(
        {n: F.array(*[entry[c] for c in f.calendar]) for n, f in FREQUENCIES.items() if f.calendar}, frequency
    )
    period = F.when(F.col("seasonality_detected"), F.col("seasonality_period"))
    window = F.when(F.col("seasonality_detected"), F.col("seasonality_period")).otherwise(default_window(frequency))
    waves = [
        _spec(F.concat(F.lit(f"fourier_{func}_{k}_p"), period), "fourier", order=k, period=period, func=func)
        for k in FOURIER_ORDERS
        for func in ("sin", "cos")
    ]
    specs = F.concat(
        F.coalesce(by_frequency, none),
        F.when(F.col("trend_detected"), F.array(_spec("time_index", "calendar", component="time_index"))).otherwise(none),
        F.array(_spec("lag_1", "lag", k=1)),
        F.when(period.isNotNull(), F.array(_spec(F.concat(F.lit("lag_"), period), "lag", k=period))).otherwise(none),
        F.when(
            window > 1,
            F.array(*[
                _spec(F.concat(F.lit(f"rolling_{s}_"), window), "rolling_stat", window=window, stat=s)
                for s in ("mean", "std")
            ]),
        ).otherwise(none),
        F.when(period.isNotNull(), F.array(*waves)).otherwise(none),
        F.array(_spec(f"holiday_{holiday_country}", "holiday", country=holiday_country)) if holiday_country else none,
    )
    return profile.select("series_id", F.posexplode(specs).alias("ord", "spec")).select(
        "series_id", "ord", "spec.name", "spec.feature_type", "spec.params", F.lit(True).alias("enabled")
    )


def toggle(catalog: DataFrame, configs: DataFrame) -> DataFrame:
    """Override `enabled` by a series' `{name: bool}` config; names not in the catalog are ignored."""
    return (
        catalog.join(configs.select("series_id", "config"), "series_id", "left")
        .withColumn("enabled", F.coalesce(F.try_element_at("config", F.col("name")), F.col("enabled")))
        .drop("config")
    )


# ---- a catalog per series -------------------------------------------------------------------

CALENDAR_SLOTS = ("day_of_week", "is_weekend", "month", "quarter", "hour_of_day", "time_index")
WAVE_SLOTS = tuple(f"fourier_{f}_{k}" for k in FOURIER_ORDERS for f in ("sin", "cos"))
SLOTS = (*CALENDAR_SLOTS, "lag_1", "lag_season", "roll_mean", "roll_std", *WAVE_SLOTS, "holiday")


def slot_of() -> Column:
    """The slot a catalog row belongs to."""
    p = F.col("params")
    kind = F.col("feature_type")
    return (
        F.when(kind == "calendar", p["component"])
        .when((kind == "lag") & (F.col("name") == "lag_1"), "lag_1")
        .when(kind == "lag", "lag_season")
        .when(kind == "rolling_stat", F.concat(F.lit("roll_"), p["stat"]))
        .when(kind == "fourier", F.concat(F.lit("fourier_"), p["func"], F.lit("_"), p["order"]))
        .otherwise("holiday")
    )


def slot_plan(catalog: DataFrame) -> DataFrame:
    """One row per series: period, window, holiday country and one `use_<slot>` flag per slot."""
    slot = slot_of()
    flags = [
        F.coalesce(F.bool_or(F.when(slot == s, F.col("enabled"))), F.lit(False)).alias(f"use_{s}") for s in SLOTS
    ]
    return catalog.groupBy("series_id").agg(
        F.max("params.period").alias("period"),
        F.max("params.window").alias("window"),
        F.max("params.country").alias("country"),
        *flags,
    )


def frequency_windows(frequencies: Iterable[str] | None) -> list[int]:
    if frequencies is None:
        return list(WINDOWS)
    known = [FREQUENCIES[f] for f in frequencies]
    return sorted({w for f in known for w in (*f.periods, f.window) if w})


def _holiday_slot(rows: DataFrame, calendar: DataFrame | None) -> DataFrame:
    """0/1 by the country of each series; a country without a calendar stops the job, as a wrong column
    of zeros would go unnoticed."""
    date, country = F.col("timestamp").cast("date"), F.col("country")
    value = F.when(country == "US", us_federal(date).cast("int"))
    if calendar is not None:
        days = calendar.select("country", F.col("date").alias("_on")).distinct()
        rows = marked_by(rows.withColumn("_on", date), days, ["country", "_on"], "_hit")
        rows = marked_by(rows, days.select("country").distinct(), ["country"], "_known").drop("_on")
        value = value.when(F.col("_known") == 1, F.coalesce("_hit", F.lit(0)))
    missing = F.raise_error(F.concat(F.lit("no holiday calendar for "), country)).cast("int")
    value = F.when(F.col("use_holiday"), value.otherwise(missing))
    return rows.withColumn("holiday", value).drop("_hit", "_known")


def slot_features(
    numbered: DataFrame,
    plan: DataFrame,
    frequencies: Iterable[str] | None = None,
    layout: Layout = DEFAULT,
    calendar: DataFrame | None = None,
) -> DataFrame:
    """All slots for all rows; a slot a series does not use, or has switched off, is NULL.

    Frame widths must be constants, so series are handled in one branch per window width. Naming the
    panel's frequencies keeps branches that cannot have rows out of the plan. `calendar` gives the
    holidays of countries other than the US.
    """
    if not layout.whole:
        plan = plan.join(sizes(numbered), "series_id")
    rows = attach(numbered, plan, "n_obs", layout)
    pos, ts = F.col("pos"), F.col("timestamp")

    def branch(part: DataFrame, width: int | None) -> DataFrame:
        past = {"lag_1": lag(1, layout)}
        past["lag_season"] = F.when(F.col("period").isNotNull(), lag(width, layout)) if width else F.lit(None).cast("double")
        for s in ("mean", "std"):
            past[f"roll_{s}"] = rolling(width, s, layout) if width else F.lit(None).cast("double")
        reach = max(1, width or 1)
        return own_rows(spread(part, "n_obs", reach, layout=reaching(layout, reach)).withColumns(past), layout)

    widths = frequency_windows(frequencies)
    parts = [branch(rows.filter(F.col("window") == w), w) for w in widths]
    if frequencies is None or any(FREQUENCIES[f].window is None for f in frequencies):
        parts.append(branch(rows.filter(F.col("window").isNull()), None))
    out = reduce(DataFrame.unionByName, parts)
    plain = {c: calendar_component(c, ts, pos) for c in CALENDAR_SLOTS}
    plain |= {
        f"fourier_{f}_{k}": fourier(k, F.col("period"), f, pos) for k in FOURIER_ORDERS for f in ("sin", "cos")
    }
    out = _holiday_slot(out.withColumns(plain), calendar)
    return out.select(
        *numbered.columns, *[F.when(F.col(f"use_{s}"), F.col(s)).cast("double").alias(s) for s in SLOTS],
        *[f"use_{s}" for s in SLOTS],
    )


def sizes(numbered: DataFrame) -> DataFrame:
    return numbered.groupBy("series_id").agg(F.max("n_obs").alias("n_obs"))
