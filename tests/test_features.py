import datetime as dt

import numpy as np
import pytest
from conftest import by_id
from pyspark.sql import functions as F

from panelcast.functions.holidays import us_federal
from panelcast.operators.features import (
    FeatureSpec, apply_features, calendar_component, feature_catalog, rolling, slot_features, slot_plan, toggle,
)
from panelcast.operators.layout import Layout, number_rows
from panelcast.operators.ols import design, ols, residuals

WHOLE = Layout(whole=True)


def built(panel, *specs, **kw):
    wide = apply_features(number_rows(panel), specs, **kw)
    return wide.orderBy("timestamp").toPandas()


def test_weekday_and_weekend(make_panel):
    out = built(
        make_panel({"a": np.arange(14.0)}),
        FeatureSpec("dow", "calendar", component="day_of_week"),
        FeatureSpec("weekend", "calendar", component="is_weekend"),
    )
    assert out.dow[0] == 2  # 2020-01-01 is a Wednesday
    assert (out.weekend == out.dow.isin([5, 6]).astype(int)).all()


def test_time_index_and_lag(make_panel):
    out = built(
        make_panel({"a": np.arange(10.0)}),
        FeatureSpec("time_index", "calendar", component="time_index"),
        FeatureSpec("lag_1", "lag", k=1),
    )
    assert out.time_index.tolist() == list(range(10))
    assert np.isnan(out.lag_1[0]) and out.lag_1[1:].tolist() == list(range(9))


def test_rolling_leaves_out_the_current_row(make_panel):
    out = built(
        make_panel({"a": [1, 2, 3, 4, 5]}), FeatureSpec("m", "rolling_stat", window=2, stat="mean")
    )
    assert out.m.isna().tolist() == [True, True, False, False, False] and out.m[2] == pytest.approx(1.5)


def test_rolling_after_a_spike_and_over_a_gap(make_panel):
    values = np.array([1, 1.1, 1.2, 1e12, 1, 1.1, 1.2, 1.3, np.nan, 1, 1, 1, 1.0])
    out = built(make_panel({"a": values}), FeatureSpec("s", "rolling_stat", window=3, stat="std"))
    want = [
        np.std(values[i - 3 : i], ddof=1) if i >= 3 and not np.isnan(values[i - 3 : i]).any() else np.nan
        for i in range(len(values))
    ]
    np.testing.assert_allclose(out.s, want, rtol=1e-9)


def test_fourier(make_panel):
    out = built(make_panel({"a": np.zeros(8)}), FeatureSpec("f", "fourier", order=1, period=4, func="sin"))
    np.testing.assert_allclose(out.f, [0, 1, 0, -1, 0, 1, 0, -1], atol=1e-9)


def test_us_holiday(make_panel):
    out = built(make_panel({"a": np.zeros(10)}, start="2019-12-30"), FeatureSpec("h", "holiday", country="US"))
    assert out.set_index("timestamp").h["2020-01-01"] == 1 and out.set_index("timestamp").h["2019-12-31"] == 0


def test_other_calendars_come_from_a_table(spark, make_panel):
    calendar = spark.createDataFrame([("AT", dt.date(2020, 1, 6))], "country string, date date")
    out = built(make_panel({"a": np.zeros(10)}), FeatureSpec("h", "holiday", country="AT"), calendar=calendar)
    assert out.h.tolist() == [0] * 5 + [1] + [0] * 4
    with pytest.raises(NotImplementedError):
        built(make_panel({"a": np.zeros(10)}), FeatureSpec("h", "holiday", country="ZZ"))


def test_federal_holidays_of_some_years(spark):
    days = spark.sql("SELECT explode(sequence(DATE'2020-12-01', DATE'2022-01-31')) AS d")
    got = {r.d for r in days.filter(us_federal(F.col("d"))).collect()}
    want = """2020-12-25 2021-01-01 2021-01-18 2021-02-15 2021-05-31 2021-06-18 2021-06-19 2021-07-04 2021-07-05
      2021-09-06 2021-10-11 2021-11-11 2021-11-25 2021-12-24 2021-12-25 2021-12-31 2022-01-01 2022-01-17"""
    assert got == {dt.date.fromisoformat(d) for d in want.split()}


def test_disabled_and_unknown(make_panel):
    panel = make_panel({"a": np.arange(10.0)})
    assert "lag_1" not in built(panel, FeatureSpec("lag_1", "lag", k=1, enabled=False)).columns
    with pytest.raises(ValueError):
        built(panel, FeatureSpec("x", "wavelet"))
    with pytest.raises(ValueError):
        calendar_component("moon", F.col("timestamp"), F.col("pos"))
    with pytest.raises(ValueError):
        rolling(3, "median")


def profile_rows(spark, *rows):
    return spark.createDataFrame(
        rows, "series_id string, frequency string, trend_detected boolean, seasonality_detected boolean, seasonality_period int"
    )


def test_catalog(spark):
    flags = profile_rows(
        spark,
        ("trend", "Daily", True, False, None),
        ("season", "Daily", False, True, 30),
        ("year", "Yearly", False, False, None),
        ("hour", "Hourly", True, True, 24),
        ("odd", "Lunar", False, False, None),
    )
    names = {}
    for r in feature_catalog(flags, "US").orderBy("series_id", "ord").collect():
        names.setdefault(r.series_id, []).append(r.name)
    day = ["calendar_day_of_week", "calendar_is_weekend"]
    waves = lambda p: [f"fourier_{f}_{k}_p{p}" for k in (1, 2, 3) for f in ("sin", "cos")]
    assert names["trend"] == [*day, "time_index", "lag_1", "rolling_mean_7", "rolling_std_7", "holiday_US"]
    assert names["season"] == [*day, "lag_1", "lag_30", "rolling_mean_30", "rolling_std_30", *waves(30), "holiday_US"]
    assert names["year"] == ["lag_1", "holiday_US"]
    assert names["hour"][:4] == ["calendar_hour_of_day", "calendar_day_of_week", "time_index", "lag_1"]
    assert names["odd"] == ["lag_1", "holiday_US"]


def test_toggle(spark):
    flags = profile_rows(spark, ("a", "Daily", False, True, 7), ("b", "Daily", False, True, 7))
    configs = spark.createDataFrame([("a", {"lag_1": False, "nothing": False})], "series_id string, config map<string,boolean>")
    out = {(r.series_id, r.name): r.enabled for r in toggle(feature_catalog(flags), configs).collect()}
    assert out[("a", "lag_1")] is False and out[("a", "lag_7")] is True and out[("b", "lag_1")] is True
    assert ("a", "nothing") not in out


def test_holiday_slot_follows_the_country(spark, make_panel):
    panel = make_panel({"us": np.arange(30.0), "at": np.arange(30.0)})
    flags = profile_rows(spark, ("us", "Daily", False, False, None), ("at", "Daily", False, False, None))
    us, at = (feature_catalog(flags.filter(f"series_id = '{c.lower()}'"), c) for c in ("US", "AT"))
    plan = slot_plan(us.unionByName(at))
    calendar = spark.createDataFrame([("AT", dt.date(2020, 1, 6))], "country string, date date")
    out = slot_features(number_rows(panel, WHOLE), plan, ["Daily"], WHOLE, calendar)
    days = {(r.series_id, r.timestamp.day) for r in out.filter("holiday = 1").collect()}
    assert days == {("us", 1), ("us", 20), ("at", 6)}
    with pytest.raises(Exception, match="no holiday calendar for AT"):
        slot_features(number_rows(panel, WHOLE), plan, ["Daily"], WHOLE).collect()


def test_regression_residuals_against_lstsq(spark, make_panel):
    """All features of a series with trend and quarter season, collinear waves included."""
    gen = np.random.default_rng(8)
    values = 1000 + 0.5 * np.arange(80) + 5 * np.sin(np.pi * np.arange(80) / 2) + gen.normal(size=80)
    panel = make_panel({"q": values, "w": values * 3 + gen.normal(size=80)}, "Quarterly")
    flags = profile_rows(spark, *[(s, "Quarterly", True, True, 4) for s in "qw"])
    catalog = feature_catalog(flags)
    wide = slot_features(number_rows(panel, WHOLE), slot_plan(catalog), ["Quarterly"], WHOLE).cache()
    x = design(wide, WHOLE)
    fits = ols(x)
    left = residuals(x, fits, WHOLE).toPandas()
    r2 = by_id(fits)
    used = ["quarter", "time_index", "lag_1", "lag_season", "roll_mean", "roll_std"]
    used += [f"fourier_{f}_{k}" for k in (1, 2, 3) for f in ("sin", "cos")]
    for name, g in wide.toPandas().groupby("series_id"):
        g = g.sort_values("timestamp").dropna(subset=used)
        a = g[used].to_numpy(float)
        a, y = a - a.mean(axis=0), (g.value - g.value.mean()).to_numpy()
        beta, *_ = np.linalg.lstsq(a, y, rcond=1e-10)
        want = y - a @ beta
        got = left[left.series_id == name].sort_values("timestamp").value
        np.testing.assert_allclose(got, want, atol=1e-6)
        assert r2[name].r_squared == pytest.approx(1 - (want**2).sum() / (y**2).sum(), abs=1e-9)
