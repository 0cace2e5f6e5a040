"""Cut and whole series give the same results, for every operator that has a layout."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelcast.operators import arima as A
from panelcast.operators import season as S
from panelcast.operators import smoothing as M
from panelcast.operators import unit_root as U
from panelcast.operators.features import FeatureSpec, apply_features, feature_catalog, slot_features, slot_plan
from panelcast.operators.layout import Layout, by_length, compact, number_rows
from panelcast.operators.median import exact_median
from panelcast.operators.ols import design, ols, residuals
from panelcast.plans.profile import profile_numbered
from panelcast.operators.trees import training_table
from panelcast.operators.scores import holdout

WHOLE = Layout(chunk_rows=10_000, whole=True)
CUT = Layout(chunk_rows=128, block_steps=100, group_rows=20)


@pytest.fixture(scope="module")
def panel(make_panel):
    rng = np.random.default_rng(5)

    def wave(n, trend=0.0, noise=1.0):
        t = np.arange(n)
        return 20 + trend * t + 5 * np.sin(2 * np.pi * t / 7) + rng.normal(scale=noise, size=n)

    long = wave(1030, 0.01)
    long[rng.choice(1030, 60, replace=False)] = np.nan
    stamps = pd.date_range("2018-03-01", periods=1300, freq="D")[np.sort(rng.choice(1300, 1030, replace=False))]
    walk = np.cumsum(rng.normal(size=700))
    spiky = rng.normal(size=513)
    spiky[[100, 300, 500]] += 60
    return make_panel(
        {
            "long": (stamps, long),
            "walk": walk,
            "spiky": spiky,
            "edge": wave(128),
            "edge1": wave(129),
            "short": wave(40),
            "tiny": np.array([1.0, 2.0, 4.0, 3.0, 5.0]),
            "flat": np.full(150, 3.0),
            "years": wave(1500),
            "zeros": np.where(np.arange(300) % 9 == 0, rng.normal(4, 0.3, 300), 0.0),
        }
    ).cache()


def same(left, right, keys, tolerance=1e-7):
    a, b = (df.toPandas().sort_values(keys).reset_index(drop=True) for df in (left, right))
    assert len(a) == len(b) and set(a.columns) == set(b.columns)
    for c in a.columns:
        if a[c].dtype.kind == "f" or b[c].dtype.kind == "f":
            np.testing.assert_allclose(
                a[c].astype(float), b[c].astype(float), rtol=tolerance, atol=tolerance, err_msg=c
            )
        else:
            assert a[c].astype(str).tolist() == b[c].astype(str).tolist(), c
    return a


def both(panel, run, keys=("series_id",), tolerance=1e-7):
    return same(run(panel, WHOLE), run(panel, CUT), list(keys), tolerance)


def clean(rows, layout):
    return compact(number_rows(rows, layout), layout)


def test_positions(panel):
    out = both(panel, lambda r, l: number_rows(r, l).drop("chunk"), ["series_id", "timestamp"])
    for _, g in out.groupby("series_id"):
        g = g.sort_values("timestamp")
        assert g.pos.tolist() == list(range(len(g)))
        assert g.cpos.dropna().tolist() == list(range(int(g.value.notna().sum())))
        assert (g.n_obs == len(g)).all() and (g.n_clean == g.value.notna().sum()).all()


def test_features(panel):
    specs = [
        FeatureSpec("lag_1", "lag", k=1),
        FeatureSpec("lag_100", "lag", k=100),
        FeatureSpec("rolling_mean_30", "rolling_stat", window=30, stat="mean"),
        FeatureSpec("rolling_std_128", "rolling_stat", window=128, stat="std"),
    ]
    keep = ["series_id", "timestamp", *[s.name for s in specs]]
    out = both(panel, lambda r, l: apply_features(number_rows(r, l), specs, layout=l).select(*keep), keep[:2])
    source = panel.filter("series_id = 'long'").orderBy("timestamp").toPandas()
    got = out[out.series_id == "long"].sort_values("timestamp")
    np.testing.assert_allclose(got.lag_100, source.value.shift(100))
    np.testing.assert_allclose(got.rolling_mean_30, source.value.shift(1).rolling(30).mean())
    np.testing.assert_allclose(got.rolling_std_128, source.value.shift(1).rolling(128).std())


def test_frame_wider_than_a_chunk(panel):
    specs = [FeatureSpec("lag_200", "lag", k=200), FeatureSpec("rolling_mean_365", "rolling_stat", window=365, stat="mean")]
    both(panel, lambda r, l: apply_features(number_rows(r, l), specs, layout=l).drop("chunk"), ["series_id", "timestamp"])


def test_median_brackets(panel):
    rows = clean(panel, CUT)
    ties = rows.withColumn("value", F.floor("value").cast("double"))
    for source in (rows, ties):
        got = {r.series_id: r["median"] for r in exact_median(source, ["series_id"], "value", "n", CUT).collect()}
        want = source.toPandas().groupby("series_id").value.median().to_dict()
        assert got == pytest.approx(want)


def test_decomposition(panel):
    def run(r, l):
        return S.decompose(clean(r, l), ["Daily"], layout=l).drop("chunk")

    both(panel, run, ["series_id", "period", "pos"])


def test_season_and_outliers(panel):
    def run(r, l):
        c = clean(r, l)
        parts = S.decompose(c, ["Daily"], layout=l)
        season = S.best_period(c, S.strengths(parts))
        return S.robust_z(S.outlier_signal(c, parts, season, l), l).drop("chunk")

    out = both(panel, run, ["series_id", "timestamp"])
    found = out[(out.z.abs() > 3.5) & (out.series_id == "spiky")]
    assert len(found) >= 3


def test_kpss_and_adf(panel):
    both(panel, lambda r, l: U.kpss(clean(r, l), l))
    both(panel, lambda r, l: U.adf(clean(r, l), layout=l))


def test_regression(panel):
    flags = panel.select("series_id", "frequency").distinct().select(
        "*", F.lit(True).alias("trend_detected"), F.lit(True).alias("seasonality_detected"), F.lit(7).alias("seasonality_period")
    )
    plan = slot_plan(feature_catalog(flags))

    def run(r, l):
        x = design(slot_features(number_rows(r, l), plan, ["Daily"], l), l)
        return residuals(x, ols(x), l)

    both(panel, run, ["series_id", "timestamp"], 1e-6)

    def table(r, l):
        t = training_table(holdout(slot_features(number_rows(r, l), plan, ["Daily"], l)), l)
        return t.select("series_id", "timestamp", "label", "is_test", "x_lag_1", "x_roll_std")

    both(panel, table, ["series_id", "timestamp"])


@pytest.mark.parametrize("fan", [256, 2])
def test_smoothing(panel, fan, monkeypatch):
    monkeypatch.setattr(M, "FAN", fan)
    out = both(panel, lambda r, l: M.smoothing_fits(clean(r, l), l), tolerance=1e-6)
    assert set(out.series_id) >= {"long", "tiny", "flat"}


def test_arima(panel):
    horizons = panel.select("series_id").distinct().withColumn("horizon", F.lit(8))
    out = both(
        panel,
        lambda r, l: A.arima_forecasts(A.arima(clean(r, l), horizons, layout=l)),
        ["series_id", "step"],
        1e-5,
    )
    assert out.groupby("series_id").size().eq(8).all()
    assert np.isfinite(out.predicted).all()


def test_whole_profile(panel):
    def run(r, l):
        p = profile_numbered(r, number_rows(r, l), [], l)
        return p.select("series_id", "n_obs", "missing.*", "stationarity.adf_statistic", "outliers.count")

    both(panel, run)


def test_long_series_are_split_off(panel):
    seen = []

    def run(rows, layout):
        seen.append((layout.whole, sorted(r.series_id for r in rows.select("series_id").distinct().collect())))
        return number_rows(rows, layout).drop("chunk")

    out = by_length(panel, run, CUT)
    assert seen[0] == (True, ["edge", "short", "tiny"])
    assert seen[1] == (False, ["edge1", "flat", "long", "spiky", "walk", "years", "zeros"])
    same(out, number_rows(panel, WHOLE).drop("chunk"), ["series_id", "timestamp"])
