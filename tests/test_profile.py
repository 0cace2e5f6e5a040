import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from conftest import by_id
from pyspark.sql import functions as F

from panelcast.functions import batch
from panelcast.operators import profile_basic as B
from panelcast.operators import season as S
from panelcast.operators import unit_root as U
from panelcast.operators.layout import Layout, by_length, compact, number_rows
from panelcast.plans.profile import PROFILE_SCHEMA, diagnostic_deltas, flags, profile_panel
from panelcast.operators.features import feature_catalog
from panelcast.sources.stores import profile_documents, profiles_from_documents

WHOLE = Layout(whole=True)


GEN = np.random.default_rng(20_240)
JUMPS = np.sort(GEN.choice(np.arange(20, 340), 5, replace=False))
SALES_DAYS = np.sort(GEN.choice(180, 14, replace=False))
HOLES = np.sort(GEN.choice(np.arange(1, 89), 17, replace=False))


def week_pattern(n):
    """The same seven levels again and again, with a little noise."""
    levels = np.array([3.0, -4.0, 8.0, 0.0, -6.0, 5.0, -2.0])
    return 40 + np.resize(levels, n) + GEN.uniform(-1, 1, n)


def sparse_sales(n):
    out = np.zeros(n)
    out[SALES_DAYS] = GEN.uniform(4.5, 5.5, len(SALES_DAYS))
    return out


def jumping(n):
    out = GEN.uniform(-1, 1, n)
    out[JUMPS] += GEN.choice([-30.0, 30.0], len(JUMPS))
    return out


def with_holes(n):
    out = GEN.uniform(0, 9, n)
    out[HOLES] = np.nan
    return out


SERIES = {
    "uncorrelated": GEN.uniform(-3, 3, 640),
    "week": week_pattern(245),
    "falling": 900 - 1.75 * np.arange(170) + GEN.uniform(-2, 2, 170),
    "sparse": sparse_sales(180),
    "steady": GEN.uniform(90, 110, 150),
    "jumping": jumping(360),
    "constant": np.full(75, -2.5),
    "all_missing": np.full(30, np.nan),
    "all_zero": np.zeros(40),
    "one_row": np.array([3.0]),
    "two_rows": np.array([3.0, 4.0]),
    "holes": with_holes(90),
}


def fixtures():
    return SERIES


@pytest.fixture(scope="module")
def panel(make_panel):
    return make_panel(fixtures()).cache()


@pytest.fixture(scope="module")
def profile(panel):
    return profile_panel(panel).cache()


def test_every_series_has_one_profile(panel, profile):
    rows = by_id(profile)
    assert len(rows) == profile.count() == len(fixtures())
    for name, values in fixtures().items():
        assert rows[name].n_obs == len(values)


def test_uncorrelated_values(profile):
    p = by_id(profile)["uncorrelated"]
    assert not p.seasonality.detected and p.seasonality.period is None
    assert not p.trend.detected
    assert p.stationarity.stationary is True


def test_week_pattern(profile):
    p = by_id(profile)["week"]
    assert p.seasonality.detected and p.seasonality.period == 7 and p.seasonality.strength > 0.8


def test_straight_fall(profile):
    p = by_id(profile)["falling"]
    assert p.trend.detected and p.trend.slope == pytest.approx(-1.75, abs=0.02) and p.trend.strength > 0.98
    assert p.stationarity.stationary is False


def test_demand_classes(profile):
    rows = by_id(profile)
    p = rows["sparse"].intermittency
    sold = SERIES["sparse"][SALES_DAYS]
    assert p.zero_pct == pytest.approx(1 - len(sold) / 180) and p.adi == pytest.approx(180 / len(sold))
    assert p.cv2 == pytest.approx((sold.std() / sold.mean()) ** 2)
    assert p.is_intermittent and p.category == "intermittent"
    assert rows["steady"].intermittency.category == "smooth"
    zero = rows["all_zero"].intermittency
    assert math.isinf(zero.adi) and zero.cv2 == 0 and zero.category == "intermittent"


def test_outliers(panel, profile):
    assert by_id(profile)["jumping"].outliers["count"] >= len(JUMPS)

    def points(rows, layout):
        clean = compact(number_rows(rows, layout), layout)
        parts = S.decompose(clean, layout=layout)
        season = S.best_period(clean, S.strengths(parts))
        return S.outlier_points(S.robust_z(S.outlier_signal(clean, parts, season, layout), layout))

    found = {r.timestamp for r in by_length(panel, points).filter("series_id = 'jumping'").collect()}
    assert {pd.Timestamp("2020-01-01") + pd.Timedelta(days=d) for d in JUMPS.tolist()} <= found


def test_series_that_cannot_be_tested(profile):
    rows = by_id(profile)
    assert rows["constant"].stationarity.error == U.CONSTANT
    assert rows["constant"].stationarity.stationary is False
    assert not rows["constant"].trend.detected and rows["constant"].trend.strength == 0
    for name in ("all_missing", "one_row", "two_rows"):
        assert rows[name].stationarity.adf_statistic is None and rows[name].stationarity.error
    assert rows["all_missing"].missing.missing_count == 30 and rows["all_missing"].outliers["count"] == 0
    assert rows["all_missing"].trend.slope == 0 and rows["all_missing"].seasonality.detected is False
    assert rows["two_rows"].trend.detected is True and rows["two_rows"].trend.slope == pytest.approx(1)


def test_missing_counts_gaps_and_nulls(make_panel, profile):
    gen = np.random.default_rng(77)
    for n in (2, 37, 211):
        days = pd.date_range("2021-03-05", periods=n, freq="D")
        keep = gen.random(n) < 0.6
        keep[[0, -1]] = True  # the ends span the grid
        got = B.missing(make_panel({"gaps": (days[keep], gen.random(keep.sum()))})).first()
        assert (got.expected_n, got.missing_count) == (n, n - keep.sum()) and got.missing_pct == pytest.approx(1 - keep.mean())
    assert by_id(profile)["holes"].missing.missing_count == len(HOLES)


@pytest.mark.parametrize(
    "frequency,code,first",
    [("Weekly", "W", "2020-01-01"), ("Monthly", "MS", "2020-01-15"), ("Quarterly", "QS", "2020-02-01"),
     ("Yearly", "YS", "2020-01-01 06:00"), ("Hourly", "h", "2020-01-01 00:30"), ("Daily", "D", "2020-01-01 12:00")],
)
def test_missing_off_the_grid(make_panel, frequency, code, first):
    """Rows off the calendar grid vanish, and the grid starts at the next anchor."""
    gen = np.random.default_rng(3)
    start = pd.Timestamp(first)
    grid = pd.date_range(start, start + pd.Timedelta(days=30 if frequency == "Hourly" else 2500), freq=code)
    extra = grid[:3] + pd.Timedelta(minutes=7)
    stamps = pd.DatetimeIndex([start]).union(grid[gen.random(len(grid)) < 0.7]).union(extra).unique()
    values = np.where(gen.random(len(stamps)) < 0.1, np.nan, 1.0)
    full = pd.date_range(stamps.min(), stamps.max(), freq=code)
    want = pd.Series(values, index=stamps).reindex(full)
    got = B.missing(make_panel({"x": (stamps, values)}, frequency)).first()
    assert (got.expected_n, got.missing_count) == (len(full), int(want.isna().sum()))


def test_t_critical_table_matches_the_series(spark):
    df = spark.range(1, 60).select("id", B.t_critical(F.col("id")).alias("t"))
    t = {r.id: r.t for r in df.collect()}
    assert t[31] < t[30] < t[1] and t[30] - t[31] < 0.005 and t[59] == pytest.approx(2.0009954, abs=1e-5)


def lstsq_adf(y):
    """Textbook regression, lag by AIC on common rows."""
    n, dy = len(y), np.diff(y)
    top = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)

    def fit(k, first):
        rows = np.arange(first, n)
        x = np.column_stack([np.ones(len(rows)), y[rows - 1], *[dy[rows - 1 - i] for i in range(1, k + 1)]])
        target = dy[rows - 1]
        beta, *_ = np.linalg.lstsq(x, target, rcond=None)
        ssr = ((target - x @ beta) ** 2).sum()
        return x, beta, ssr

    m = n - 1 - top
    aic = [m * math.log(fit(k, top + 1)[2] / m) + 2 * (k + 2) for k in range(top + 1)]
    k = int(np.argmin(aic))
    x, beta, ssr = fit(k, k + 1)
    cov = ssr / (len(x) - x.shape[1]) * np.linalg.inv(x.T @ x)
    return beta[1] / math.sqrt(cov[1, 1]), k


def kpss_by_definition(y):
    n, e = len(y), y - y.mean()
    auto = lambda i: (e[i:] * e[: n - i]).sum()
    start = int(n ** (2 / 9))
    s0, s1 = (e**2).sum() / n, 0.0
    for i in range(1, start + 1):
        c = auto(i) / (n / 2)
        s0, s1 = s0 + c, s1 + i * c
    lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
    var = (e**2).sum() / n + 2 / n * sum((1 - i / (lags + 1)) * auto(i) for i in range(1, lags + 1))
    return (e.cumsum() ** 2).sum() / n**2 / var, lags


def test_unit_root_statistics_against_direct_computation(make_panel):
    gen = np.random.default_rng(11)
    series = {f"noise{i}": gen.normal(size=n) for i, n in enumerate((10, 25, 60, 150, 400))}
    series |= {f"walk{i}": 1e6 + np.cumsum(gen.normal(size=n)) for i, n in enumerate((12, 40, 90, 333))}
    clean = compact(number_rows(make_panel(series), WHOLE), WHOLE)
    adf, kpss = by_id(U.adf(clean, layout=WHOLE)), by_id(U.kpss(clean, WHOLE))
    for name, y in series.items():
        stat, lag = lstsq_adf((y - y.mean()) / y.std())
        assert adf[name].lags == lag, name
        assert adf[name].statistic == pytest.approx(stat, rel=1e-5), name
        stat, lags = kpss_by_definition(y)
        assert kpss[name].lags == lags, name
        assert kpss[name].statistic == pytest.approx(stat, rel=1e-6), name


def test_known_pvalue():
    assert U.adf_pvalues(np.array([-2.86]))[0] == pytest.approx(0.0502, abs=1e-4)


def test_unit_root_verdicts(make_panel):
    gen = np.random.default_rng(2)
    series = {f"noise{i}": gen.normal(size=200) for i in range(40)}
    series |= {f"walk{i}": np.cumsum(gen.normal(size=200)) for i in range(40)}
    clean = compact(number_rows(make_panel(series), WHOLE), WHOLE)
    out = U.stationarity(clean, layout=WHOLE).toPandas()
    noise = out.series_id.str.startswith("noise")
    assert out[noise].adf_stationary.mean() > 0.9 and out[noise].kpss_stationary.mean() > 0.85
    assert out[~noise].adf_stationary.mean() < 0.2 and out[~noise].kpss_stationary.mean() < 0.4


def test_documents_keep_the_profile(profile):
    again = profiles_from_documents(profile_documents(profile))
    a = profile.select(*again.columns).toPandas().set_index("series_id").sort_index()
    b = again.toPandas().set_index("series_id").sort_index()
    assert a.astype(str).equals(b.astype(str))


def test_profile_schema(spark, profile):
    want = spark.createDataFrame([], PROFILE_SCHEMA).schema
    assert [(f.name, f.dataType.simpleString()) for f in profile.schema] == [
        (f.name, f.dataType.simpleString()) for f in want
    ]


def test_row_order_and_ids_do_not_matter(panel, profile):
    renamed = panel.withColumn("series_id", F.concat(F.lit("x_"), "series_id")).repartition(7).orderBy(F.rand(1))
    a = profile.select("series_id", "trend.*", "outliers.count").toPandas()
    b = profile_panel(renamed).select("series_id", "trend.*", "outliers.count").toPandas()
    a["series_id"] = "x_" + a.series_id
    a, b = a.sort_values("series_id"), b.sort_values("series_id")
    np.testing.assert_allclose(a.slope, b.slope, atol=1e-9)
    assert a.detected.tolist() == b.detected.tolist() and a["count"].tolist() == b["count"].tolist()


def test_empty_panel(make_panel):
    assert profile_panel(make_panel({}), ["Daily"]).count() == 0


def test_deltas_of_a_trend_fall(panel, profile):
    d = by_id(diagnostic_deltas(panel, profile))
    t = d["falling"]
    assert t.trend_strength_before > 0.9 and t.trend_strength_after < t.trend_strength_before
    assert t.r_squared > 0.9 and t.trend_strength_fell


def test_deltas_without_features(panel, profile):
    off = feature_catalog(flags(profile)).withColumn("enabled", F.lit(False))
    d = by_id(diagnostic_deltas(panel, profile, off))
    assert d["uncorrelated"].r_squared == 0.0
    assert d["uncorrelated"].trend_strength_after == pytest.approx(d["uncorrelated"].trend_strength_before)


def test_unit_root_test_holds_little_in_python(spark, make_panel, monkeypatch):
    """Whole series are tested by one Python worker a task, and what it holds does not follow the number of series of a batch."""
    rng, sizes = np.random.default_rng(12), []
    clean = compact(number_rows(make_panel({"a": rng.normal(size=40)}), Layout(whole=True)), Layout(whole=True))
    plan = U.adf(clean, layout=Layout(whole=True))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    n = 3000
    grams = [np.cov(rng.normal(size=(13, 30))).ravel() + np.eye(13).ravel() for _ in range(n)]
    names = ["series_id", "n", "k", "gram", "head"]
    held = [pa.array([str(i) for i in range(n)]), pa.array([27] * n), pa.array([10] * n, pa.int32()), pa.array(grams), pa.array(list(rng.normal(size=(n, 11))))]
    factor = batch.factor
    monkeypatch.setattr(batch, "factor", lambda gram: sizes.append(gram.size) or factor(gram))
    out = list(U._adf_statistics([pa.RecordBatch.from_arrays(held, names)]))
    assert sum(map(len, out)) == n and max(sizes) <= batch.VALUES
