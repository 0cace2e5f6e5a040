import numpy as np
import pytest
from conftest import by_id
from pyspark.sql import functions as F

from panelcast.operators import arima as A
from panelcast.operators import smoothing as M
from panelcast.operators.layout import Layout, compact, number_rows
from panelcast.operators.scores import best_model, holdout, horizon, metrics
from panelcast.plans import benchmark as K
from panelcast.plans.profile import profile_panel

WHOLE = Layout(whole=True)


def pairs(spark, actual, predicted, model="ARIMA"):
    rows = [("s", model, float(a), None if p is None else float(p)) for a, p in zip(actual, predicted)]
    return spark.createDataFrame(rows, "series_id string, model_name string, actual double, predicted double")


def test_metrics_by_definition(spark):
    gen = np.random.default_rng(12)
    actual, predicted = gen.uniform(-50, 50, 41), gen.uniform(-50, 50, 41)
    m = metrics(pairs(spark, actual, predicted)).first()
    error = np.abs(actual - predicted)
    assert m.mae == pytest.approx(error.mean()) and m.rmse == pytest.approx(np.sqrt((error**2).mean()))
    assert m.smape == pytest.approx(200 * (error / (np.abs(actual) + np.abs(predicted))).mean())


def test_metrics_of_zeros_and_gaps(spark):
    m = metrics(pairs(spark, [0, -8, 0], [0, -8, 4])).first()
    assert m.mae == pytest.approx(4 / 3) and m.smape == pytest.approx(200 / 3)
    m = metrics(pairs(spark, [6, 7, 9], [6, None, 9])).first()
    assert m.mae == 0 and m.smape == 0


def test_horizon_of_many_lengths(spark):
    got = {r.id: r.h for r in spark.range(1, 700).select("id", horizon(F.col("id")).alias("h")).collect()}
    assert got == {n: min(30, max(7, round(n * 0.1))) for n in got}  # round() takes halves to even


def test_holdout_is_the_last_rows(make_panel):
    out = holdout(number_rows(make_panel({"a": np.arange(100.0), "b": np.arange(5.0)}))).toPandas()
    a = out[out.series_id == "a"].sort_values("pos")
    assert a.is_test.tolist() == [False] * 90 + [True] * 10 and a.step.dropna().tolist() == list(range(1, 11))
    b = out[out.series_id == "b"].sort_values("pos")
    assert b.is_test.all() and b.step.tolist() == [1, 2, 3, 4, 5]


def test_best_model_breaks_ties_by_order_and_ignores_missing(spark):
    rows = [("a", "Theta", 1.0), ("a", "ETS", 1.0), ("a", "GBT_leaf", 2.0), ("b", "ARIMA", None), ("b", "GBT_depth", 9.0)]
    scores = spark.createDataFrame(rows, "series_id string, model_name string, smape double")
    got = by_id(best_model(scores))
    assert got["a"].best_model == "ETS" and got["b"].best_model == "GBT_depth"


def smooth_by_hand(y, alpha, beta, phi, l, b):
    sse = 0.0
    for v in y:
        e = v - (l + phi * b)
        l, b = l + phi * b + alpha * e, phi * b + alpha * beta * e
        sse += e * e
    return l, b, sse


def test_smoothing_against_a_loop(make_panel):
    gen = np.random.default_rng(1)
    series = {f"s{i}": 10 + 0.3 * i * np.arange(20 + 7 * i) + np.cumsum(gen.normal(size=20 + 7 * i)) for i in range(5)}
    clean = compact(number_rows(make_panel(series), WHOLE), WHOLE)
    fits = by_id(M.smoothing_fits(clean, WHOLE))
    for name, y in series.items():
        n, t = len(y), np.arange(1, 11)
        rise, line = np.polyfit(t, y[:10], 1)
        runs = []
        for form, a, b, p in M.GRID:
            start = (y[0], 0.0) if form == "level" else (line, rise)
            l, s, sse = smooth_by_hand(y, a, b, p, *start)
            k = M.ESTIMATED[form]
            runs.append((n * np.log(sse / n) + 2 * k + 2 * k * (k + 1) / (n - k - 1), sse, l, s))
        best = int(np.argmin([r[0] for r in runs]))
        f = fits[name]
        assert (f.ets_form, f.ets_alpha, f.ets_beta, f.ets_phi) == M.GRID[best]
        assert (f.ets_l, f.ets_b) == pytest.approx(runs[best][2:])
        flat = [r[1] if g[0] == "level" else np.inf for r, g in zip(runs, M.GRID)]
        assert f.theta_alpha == M.GRID[int(np.argmin(flat))][1]


def test_theta_is_the_mean_of_line_and_doubled_curvature(make_panel):
    """The closed form equals the average of the fitted line and smoothing of the doubled deviations."""
    gen = np.random.default_rng(4)
    y = 5 + 0.4 * np.arange(60) + np.cumsum(gen.normal(size=60))
    panel = make_panel({"a": y})
    clean = compact(number_rows(panel, WHOLE), WHOLE)
    fits = M.smoothing_fits(clean, WHOLE)
    alpha = fits.first().theta_alpha
    horizons = panel.select("series_id").distinct().withColumn("horizon", F.lit(5))
    got = M.smoothing_forecasts(fits, horizons).filter("model_name = 'Theta'").orderBy("step").toPandas().predicted
    t = np.arange(1, 61)
    slope, start = np.polyfit(t, y, 1)
    line = start + slope * t
    l = 2 * y[0] - line[0]
    for v in 2 * y - line:
        l += alpha * (v - l)
    # the smoothed deviations start at the first value instead of the level the closed form implies
    ahead = start + slope * (60 + np.arange(1, 6))
    np.testing.assert_allclose(got, (ahead + l) / 2, atol=0.5 * abs(slope) * (1 - alpha) ** 60 / alpha + 1e-6)


def test_ar1_is_recovered(make_panel):
    gen = np.random.default_rng(6)
    y = np.zeros(3000)
    for t in range(1, 3000):
        y[t] = 0.7 * y[t - 1] + gen.normal()
    panel = make_panel({"a": y + 50})
    horizons = panel.select("series_id").distinct().withColumn("horizon", F.lit(40))
    r = A.arima(compact(number_rows(panel, WHOLE), WHOLE), horizons, max_p=1, max_q=0, max_d=0, layout=WHOLE).first()
    assert r.p == 1 and r.predicted[-1] == pytest.approx(50, abs=0.5)
    ahead = np.array(r.predicted) - r.predicted[-1]
    assert ahead[1] / ahead[0] == pytest.approx(0.7, abs=0.06)
    assert ahead[0] == pytest.approx(0.7 * y[-1], abs=0.2)


def test_differencing_follows_trend(make_panel):
    gen = np.random.default_rng(9)
    t = np.arange(200)
    panel = make_panel({
        "noise": gen.normal(size=200) + 9,
        "line": 3.0 * t + gen.normal(size=200),
        "square": 0.5 * t**2 + gen.normal(size=200),
        "short": [1.0, 2.0, 3.0],
        "flat": np.full(30, 4.0),
    })
    horizons = panel.select("series_id").distinct().withColumn("horizon", F.lit(7))
    clean = compact(number_rows(panel, WHOLE), WHOLE)
    fits = by_id(A.arima(clean, horizons, layout=WHOLE))
    assert fits["noise"].d == 0 and fits["line"].d == 1 and fits["square"].d == 2
    ahead = np.arange(200, 207)
    np.testing.assert_allclose(fits["noise"].predicted, 9, atol=1)
    np.testing.assert_allclose(fits["line"].predicted, 3.0 * ahead, atol=6)
    np.testing.assert_allclose(fits["square"].predicted, 0.5 * ahead**2, rtol=0.01)
    np.testing.assert_allclose(fits["flat"].predicted, 4.0)
    assert np.isfinite(fits["short"].predicted).all()


@pytest.fixture(scope="module")
def trends(make_panel):
    gen = np.random.default_rng(31)
    days = np.arange(160)
    return make_panel({"t7": 300 - 0.8 * days + gen.uniform(-1.5, 1.5, 160), "t8": 20 + 1.2 * days + gen.uniform(-2, 2, 160)}).cache()


@pytest.fixture(scope="module")
def refitted(spark, trends):
    profile = profile_panel(trends, ["Daily"]).cache()
    switches = spark.createDataFrame([("t8", {"lag_1": False})], "series_id string, config map<string,boolean>")
    return K.refit(trends, profile, switches, ["Daily"], trees=3).cache(), profile


def test_refit_scores_all_models(refitted):
    rows = by_id(refitted[0])
    for r in rows.values():
        assert {m.model_name for m in r.metrics} == {"ARIMA", "ETS", "Theta", "GBT_leaf", "GBT_depth"}
        assert all(m.mae >= 0 for m in r.metrics) and r.best_model in {m.model_name for m in r.metrics}
        assert {m.model_name for m in r.metrics if m.forecast_kind == "one_step"} == {"GBT_leaf", "GBT_depth"}
        assert r.deltas.r_squared > 0.5
        assert {f.model_name for f in r.forecasts} == {m.model_name for m in r.metrics}
        for f, m in zip(r.forecasts, sorted(r.metrics), strict=True):
            assert [p.step for p in f.points] == list(range(1, 17))
            assert m.mae == pytest.approx(np.mean([abs(p.actual - p.predicted) for p in f.points]))
    assert rows["t7"].config["lag_1"] is True and rows["t8"].config["lag_1"] is False


@pytest.mark.parametrize("likelihood", [False, True])
def test_statistical_models_follow_the_trend(trends, likelihood):
    out = K.with_actuals(trends, K.statistical_forecasts(trends, likelihood)).toPandas()
    assert out.groupby(["series_id", "model_name"]).size().eq(16).all() and len(out) == 2 * 3 * 16
    assert (out.actual - out.predicted).abs().max() < 12


def test_without_features_there_are_no_tree_models(spark, trends, refitted):
    names = [f"calendar_{c}" for c in ("day_of_week", "is_weekend")]
    names += ["time_index", "lag_1", "rolling_mean_7", "rolling_std_7"]
    off = {n: False for n in names} | {f"lag_{p}": False for p in (7, 30)}
    switches = spark.createDataFrame([(s, off) for s in ("t7", "t8")], "series_id string, config map<string,boolean>")
    profile = refitted[1].withColumn("seasonality", F.struct(F.lit(False).alias("detected"), F.lit(None).cast("int").alias("period"), F.lit(0.0).alias("strength")))
    test = K.backtest(trends, profile, switches, ["Daily"], trees=2)
    assert {r.model_name for r in test.scores.collect()} == {"ARIMA", "ETS", "Theta"}


def test_refit_keeps_series_without_a_score(make_panel):
    gen = np.random.default_rng(8)
    panel = make_panel({"a": gen.normal(10, 1, 60), "short": [1.0, 2.0, 3.0]}).cache()
    rows = by_id(K.refit(panel, profile_panel(panel, ["Daily"]).cache(), None, ["Daily"], trees=2))
    assert rows["a"].error is None and rows["a"].best_model is not None and len(rows["a"].forecasts) == 5
    assert rows["short"].error == "too few rows to hold out and train" and rows["short"].best_model is None and rows["short"].config["lag_1"]


def test_benchmark_run(spark, make_panel):
    from panelcast.operators.scores import leaderboard
    from panelcast.sources.panel import series_index

    gen = np.random.default_rng(3)
    late = np.concatenate([gen.normal(5, 1, 40), np.full(7, np.nan)])
    panel = make_panel({"a": gen.normal(10, 1, 60), "b": gen.normal(5, 1, 45), "short": [1.0, 2.0, 3.0], "late": late}).cache()
    index, profile = series_index(panel, "d", "p"), profile_panel(panel, ["Daily"]).cache()
    run = lambda seq, old: K.run_benchmark(
        panel, index, profile, f"job{seq}", seq, F.lit(seq), old, ["Daily"], trees=2
    )
    entries, status = run(1, None)
    assert entries.filter("smape IS NOT NULL").count() == 10 and status.first().status == "failed" and status.first().done == 2
    assert status.first().failed == 2
    reasons = {r.series_id: r.error for r in K.outcomes(panel, index, entries).collect()}
    assert reasons == {"a": None, "b": None, "short": "too few rows to hold out and train", "late": "no values in the holdout"}
    lost = K.outcomes(panel, index, entries.filter("model_name <> 'ETS'")).filter("series_id = 'a'").first().error
    assert lost == "no score of ETS"
    merged, _ = run(2, entries)
    rows = merged.collect()
    assert len([r for r in rows if r.smape is not None]) == 10 and {(r.job_id, r.computed_at) for r in rows} == {("job2", 1)}
    assert [r.n_series for r in leaderboard(merged).collect()] == [2] * 5


def test_a_feature_missing_in_the_holdout_is_routed_by_the_trees(make_panel):
    """A gap before a test row leaves its lags unknown; nothing is filled in, and the forecast stays at the series' level."""
    from panelcast.operators.features import feature_catalog, slot_features, slot_plan
    from panelcast.operators.trees import training_table, tree_forecasts
    from panelcast.plans.profile import flags

    values = 50 + np.random.default_rng(5).uniform(-1, 1, 80)
    values[75] = np.nan
    panel = make_panel({"a": values})
    plan = slot_plan(feature_catalog(flags(profile_panel(panel, ["Daily"]))))
    table = training_table(holdout(slot_features(number_rows(panel, WHOLE), plan, ["Daily"], WHOLE)), WHOLE).cache()
    rows = {r.step: r for r in table.filter("is_test").collect()}
    gap = rows[5]  # row 76 follows the gap; the holdout of 80 rows begins at 72
    assert gap.x_lag_1 is None and gap.x_roll_mean is None and gap.x_day_of_week is not None and len(rows) == 8
    assert table.filter("NOT is_test AND (x_lag_1 IS NULL OR x_roll_mean IS NULL OR label IS NULL)").count() == 0
    found = tree_forecasts(table, ["Daily"], trees=20).collect()
    assert len(found) == 16 and all(48.5 < r.predicted < 51.5 for r in found)


def test_refit_query_returns_scores_forecasts_and_config_in_rows(refitted):
    from panelcast.queries.q_models import refit_rows

    series = by_id(refitted[0])
    rows = refit_rows(refitted[0]).collect()
    for name, r in series.items():
        of = lambda part: [x for x in rows if x.series_id == name and x.part == part]  # noqa: B023, E731
        assert [(x.model_name, x.r_squared) for x in of("best")] == [(r.best_model, r.deltas.r_squared)]
        assert {(x.model_name, x.forecast_kind, x.mae, x.rmse, x.smape) for x in of("score")} == {tuple(m) for m in r.metrics}
        points = {(f.model_name, *p) for f in r.forecasts for p in f.points}
        assert {(x.model_name, x.step, x.timestamp, x.actual, x.predicted) for x in of("forecast")} == points and len(of("forecast")) == len(points)
        assert {x.feature: x.enabled for x in of("config")} == r.config
    assert len(rows) == sum(1 + len(r.metrics) + sum(len(f.points) for f in r.forecasts) + len(r.config) for r in series.values())
