"""ARIMA by likelihood: the filter against dense covariances, the search against grids, whole against cut."""

import itertools

import numpy as np
import pytest
from conftest import by_id
from pyspark.sql import functions as F

from panelcast.functions import kalman as K
from panelcast.operators import arima_likelihood as A
from panelcast.operators.layout import Layout, compact, number_rows

WHOLE = Layout(whole=True)


def dense(ar, ma, y, with_mean):
    """Minus the log likelihood from the covariance matrix of all values."""
    n, terms = len(y), 6000
    psi = np.zeros(terms)
    psi[0] = 1
    for k in range(1, terms):
        psi[k] = (ma[k - 1] if k <= len(ma) else 0) + sum(a * psi[k - 1 - i] for i, a in enumerate(ar) if k > i)
    cover = np.array([(psi[: terms - h] * psi[h:]).sum() for h in range(n)])
    inverse = np.linalg.inv(cover[np.abs(np.subtract.outer(np.arange(n), np.arange(n)))])
    one = np.ones(n)
    mean = (one @ inverse @ y) / (one @ inverse @ one) if with_mean else 0.0
    variance = (y - mean) @ inverse @ (y - mean) / n
    return (n * np.log(2 * np.pi * variance) + n - np.linalg.slogdet(inverse)[1]) / 2, mean


@pytest.mark.parametrize("p,q", list(itertools.product(range(4), range(4))))
def test_likelihood_equals_the_dense_one_whole_and_cut(p, q):
    rng = np.random.default_rng(10 * p + q)
    ar, ma = K.model(0.7 * rng.normal(size=(4, p + q)), p)
    y, n, with_mean = rng.normal(size=(4, 30)) + 3, np.array([30, 8, 17, 2]), np.array([True, False, True, True])
    states = K.States(ar, ma)
    state, products, logs = K.filtered(states, y, n, np.zeros(4, int), False)
    found, mean, _ = K.likelihood(products, logs, n, with_mean)
    for i in range(4):
        want = dense(ar[i], ma[i], y[i, : n[i]], with_mean[i])
        assert found[i] == pytest.approx(want[0], rel=1e-8) and mean[i] == pytest.approx(want[1], rel=1e-8)
    parts = []
    for a, b in ((0, 7), (7, 13), (13, 30)):
        s, x, g = K.filtered(states.of([0]), y[:1, a:b], np.array([b - a]), np.array([a]), True)
        parts.append((s[0], x[0], g[0]))
    r = states.size
    for whole in (K.composed(K.composed(*parts[:2]), parts[2]), K.composed(parts[0], K.composed(*parts[1:]))):
        assert K.likelihood(whole[1][None, r:, r:], np.array([whole[2]]), n[:1], with_mean[:1])[0][0] == pytest.approx(found[0], rel=1e-8)
        np.testing.assert_allclose(whole[0][:, r:], state[0], atol=1e-9)


def test_coefficients_are_stationary_and_reach_all_orders():
    z = np.random.default_rng(1).normal(size=(500, 3)) * 2
    for c in K.coefficients(z):
        assert np.abs(np.roots([1, *-c])).max() < 1
    np.testing.assert_array_equal(K.coefficients(np.array([[0.3, -0.2, 0.0]]))[:, :2], K.coefficients(np.array([[0.3, -0.2]])))
    np.testing.assert_allclose(K.coefficients(np.array([[0.4]])), np.tanh(0.4))


def test_search_is_no_worse_than_a_grid():
    rng = np.random.default_rng(2)
    y, n = np.cumsum(rng.normal(size=(12, 40)), axis=1) * rng.uniform(0, 1, (12, 1)) + rng.normal(size=(12, 40)), np.full(12, 40)

    def target(p):
        def run(rows, z):
            _, products, logs = K.filtered(K.States(*K.model(z, p)), y[rows], n[rows], np.zeros(len(rows), int), False)
            return K.likelihood(products, logs, n[rows], np.ones(len(rows), bool))[0]

        return run

    line = np.linspace(-3, 3, 61)
    for p, q in ((1, 0), (0, 1), (1, 1)):
        _, least = A.searched(target(p), 12, p, q)
        for point in itertools.product(line, repeat=p + q):
            assert (least <= target(p)(np.arange(12), np.tile(point, (12, 1))) + 1e-5).all()


def test_functions_leave_one_by_one():
    centre, calls = np.array([[1.0, -2.0], [0.0, 0.0], [3.0, 0.5]]), []

    def target(rows, x):
        calls.append(len(np.unique(rows)))
        return ((x - centre[rows]) ** 2 * [1, 30]).sum(axis=1)

    x, value = K.minimized(target, np.zeros((3, 2)))
    np.testing.assert_allclose(x, centre, atol=1e-4)
    assert calls[0] == 3 and calls[-1] < 3
    x, _ = K.minimized(target, np.zeros((3, 2)), np.array([[True, False]] * 3))
    np.testing.assert_allclose(x, centre * [1, 0], atol=1e-4)


def simulated(rng, n, ar, ma, mean=0.0, d=0):
    e, y = rng.normal(size=n + 200), np.zeros(n + 200)
    for t in range(2, n + 200):
        y[t] = sum(a * y[t - 1 - i] for i, a in enumerate(ar)) + e[t] + sum(m * e[t - 1 - j] for j, m in enumerate(ma))
    y = y[200:] + mean
    for _ in range(d):
        y = np.cumsum(y)
    return y


def test_recovers_simulated_parameters(spark, make_panel):
    rng = np.random.default_rng(3)
    panel = make_panel({"ar": simulated(rng, 600, [0.7], [], 5.0), "ma": simulated(rng, 600, [], [0.6], -2.0), "walk": simulated(rng, 300, [], [], 0.3, 1)})
    horizons = spark.createDataFrame([("ar", 4), ("ma", 4), ("walk", 4)], "series_id string, horizon int")
    fits = by_id(A.arima_likelihood(compact(number_rows(panel, WHOLE), WHOLE), horizons, 1, 1, 1, WHOLE))
    assert fits["ar"].p == 1 and fits["ar"].ar[0] == pytest.approx(0.7, abs=0.1) and fits["ar"].mean == pytest.approx(5, abs=0.4)
    assert fits["ma"].q == 1 and fits["ma"].ma[0] == pytest.approx(0.6, abs=0.12) and fits["ma"].variance == pytest.approx(1, abs=0.15)
    assert fits["walk"].d == 1 and len(fits["walk"].predicted) == 4


def test_orders_and_forecasts_by_dense_covariances(spark, make_panel):
    """AICc of the chosen order, and forecasts as conditional means of a joint normal distribution."""
    rng = np.random.default_rng(4)
    data = {f"s{k}": simulated(rng, 30 + 5 * k, [0.6], [0.3 * (k % 2)], 4.0) for k in range(5)}
    panel = make_panel(data)
    horizons = spark.createDataFrame([(k, 3) for k in data], "series_id string, horizon int")
    for name, r in by_id(A.arima_likelihood(compact(number_rows(panel, WHOLE), WHOLE), horizons, 2, 1, 0, WHOLE)).items():
        y, k = data[name], r.p + r.q + 2
        least, mean = dense(r.ar, r.ma, y, True)
        assert r.aicc == pytest.approx(2 * least + 2 * k + 2 * k * (k + 1) / (len(y) - k - 1), rel=1e-7) and r.mean == pytest.approx(mean, rel=1e-6)
        psi = [1.0]
        for i in range(1, 4000):
            psi.append((r.ma[i - 1] if i <= r.q else 0) + sum(a * psi[i - 1 - j] for j, a in enumerate(r.ar) if i > j))
        psi = np.array(psi)
        cover = np.array([(psi[: 4000 - h] * psi[h:]).sum() for h in range(len(y) + 3)])
        joint = cover[np.abs(np.subtract.outer(np.arange(len(y) + 3), np.arange(len(y) + 3)))]
        want = mean + joint[len(y) :, : len(y)] @ np.linalg.solve(joint[: len(y), : len(y)], y - mean)
        np.testing.assert_allclose(r.predicted, want, rtol=1e-6)


def test_cut_series_give_the_same(spark, make_panel, monkeypatch):
    rng = np.random.default_rng(6)
    data = {"a": simulated(rng, 130, [0.5], [0.4], 3.0), "b": simulated(rng, 90, [], [0.5], 0.2, 1), "c": simulated(rng, 70, [-0.4], [], 1.0)}
    panel = make_panel(data)
    horizons = spark.createDataFrame([(k, 5) for k in data], "series_id string, horizon int")
    whole = by_id(A.arima_likelihood(compact(number_rows(panel, WHOLE), WHOLE), horizons, 1, 1, 1, WHOLE))
    cut = Layout(chunk_rows=32, block_steps=25)
    monkeypatch.setattr(A, "FAN", 2)
    monkeypatch.setattr(A, "GROUP", 2)
    monkeypatch.setattr(A, "ASKED", 5)
    got = by_id(A.arima_likelihood(compact(number_rows(panel, cut), cut), horizons, 1, 1, 1, cut))
    assert got.keys() == whole.keys()
    for name, r in got.items():
        w = whole[name]
        assert (r.d, r.p, r.q) == (w.d, w.p, w.q) and r.aicc == pytest.approx(w.aicc, rel=1e-8)
        np.testing.assert_allclose(r.predicted, w.predicted, rtol=1e-4)


def test_short_flat_and_empty(spark, make_panel):
    panel = make_panel({"one": [4.0], "two": [1.0, 2.0], "flat": [3.0] * 20, "gap": [1.0, np.nan, 2.0, 1.5, np.nan, 2.5, 1.0, 2.0]})
    horizons = spark.createDataFrame([(k, 2) for k in ("one", "two", "flat", "gap")], "series_id string, horizon int")
    clean = compact(number_rows(panel, WHOLE), WHOLE)
    fits = by_id(A.arima_likelihood(clean, horizons, layout=WHOLE))
    assert {k: len(r.predicted) for k, r in fits.items()} == dict.fromkeys(("one", "two", "flat", "gap"), 2)
    assert fits["one"].aicc is None and fits["one"].predicted == [4.0, 4.0] and all(np.isfinite(r.predicted).all() for r in fits.values())
    np.testing.assert_allclose(fits["flat"].predicted, 3.0)
    for layout in (WHOLE, Layout()):
        assert A.arima_likelihood(clean.filter(F.lit(False)), horizons, layout=layout).count() == 0


def test_the_filter_takes_few_rows_at_a_time(monkeypatch):
    """Whatever the number of rows asked for, a block of them is small, and the blocks do not show in the results."""
    rng, seen = np.random.default_rng(8), []
    rows = 2 * K.BLOCK + 100
    y, n, skipped = rng.normal(size=(rows, 9)), rng.integers(1, 10, rows), rng.integers(0, 3, rows)
    states, part = K.States(*K.model(rng.normal(size=(rows, 3)), 2)), K._stretch
    monkeypatch.setattr(K, "_stretch", lambda s, *rest: seen.append(s.ar.shape) or part(s, *rest))
    for maps in (False, True):
        found = K.filtered(states, y, n, skipped, maps)
        assert seen == [(2, K.BLOCK), (2, K.BLOCK), (2, 100)]
        seen.clear()
        for i in rng.integers(0, rows, 20):
            alone = K.filtered(states.of([i]), y[[i]], n[[i]], skipped[[i]], maps)
            for a, b in zip(alone, found, strict=True):
                np.testing.assert_allclose(a[0], b[i], rtol=1e-12, atol=1e-12)
        seen.clear()


def test_a_valley_is_searched_once():
    """A mixed model may have two valleys; a series that has one sets out once, one that has two sets out twice."""
    at, asked = np.array([[0.5, -0.5], [1.4, 1.4]]), []

    def target(of, z):
        asked.append(of)
        one = ((z - at[of]) ** 2).sum(axis=1)
        return np.where(of == 1, np.minimum(one, ((z + at[of]) ** 2).sum(axis=1) + 0.1), one)

    z, least = A.searched(target, 2, 1, 1)
    np.testing.assert_allclose(z, at, atol=1e-3)
    np.testing.assert_allclose(least, 0.0, atol=1e-5)
    assert asked[1].tolist() == [0, 1, 1]
