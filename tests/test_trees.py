"""Boosted trees: equal to loops over rows, whole and cut."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.functions import boosting as B
from panelcast.operators import long_trees as L
from panelcast.operators import trees as T
from panelcast.operators.features import SLOTS

SMALL = {"GBT_leaf": B.Preset(0.1, 0.0, 5, leaves=6), "GBT_depth": B.Preset(0.3, 1.0, 1, depth=4)}


def plain(x, y, train, p, trees):
    """One series: every split of every leaf is tried, rows are sent one by one."""
    n, width = x.shape
    code = np.full(x.shape, -1)
    for f in range(width):
        ends = B.edges(x[train & ~np.isnan(x[:, f]), f])
        for i in range(n):
            if not np.isnan(x[i, f]) and len(ends):
                code[i, f] = np.sum(ends < x[i, f])
    mean = y[train].mean()
    guess, squares = np.full(n, mean), ((y[train] - mean) ** 2).sum()

    def goes_left(i, f, v, missing_left):
        return code[i, f] <= v if code[i, f] >= 0 else missing_left

    def best(rows, rest):
        own = [i for i in rows if train[i]]
        if len(own) < 2 * p.rows:
            return None
        whole, found = sum(rest[i] for i in own), None
        for f in range(width):
            values = sorted({code[i, f] for i in own if code[i, f] >= 0})
            for v in values[:-1]:
                for missing_left in (True, False) if any(code[i, f] < 0 for i in own) else (None,):
                    left = [i for i in own if goes_left(i, f, v, missing_left)]
                    right = len(own) - len(left)
                    if min(len(left), right) < p.rows:
                        continue
                    s = sum(rest[i] for i in left)
                    gain = s**2 / (len(left) + p.shrink) + (whole - s) ** 2 / (right + p.shrink) - whole**2 / (len(own) + p.shrink)
                    gain = np.rint(gain / (max(squares, 1e-300) * B.SAME))
                    if gain > 0 and (found is None or gain > found[0]):
                        found = (gain, f, v, 2 * len(left) >= len(own) if missing_left is None else missing_left)
        return found

    for _ in range(trees):
        rest, leaves, depth = y - guess, [list(range(n))], [0]
        split = [best(leaves[0], rest)]
        while True:
            open_ = [k for k in range(len(leaves)) if split[k] and (p.depth is None or depth[k] < p.depth)]
            if not open_ or (p.leaves and len(leaves) >= p.leaves):
                break
            k = max(open_, key=lambda k: (split[k][0], -k)) if p.leaves else open_[0]
            _, f, v, missing_left = split[k]
            left = [i for i in leaves[k] if goes_left(i, f, v, missing_left)]
            right = [i for i in leaves[k] if i not in set(left)]
            leaves[k], depth[k] = left, depth[k] + 1
            leaves.append(right)
            depth.append(depth[k])
            split[k] = best(left, rest)
            split.append(best(right, rest))
        for leaf in leaves:
            own = [i for i in leaf if train[i]]
            for i in leaf:
                guess[i] += p.rate * sum(rest[j] for j in own) / (len(own) + p.shrink)
    return guess


def series(rng, n, kind, missing_in_training):
    x = rng.normal(size=(n, 4))
    x[:, 1] = rng.integers(0, 3, n)
    if kind % 3 == 0:
        x[:, 2] = x[:, 0]  # ties between features
    if kind % 4 == 0:
        x[:, 3] = np.nan  # a slot that is not used
    train = np.arange(n) < 0.8 * n
    y = np.sin(2 * x[:, 0]) + x[:, 1] + 0.1 * rng.normal(size=n) if kind % 5 else np.full(n, 7.0)
    holes = rng.random((n, 4)) < 0.2
    return np.where(holes & (missing_in_training | ~train[:, None]), np.nan, x), y, train


@pytest.mark.parametrize("missing_in_training", [False, True])
def test_equal_to_every_split_tried_on_200_series(missing_in_training):
    rng = np.random.default_rng(9)
    data = [series(rng, int(rng.integers(1, 45)), k, missing_in_training) for k in range(100)]
    x, y, train = (np.concatenate([d[i] for d in data]) for i in range(3))
    number = np.repeat(np.arange(100), [len(d[1]) for d in data])
    for name, found in B.boosted(x, y, number, train, SMALL, 3).items():
        for k, d in enumerate(data):
            np.testing.assert_allclose(found[number == k], plain(*d, SMALL[name], 3), atol=1e-9)


def test_bins_of_many_values():
    rng = np.random.default_rng(2)
    values = rng.normal(size=3000)
    ends = B.edges(values)
    count = np.bincount(np.searchsorted(ends, values, side="left"))
    assert len(ends) == B.BINS and count.max() - count.min() <= 1 and ends[-1] == values.max()
    assert B.edges(np.array([3.0, 1.0, 3.0])).tolist() == [1.0, 3.0] and len(B.edges(np.zeros(0))) == 0


def test_a_series_without_training_rows_has_no_prediction():
    found = B.boosted(np.ones((3, 1)), np.ones(3), np.array([0, 0, 1]), np.array([True, False, False]), SMALL, 2)
    assert all(np.isnan(f[2]) and f[1] == 1 for f in found.values())


@pytest.fixture(scope="module")
def table(spark):
    """Model input of a few series, some test rows with gaps."""
    rng, rows = np.random.default_rng(4), []
    for k, n in enumerate([400, 300, 60, 45, 12]):
        x = rng.normal(size=(n, 3))
        x[:, 1] = np.arange(n) % 7
        y = 3 * np.sin(x[:, 0]) + x[:, 1] * (k + 1) + 0.2 * rng.normal(size=n)
        for i in range(n):
            test = i >= n - 7
            lost = test and i % 3 == 0
            rows.append((f"s{k}", "Daily", i, i - (n - 8) if test else None, test, float(y[i]), None if lost else float(x[i, 0]), float(x[i, 1]), float(x[i, 2])))
    names = ["x_lag_1", "x_day_of_week", "x_roll_mean"]
    schema = "series_id string, frequency string, day int, step int, is_test boolean, label double, " + ", ".join(f"{n} double" for n in names)
    frame = spark.createDataFrame(rows, schema).withColumn("timestamp", F.date_add(F.lit("2020-01-01"), F.col("day")).cast("timestamp_ntz"))
    return frame.select(
        "series_id", "frequency", "timestamp", "step", "is_test", "label",
        *[F.col(f"x_{s}") if f"x_{s}" in names else F.lit(None).cast("double").alias(f"x_{s}") for s in SLOTS],
    ).cache()


def forecasts(df):
    return {(r.series_id, r.model_name, r.step): r.predicted for r in df.collect()}


def test_forecasts_of_a_table(table):
    found = forecasts(T.tree_forecasts(table, trees=20))
    assert len(found) == 5 * 2 * 7
    rows = table.toPandas().sort_values(["series_id", "timestamp"])
    for name, group in rows.groupby("series_id"):
        x, train = group[[f"x_{s}" for s in SLOTS]].to_numpy(float), ~group.is_test.to_numpy(bool)
        want = B.boosted(x, group.label.to_numpy(float), np.zeros(len(group), int), train, T.PRESETS, 20)
        for model, values in want.items():
            np.testing.assert_allclose([found[name, model, s] for s in range(1, 8)], values[~train], atol=1e-9)


def test_long_series_by_summed_histograms(table, monkeypatch):
    """Cut over chunks, the same trees; also over several groups of series, and predictions written now and then."""
    monkeypatch.setattr(T, "PRESETS", {"GBT_leaf": B.Preset(0.1, 0.0, 20, leaves=5), "GBT_depth": B.Preset(0.3, 1.0, 1, depth=3)})
    some = table.filter("series_id in ('s0', 's1', 's3')")
    whole = forecasts(T.tree_forecasts(some, presets=tuple(T.PRESETS), trees=3))
    for chunk, group, kept in ((64, 64, 10), (100, 1, 2)):
        monkeypatch.setattr(L, "CHUNK", chunk)
        monkeypatch.setattr(L, "GROUP", group)
        monkeypatch.setattr(L, "KEPT", kept)
        cut = forecasts(T.tree_forecasts(some, presets=tuple(T.PRESETS), trees=3, long=100))
        assert cut.keys() == whole.keys()
        for key, value in whole.items():
            assert cut[key] == pytest.approx(value, abs=1e-9)


@pytest.mark.parametrize("missing", [False, True])
def test_split_of_a_histogram_is_the_best_of_all(missing):
    rng = np.random.default_rng(7)
    for preset in SMALL.values():
        for _ in range(20):
            x = rng.integers(0, 9, 60).astype(float)[:, None]
            x[rng.random(60) < (0.2 if missing else 0), 0] = np.nan
            y = rng.normal(size=60)
            rest = y - y.mean()
            code = B.codes(x, np.zeros(60, int), np.ones(60, bool))
            place = np.where(code[:, 0] < 0, L.WIDTH - 1, code[:, 0])
            squares = (rest**2).sum()
            got = L.split_of(np.bincount(place, weights=rest, minlength=L.WIDTH), np.bincount(place, minlength=L.WIDTH).astype(float), squares, preset)
            order = np.argsort(code[:, 0], kind="stable")[None, :]
            want = B.best_splits(order, np.array([0, 60]), code, rest, np.array([squares]), preset)
            assert got[0] * squares * B.SAME == pytest.approx(want.gain[0])
            if want.gain[0]:
                assert (got[1], got[2]) == (want.code[0], want.missing_left[0])


def test_empty_table(table):
    assert T.tree_forecasts(table.limit(0)).count() == 0


def test_series_of_a_kind_grow_without_the_features_of_others(monkeypatch):
    """Features that a series does not use are not looked at for it, and neither this nor the groups show in the forecasts."""
    rng, widths = np.random.default_rng(21), []
    series, y = np.repeat(np.arange(60), 20), rng.normal(size=1200)
    x, train = rng.normal(size=(1200, 6)), np.tile(np.arange(20) < 15, 60)
    x[series < 40, 2:] = np.nan  # two features
    x[series >= 58, 0] = np.nan  # a small kind
    presets = {"a": B.Preset(rate=0.3, shrink=1.0, rows=1, depth=4)}
    together = B.boosted(x, y, series, train, presets, 5)["a"]
    monkeypatch.setattr(B, "ALONE", 100)
    forest = B.Forest
    monkeypatch.setattr(B, "Forest", lambda code, *rest: widths.append(code.shape) or forest(code, *rest))
    found = B.boosted(x, y, series, train, presets, 5)["a"]
    assert sorted(widths) == [(40, 5), (360, 6), (800, 2)]
    np.testing.assert_allclose(found, together, rtol=1e-12)
