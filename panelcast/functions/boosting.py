"""Gradient boosted trees of many series at a time, on numpy arrays.

Every series has a model of its own, but all of them grow in the same passes: a pass looks at the leaves that are due in any series, finds
the best split of each from sums over its rows in order of every feature, and parts the rows. How many passes a tree takes does not depend on
the number of series.

Features are cut into bins at values of the training rows, at about equally many rows each; a split sends rows whose value is at most
that of a bin to the left. A missing value goes where it did more good in training, or, if the leaf had none, to the side with more rows. So a row
that lacks a feature is still routed by the tree.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 255
ALONE = 2000  # rows of series of a kind from which they grow by themselves
SAME = 1e-10  # gains that differ by less than this share of a series' squares are equal: the first feature, then the lowest value


@dataclass(frozen=True)
class Preset:
    """How a tree grows. `leaves` limits best-first growth, `depth` growth level by level."""

    rate: float
    shrink: float  # added to the number of rows in leaf values and gains
    rows: int  # least rows of a leaf
    leaves: int | None = None
    depth: int | None = None


def edges(values: np.ndarray) -> np.ndarray:
    """Ends of the bins of known values: those at ranks n/BINS, 2n/BINS, .. n, rounded up; all of them where there are few."""
    v = np.sort(values)
    ranks = -(-np.arange(1, BINS + 1) * len(v) // BINS) - 1
    return np.unique(v[ranks]) if len(v) else v


def codes(x: np.ndarray, series: np.ndarray, train: np.ndarray) -> np.ndarray:
    """Bins of all values by series and feature; -1 for missing ones. Values above all training rows are beyond the last bin.
    `series` numbers rows 0, 1, .. in order."""
    out = np.full(x.shape, -1, dtype=np.int16)
    cut = np.flatnonzero(np.diff(series)) + 1
    for rows in np.split(np.arange(len(series)), cut):
        known = ~np.isnan(x[rows])
        fit = known & train[rows][:, None]
        for f in np.flatnonzero(fit.any(axis=0)):
            at = rows[known[:, f]]
            out[at, f] = np.searchsorted(edges(x[rows[fit[:, f]], f]), x[at, f], side="left")
    return out


@dataclass
class Splits:
    """The best split of each leaf: gain 0 where there is none. `code` is the last bin that goes left, `missing_left` where
    missing values go."""

    gain: np.ndarray
    feature: np.ndarray
    code: np.ndarray
    missing_left: np.ndarray


def best_splits(order: np.ndarray, first: np.ndarray, code: np.ndarray, rest: np.ndarray, squares: np.ndarray, preset: Preset) -> Splits:
    """The best split of each leaf. order[f]: training rows of the leaves behind one another, each leaf's by code of feature f; first: where
    each leaf begins (and the last ends); rest: what the rows still miss of their target; squares: of the leaf's series."""
    width, size = order.shape
    leaves, count = len(first) - 1, np.diff(first)
    of = np.repeat(np.arange(leaves), count)
    c = np.take_along_axis(code.T, order, axis=1) if width else np.zeros((0, size), np.int16)
    running = np.cumsum(rest[order], axis=1) if width else np.zeros((0, size))
    before = np.concatenate([np.zeros((width, 1)), running], axis=1)[:, first[:-1]]
    whole = np.add.reduceat(rest[order[0]], first[:-1]) if width else np.zeros(leaves)
    left_sum, left_rows = running - before[:, of], (np.arange(size) - first[of] + 1).astype(float)[None, :]
    unit = np.maximum(squares, 1e-300)
    parent = whole**2 / (count + preset.shrink)
    ends = np.zeros((width, size), dtype=bool)  # the last row of a bin, and not of the leaf
    ends[:, :-1] = (c[:, :-1] != c[:, 1:]) & (of[:-1] == of[1:])[None, :]
    ends &= c >= 0
    missing = (c < 0).any()
    lost_rows = np.zeros((width, leaves))
    lost_sum = np.zeros((width, leaves))
    if missing:
        none = c < 0
        lost_rows = np.add.reduceat(none, first[:-1], axis=1).astype(float)
        lost_sum = np.add.reduceat(np.where(none, rest[order], 0.0), first[:-1], axis=1)

    def gains(sums, rows):
        other, more = whole[of][None, :] - sums, count[of][None, :] - rows
        good = ends & (rows >= preset.rows) & (more >= preset.rows)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = sums**2 / (rows + preset.shrink) + other**2 / (more + preset.shrink) - parent[of][None, :]
        return np.where(good, np.rint(gain / (unit[of] * SAME)[None, :]), 0.0)

    gain = gains(left_sum, left_rows)  # missing values, if any, come first: on the left
    if missing:
        right = gains(left_sum - lost_sum[:, of], left_rows - lost_rows[:, of])
        goes_left = gain >= right
        gain = np.maximum(gain, right)
    best = np.maximum.reduceat(gain, first[:-1], axis=1) if width else np.zeros((1, leaves))
    feature = best.argmax(axis=0)
    top = best[feature, np.arange(leaves)]
    at = np.zeros(leaves, dtype=np.int64)
    bin_, left = np.zeros(leaves, dtype=np.int64), np.zeros(leaves, dtype=bool)
    good = np.flatnonzero(top > 0)
    if len(good):
        hit = gain[feature[of], np.arange(size)] == top[of]
        at = np.minimum.reduceat(np.where(hit, np.arange(size), size), first[:-1])[good]
        bin_[good] = c[feature[good], at]
        rows = left_rows[0, at]
        if missing:
            f = feature[good]
            own = lost_rows[f, good]
            # a leaf without missing values of the feature sends them to its larger side
            left[good] = np.where(own > 0, goes_left[f, at], 2 * rows >= count[good])
        else:
            left[good] = 2 * rows >= count[good]
    return Splits(np.maximum(top, 0.0) * unit * SAME, feature, bin_, left)


def _columns(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, .. for `count[i]` columns, one leaf behind the other."""
    begin = np.cumsum(count) - count
    return np.repeat(start - begin, count) + np.arange(int(count.sum()))


class Forest:
    """Rows of some series, and what their models have predicted so far. Rows with `train` are learned from, all are predicted."""

    def __init__(self, code: np.ndarray, y: np.ndarray, series: np.ndarray, train: np.ndarray, preset: Preset):
        self.code, self.series, self.preset = code, series, preset
        self.rows, self.others = np.flatnonzero(train), np.flatnonzero(~train)
        self.y, count = y, int(series.max(initial=-1)) + 1
        own = series[self.rows]
        n = np.bincount(own, minlength=count)
        mean = np.bincount(own, weights=y[self.rows], minlength=count) / np.maximum(n, 1)
        self.guess = mean[series]
        self.squares = np.bincount(own, weights=(y[self.rows] - mean[own]) ** 2, minlength=count)
        self.trained = np.flatnonzero(n)
        self.sorted = np.stack([self.rows[np.lexsort((code[self.rows, f], own))] for f in range(code.shape[1])]) if code.shape[1] else np.zeros((0, len(self.rows)), np.int64)
        first = np.concatenate([[0], np.cumsum(n[self.trained])])
        self.start, self.count = first[:-1], np.diff(first)

    def grow(self) -> None:
        """One more tree for every series."""
        p, trained = self.preset, len(self.trained)
        order, rest = self.sorted.copy(), np.where(np.isfinite(self.y), self.y, 0.0) - self.guess
        most = max(1, len(self.rows))
        start, count = np.zeros(2 * most, np.int64), np.zeros(2 * most, np.int64)
        start[:trained], count[:trained] = self.start, self.count
        owner = np.zeros(2 * most, np.int64)
        owner[:trained] = self.trained
        leaf_of = np.full(int(self.series.max(initial=-1)) + 1, -1)
        leaf_of[self.trained] = np.arange(trained)
        leaf = leaf_of[self.series]
        split = Splits(np.zeros(2 * most), np.zeros(2 * most, np.int64), np.zeros(2 * most, np.int64), np.zeros(2 * most, bool))
        leaves, fresh, level = trained, np.arange(trained), 0
        size = np.bincount(self.trained, minlength=len(leaf_of))  # leaves of each series
        while len(fresh) and order.shape[0]:
            fresh = fresh[count[fresh] >= 2 * p.rows]
            if p.depth is not None and level == p.depth:
                break
            if len(fresh):
                columns = _columns(start[fresh], count[fresh])
                found = best_splits(order[:, columns], np.concatenate([[0], np.cumsum(count[fresh])]), self.code, rest, self.squares[owner[fresh]], p)
                for name in ("gain", "feature", "code", "missing_left"):
                    getattr(split, name)[fresh] = getattr(found, name)
            due = np.flatnonzero(split.gain[:leaves] > 0)
            if p.leaves is not None:  # in every series the best of its leaves, while it may have more
                due = due[size[owner[due]] < p.leaves]
                due = due[np.lexsort((due, -split.gain[due], owner[due]))]
                due = due[np.concatenate([[True], owner[due][1:] != owner[due][:-1]])] if len(due) else due
            if not len(due):
                break
            columns = _columns(start[due], count[due])
            part, of = order[:, columns], np.repeat(np.arange(len(due)), count[due])
            own = self.code[part, split.feature[due][of][None, :]]
            left = np.where(own < 0, split.missing_left[due][of][None, :], own <= split.code[due][of][None, :])
            lefts = np.cumsum(left, axis=1)
            begin = np.cumsum(count[due]) - count[due]
            base = np.concatenate([np.zeros((len(left), 1), lefts.dtype), lefts], axis=1)[:, begin]
            n_left = (lefts[:, begin + count[due] - 1] - base)[0]  # the same for every feature's order
            rank = lefts - base[:, of]
            place = begin[of] + np.where(left, rank - 1, n_left[of] + np.arange(len(of)) - begin[of] - rank)
            moved = np.empty_like(part)
            np.put_along_axis(moved, place, part, axis=1)
            order[:, columns] = moved
            new = leaves + np.arange(len(due))
            leaf[part[0][~left[0]]] = np.repeat(new, count[due])[~left[0]]
            self._route(leaf, due, new, split, leaves)
            start[new], count[new] = start[due] + n_left, count[due] - n_left
            count[due], owner[new] = n_left, owner[due]
            split.gain[due] = 0.0
            leaves += len(due)
            np.add.at(size, owner[due], 1)
            fresh, level = np.concatenate([due, new]), level + 1
        sums = np.bincount(leaf[self.rows], weights=rest[self.rows], minlength=leaves)
        value = p.rate * sums[:leaves] / (count[:leaves] + p.shrink) if leaves else np.zeros(0)
        known = leaf >= 0
        self.guess[known] += value[leaf[known]]

    def _route(self, leaf: np.ndarray, due: np.ndarray, new: np.ndarray, split: Splits, leaves: int) -> None:
        """Rows that are not learned from follow the splits of their leaves."""
        to = np.full(leaves, -1)
        to[due] = new
        rows = self.others[leaf[self.others] >= 0]
        rows = rows[to[leaf[rows]] >= 0]
        at = leaf[rows]
        own = self.code[rows, split.feature[at]]
        left = np.where(own < 0, split.missing_left[at], own <= split.code[at])
        leaf[rows[~left]] = to[at[~left]]


def kinds(x: np.ndarray, series: np.ndarray, train: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows and features of the series that know the same features in training; kinds of fewer than ALONE rows go together."""
    count, width = int(series.max(initial=-1)) + 1, x.shape[1]
    learned = train[:, None] & ~np.isnan(x)
    known = np.array([np.bincount(series[learned[:, f]], minlength=count) > 0 for f in range(width)], dtype=bool).reshape(width, count)
    kind = (known * (1 << np.arange(width, dtype=np.int64))[:, None]).sum(axis=0)
    each, of, rows = np.unique(kind[series], return_inverse=True, return_counts=True)
    of = np.where(rows[of] < ALONE, len(each), of)
    found = []
    for k in np.unique(of):
        at = np.flatnonzero(of == k)
        found.append((at, np.flatnonzero(known[:, series[at]].any(axis=1))))
    return found


def boosted(x: np.ndarray, y: np.ndarray, series: np.ndarray, train: np.ndarray, presets: dict[str, Preset], trees: int) -> dict[str, np.ndarray]:
    """Predictions of every row after `trees` trees, by preset; NaN for series without a training row. `series` numbers the rows in order; x has
    NaN for missing values; y is used of training rows only. Series that use the same features grow together, without the other features."""
    out = {name: np.full(len(y), np.nan) for name in presets}
    for rows, features in kinds(x, series, train):
        own = np.unique(series[rows], return_inverse=True)[1].ravel()
        for name, found in _grown(x[np.ix_(rows, features)], y[rows], own, train[rows], presets, trees).items():
            out[name][rows] = found
    return out


def _grown(x: np.ndarray, y: np.ndarray, series: np.ndarray, train: np.ndarray, presets: dict[str, Preset], trees: int) -> dict[str, np.ndarray]:
    """`boosted` for series that all grow in the same passes."""
    binned = codes(x, series, train)
    out = {}
    for name, preset in presets.items():
        forest = Forest(binned, np.where(train, y, 0.0), series, train, preset)
        for _ in range(trees):
            forest.grow()
        has = np.zeros(int(series.max(initial=-1)) + 1, dtype=bool)
        has[forest.trained] = True
        out[name] = np.where(has[series], forest.guess, np.nan)
    return out
