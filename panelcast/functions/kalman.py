"""Exact Gaussian likelihood of ARMA models by the Kalman filter, for many series at a time.

A model with coefficients ar (p) and ma (q) has a state of r = max(p, q + 1) numbers that moves by a companion matrix. Mean and variance are not
parameters: the filter runs over the values and over a constant side by side, which gives the best mean and the best variance for
the coefficients in closed form.

The filter is linear in the state it starts from. Run over the unit vectors as well, it summarizes a stretch of rows whatever came before: the state
after it as a linear map, and the squared innovations as a quadratic form. Summaries of neighbouring stretches compose, so a long series can
be filtered stretch by stretch in parallel. Gains do not depend on the values, so a stretch can work out those that it starts with.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

FIRM = 4.0  # parameters are kept within +-FIRM: partial correlations of up to 0.9993
SETTLED = 1e-15  # change of the state's covariance from which it stays as it is
LOOK = 16  # steps after which that is looked at
BLOCK = 4096  # rows whose states are moved at a time, few enough to stay in a core's cache


def coefficients(z: np.ndarray) -> np.ndarray:
    """Coefficients of stationary autoregressions from any real numbers (rows of parameters): their hyperbolic tangents are the partial
    autocorrelations."""
    partial, out = np.tanh(np.clip(z, -FIRM, FIRM)), np.zeros_like(z)
    for k in range(z.shape[1]):
        before = out[:, :k].copy()
        out[:, :k] = before - partial[:, k : k + 1] * before[:, ::-1]
        out[:, k] = partial[:, k]
    return out


def model(z: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """ar and ma, stationary and invertible, from rows of p + q parameters."""
    return coefficients(z[:, :p]), -coefficients(z[:, p:])


def _some(x: np.ndarray, rows) -> np.ndarray:
    """Some of the rows (the last axis), still neighbours in memory, which numpy's own choice by number does not keep them."""
    return x[..., rows] if isinstance(rows, slice) else np.take(x, rows, axis=-1)


class States:
    """Companion matrices and shock loadings of models of one order. The models run along the last axis of all arrays here, so that an operation
    on one number of a state is one pass over neighbouring numbers in memory."""

    def __init__(self, ar: np.ndarray, ma: np.ndarray):
        self.size, self.lags = max(ar.shape[1], ma.shape[1] + 1), ar.shape[1]
        rows = len(ar)
        self.ar, self.load = np.zeros((self.size, rows)), np.zeros((self.size, rows))
        self.ar[: ar.shape[1]], self.load[0], self.load[1 : 1 + ma.shape[1]] = ar.T, 1.0, ma.T
        self.noise = self.load[:, None] * self.load[None]

    def of(self, rows) -> States:
        part = object.__new__(States)
        part.size, part.lags = self.size, self.lags
        part.ar, part.load, part.noise = _some(self.ar, rows), _some(self.load, rows), _some(self.noise, rows)
        return part

    def moved(self, x: np.ndarray) -> np.ndarray:
        """The companion matrix times x (size, columns, rows)."""
        out, p = np.empty(x.shape), self.lags
        np.multiply(self.ar[:p, None], x[:1], out=out[:p])
        own = min(p, self.size - 1)
        out[:own] += x[1 : own + 1]
        if p < self.size:  # below the coefficients it only shifts
            out[p:-1], out[-1] = x[p + 1 :], 0.0
        return out

    def begin(self) -> np.ndarray:
        """The covariance of the state of a stationary series, in units of the shocks' variance."""
        r, rows = self.size, self.ar.shape[1]
        t = np.zeros((r, r, rows))
        t[:, 0] = self.ar
        t[np.arange(r - 1), np.arange(1, r)] = 1.0
        whole = np.eye(r * r)[:, :, None] - (t[:, None, :, None] * t[None, :, None, :]).reshape(r * r, r * r, rows)
        found = np.linalg.solve(np.ascontiguousarray(whole.transpose(2, 0, 1)), self.noise.reshape(r * r, rows).T[:, :, None])
        return np.ascontiguousarray(found[:, :, 0].T).reshape(r, r, rows)

    def step(self, cover: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Variance of the innovation, gain, and the covariance after a row."""
        variance = cover[0, 0].copy()
        moved = self.moved(cover)
        gain = moved[:, 0] / variance
        after = self.moved(moved.transpose(1, 0, 2))
        after += self.noise
        after -= moved[:, 0][:, None] * gain
        new = after + after.transpose(1, 0, 2)
        new *= 0.5
        return variance, gain, new

    def after(self, rows: np.ndarray) -> np.ndarray:
        """The covariance that each series has after so many rows."""
        cover = self.begin()
        left = np.flatnonzero(rows > 0)
        done = 0
        while len(left):
            part = self.of(left)
            old = _some(cover, left)
            _, _, new = part.step(old)
            change = np.abs(new - old).max(axis=(0, 1)) if done % LOOK == 0 else np.ones(len(left))
            cover[:, :, left] = new
            done += 1
            left = left[(rows[left] > done) & (change > SETTLED)]
        return cover


def filtered(states: States, values: np.ndarray, lengths: np.ndarray, skipped: np.ndarray, maps: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The filter over the first lengths[i] values of each row, `skipped` rows after its series began: end state (rows, size, columns), sums of products of
    the innovations over their variance (columns, columns), and the sum of the variances' logarithms. Columns are the unit vectors of the start
    (with `maps`), the values, and the constant. Rows of like length go through it BLOCK at a time."""
    order = np.argsort(-lengths, kind="stable")
    rows, r, columns = len(order), states.size, (states.size if maps else 0) + 2
    state, products, logs = np.zeros((rows, r, columns)), np.zeros((rows, columns, columns)), np.zeros(rows)
    for a in range(0, rows, BLOCK):
        at = order[a : a + BLOCK]
        x, s, logs[at] = _stretch(states.of(at), values[at], lengths[at], skipped[at], maps)
        state[at], products[at] = x.transpose(2, 0, 1), s.transpose(2, 0, 1)
    return state, products, logs


def _stretch(states: States, values: np.ndarray, size: np.ndarray, skipped: np.ndarray, maps: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`filtered` for rows in order of length, the longest first; the results have the rows last."""
    rows, r = len(size), states.size
    lead = r if maps else 0
    values = np.ascontiguousarray(values[:, : int(size.max(initial=0))].T)
    state, ends = np.zeros((r, lead + 2, rows)), np.zeros((r, lead + 2, rows))
    state[np.arange(lead), np.arange(lead)] = 1.0
    products, logs = np.zeros((lead + 2, lead + 2, rows)), np.zeros(rows)
    cover = states.after(skipped)
    active, part, settled = rows, states, False
    for t in range(len(values)):
        k = int(np.searchsorted(-size, -t, side="left"))  # rows with more than t values
        if k != active:
            ends[:, :, k:active] = state[:, :, k:]
            active, part, cover, state = k, states.of(slice(0, k)), cover[:, :, :k], state[:, :, :k]
            if settled:
                variance, gain, log = variance[:k], gain[:, :k], log[:k]
        if not settled:
            variance, gain, new = part.step(cover)
            log = np.log(variance)
            settled = t % LOOK == 0 and bool(np.abs(new - cover).max() <= SETTLED)
            cover = new
        shock = -state[0]
        shock[lead] += values[t, :k]
        shock[lead + 1] += 1.0
        products[:, :, :k] += shock[:, None] * (shock / variance)
        logs[:k] += log
        state = part.moved(state)
        state += gain[:, None] * shock
    ends[:, :, :active] = state
    return ends, products, logs


def composed(first: tuple, second: tuple) -> tuple[np.ndarray, np.ndarray, float]:
    """The summary of two neighbouring stretches of one series, each (end state, products, logs) with maps."""
    (a, s, x), (b, t, y) = first, second
    r = a.shape[0]
    state = b[:, :r] @ a
    state[:, r:] += b[:, r:]
    turn = np.zeros((r + 2, r + 2))
    turn[:r] = a
    turn[r, r] = turn[r + 1, r + 1] = 1.0
    return state, s + turn.T @ t @ turn, x + y


def likelihood(products: np.ndarray, logs: np.ndarray, n: np.ndarray, with_mean: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minus the log likelihood, mean and variance of series from their products (values first, then the constant)."""
    yy, y1, one = products[:, 0, 0], products[:, 0, 1], products[:, 1, 1]
    mean = np.where(with_mean, y1 / np.where(one > 0, one, 1.0), 0.0)
    rest = np.maximum(yy - mean * (2 * y1 - mean * one), 0.0)
    variance = np.maximum(rest / np.maximum(n, 1), 1e-300)
    return (n * (np.log(2 * np.pi * variance) + 1) + logs) / 2, mean, variance


def minimized(
    target: Callable[[np.ndarray, np.ndarray], np.ndarray], start: np.ndarray, free: np.ndarray | None = None, rounds: int = 60, least: float = 1e-9
) -> tuple[np.ndarray, np.ndarray]:
    """Minima of many functions at a time by the quasi-Newton method of Broyden, Fletcher, Goldfarb and Shanno: target(rows, points) gives the values of
    the functions number `rows` at `points`. A function that no longer falls leaves the work. Gradients are central differences; all their
    points, and all steps of a search along a line, are asked for together. Coordinates that are not `free` stay where they start."""
    rows, width = start.shape
    x, step = start.astype(float).copy(), 1e-5
    value = target(np.arange(rows), x)
    if not width:
        return x, value
    shift = np.concatenate([np.eye(width), -np.eye(width)]) * step
    halves = 0.25 ** np.arange(4)

    def slope(left: np.ndarray) -> np.ndarray:
        asked = target(np.repeat(left, 2 * width), (x[left][:, None, :] + shift[None]).reshape(-1, width)).reshape(len(left), 2 * width)
        found = (asked[:, :width] - asked[:, width:]) / (2 * step)
        return found if free is None else np.where(free[left], found, 0.0)

    left = np.arange(rows)
    inverse = np.tile(np.eye(width), (rows, 1, 1))
    gradient = np.zeros((rows, width))
    gradient[left] = slope(left)
    fresh = np.ones(rows, dtype=bool)
    for _ in range(rounds):
        g = gradient[left]
        way = -np.einsum("bij,bj->bi", inverse[left], g)
        fall = (way * g).sum(axis=1)
        up = fall >= 0
        way[up], fall[up] = -g[up], -(g[up] ** 2).sum(axis=1)
        inverse[left[up]] = np.eye(width)
        if free is not None:
            way = np.where(free[left], way, 0.0)
        way = way / np.maximum(1.0, np.abs(way).max(axis=1, keepdims=True))  # no coordinate moves by more than 1
        points = np.clip(x[left][:, None, :] + halves[None, :, None] * way[:, None, :], -FIRM, FIRM)
        asked = target(np.repeat(left, len(halves)), points.reshape(-1, width)).reshape(len(left), len(halves))
        asked = np.where(np.isfinite(asked), asked, np.inf)
        at = asked.argmin(axis=1)
        new = asked[np.arange(len(left)), at]
        better = new < value[left] - least * (1 + np.abs(value[left]))
        again = ~better & ~fresh[left]  # once more straight down before it counts as done
        move = points[np.arange(len(left)), at] - x[left]
        hold = left[better]
        x[hold], value[hold], fresh[hold] = x[hold] + move[better], new[better], False
        inverse[left[again]], fresh[left[again]] = np.eye(width), True
        old = gradient[hold].copy()
        if len(hold):
            gradient[hold] = slope(hold)
            s, y = move[better], gradient[hold] - old
            sy = (s * y).sum(axis=1)
            good = sy > 1e-12
            rho = 1 / np.where(good, sy, 1.0)
            left_part = np.eye(width)[None] - rho[:, None, None] * s[:, :, None] * y[:, None, :]
            updated = left_part @ inverse[hold] @ left_part.transpose(0, 2, 1) + rho[:, None, None] * s[:, :, None] * s[:, None, :]
            inverse[hold] = np.where(good[:, None, None], updated, inverse[hold])
        left = np.concatenate([hold, left[again]])
        if not len(left):
            break
    return x, value
