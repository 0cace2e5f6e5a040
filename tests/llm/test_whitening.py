import math

import numpy as np
import pytest

from panelcast.llm import whitening as W
from panelcast.llm.queries import op12_embedding_whitening

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, x string"


def brute(rows, components=4):
    """Everything from the whole matrix: {id: (deviation, whitened up to sign)}, n, explained."""
    good = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(x) for _, x in good), default=0)
    good = [(i, x + [0] * (width - len(x))) for i, x in good]
    fit = sorted({tuple(x) for _, x in good})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    y = np.array(fit, dtype=float) - np.array(sums) / n
    _, s, v = np.linalg.svd(y, full_matrices=False)
    values = s**2 / n
    k = min(components, int((values > 1e-20 * max(values[0], 1e-300)).sum()) if values[0] > 0 else 0)
    weights = v[:k].T / np.sqrt(values[:k])
    out = [(i, sum((n * c - t) ** 2 for c, t in zip(x, sums, strict=True)), (np.array(x) - np.array(sums) / n) @ weights) for i, x in good]
    return out, n, values[:k] / values.sum()


def agree(got, rows, components=4):
    want, n, explained = brute(rows, components)
    assert len(got) == len(want) * len(explained)
    assert all(r.n == n and r.identity_error < 1e-9 for r in got)
    for c, share in enumerate(explained, 1):
        mine = sorted(((r.vec_id if r.vec_id is not None else -1, r.deviation, r.whitened) for r in got if r.component == c))
        theirs = sorted((i if i is not None else -1, d, float(w[c - 1])) for i, d, w in want)
        assert [m[:2] for m in mine] == [t[:2] for t in theirs]
        a, b = np.array([m[2] for m in mine]), np.array([t[2] for t in theirs])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8
        assert all(r.explained == pytest.approx(share, rel=1e-9) for r in got if r.component == c)


def test_all_embeddings(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    agree(op12_embedding_whitening(spark, SF).collect(), rows)


def test_edge_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=6) * [9, 5, 3, 2, 1, 0.5]).tolist(), "a") for i in range(60)]
    rows += [(90, None, "a"), (91, [1.0, None, 1.0, 1.0, 1.0, 1.0], None), (92, [float("nan")] * 6, "a"), (93, [float("inf")] * 6, "a"), (94, [float("-inf")] * 6, "a")]
    rows += [(1, rows[1][1], "b"), (None, rows[2][1], "b"), (95, [1.0, 2.0], "b"), (96, [], "b")]
    docs = spark.createDataFrame(rows, SCHEMA)
    agree(W.whitened(docs).collect(), [r[:2] for r in rows])
    agree(W.whitened(docs, components=2).collect(), [r[:2] for r in rows], 2)
    assert W.whitened(docs.limit(0)).count() == 0 and W.whitened(docs.where("vec_id in (90, 91, 92, 96)")).count() == 0
    same = docs.where("vec_id = 1 or vec_id is null").limit(1)
    assert W.whitened(same.union(same)).count() == 0  # one vector has no variance
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0], "") for i in range(9)], SCHEMA)
    assert {r.component for r in W.whitened(line).collect()} == {1}


def test_numbers_of_any_size(spark):
    rows = [(i, [1e30 if i == 3 else float(i * i), 3e12 * i, -float(i)], "") for i in range(12)]
    got = W.whitened(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) >= 12 and all(r.deviation is None for r in got)
    rows = [(i, [1e6 + i % 7, 1e6 + i % 5], "") for i in range(40)]
    agree(W.whitened(spark.createDataFrame(rows, SCHEMA)).collect(), [r[:2] for r in rows])


def test_factors_of_many_tasks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.integers(-999, 999, size=(700, 5))
    monkeypatch.setattr(W, "FAN", 3)
    monkeypatch.setattr(W, "BLOCK", 5 * 8 * 7)
    fit = spark.createDataFrame([(r.tolist(),) for r in x], "x array<long>").repartition(23)
    sums = [int(s) for s in x.sum(axis=0)]
    r = W.triangular(fit, sums, len(x))
    y = x - x.mean(axis=0)
    assert np.allclose(r.T @ r, y.T @ y, rtol=1e-12)


@pytest.mark.parametrize("rows,width", [(5, 1), (9, 2), (2, 3), (100, 8), (30, 64), (400, 64), (500, 130)])
def test_singular_values_and_directions(rows, width):
    rng = np.random.default_rng(rows)
    a = rng.normal(size=(rows, width)) * np.exp(2 * rng.normal(size=width))
    r = np.linalg.qr(a, mode="r")
    r = np.concatenate([r, np.zeros((width - len(r), width))])
    diagonal, above, _ = W.bidiagonal(r)
    s = np.concatenate([np.linalg.svd(a, compute_uv=False), np.zeros(max(width - rows, 0))])
    found = np.sqrt(W.singular_squares(diagonal, above))
    assert np.abs(found - s).max() < 1e-12 * s[0]
    squares, v = W.directions(r, 4)
    assert np.abs(v.T @ v - np.eye(v.shape[1])).max() < 1e-12
    assert np.abs(a.T @ (a @ v) - v * squares).max() < 1e-12 * s[0] ** 2 * width


def test_small_values_keep_their_digits():
    """A graded bidiagonal matrix, whose smallest value a plain solver loses."""
    diagonal, above = 10.0 ** -np.arange(0, 20, 2), 0.1 * 10.0 ** -np.arange(1, 19, 2)
    from fractions import Fraction

    found = W.singular_squares(diagonal, above)
    product = Fraction(1)
    for d in diagonal:
        product *= Fraction(float(d)) ** 2
    assert float(np.prod(found)) == pytest.approx(float(product), rel=1e-11) and (found > 0).all()


@pytest.mark.parametrize("spectrum", [[1, 1, 1, 1, 1], [2, 2, 2, 1, 1], [3, 3, 0, 0, 1, 3], [1, 0, 0, 0], [5, 5 * (1 + 1e-13), 1]])
def test_equal_variances_give_orthogonal_directions(spectrum):
    rng = np.random.default_rng(1)
    turn = np.linalg.qr(rng.normal(size=(len(spectrum),) * 2))[0]
    for r in (np.diag(np.array(spectrum, dtype=float)), np.linalg.qr(np.diag(spectrum) @ turn, mode="r")):
        squares, v = W.directions(r, 4)
        assert np.abs(v.T @ v - np.eye(len(squares))).max() < 1e-10
        assert np.abs(r.T @ r @ v - v * squares).max() < 1e-10
        assert np.allclose(squares, sorted((float(s) ** 2 for s in spectrum if s), reverse=True)[:4])
