import itertools

import numpy as np
import pytest

from panelcast.llm import lattice
from panelcast.llm.queries import op4_embedding_near_dedup


def test_decoded_is_the_nearest_point():
    rng = np.random.default_rng(0)
    x = rng.uniform(-3, 3, (300, 8))
    point = lattice.decoded(x)
    doubled = np.rint(point * 2).astype(int)
    assert np.allclose(doubled, point * 2)
    assert ((doubled % 2 == 0).all(axis=1) | (doubled % 2 == 1).all(axis=1)).all()
    assert (doubled.sum(axis=1) % 4 == 0).all()
    mine = ((x - point) ** 2).sum(axis=1)
    assert (mine <= 1 + 1e-9).all()  # no place is farther than 1 from the lattice
    around = (((x - point)[:, None, :] - lattice.MINIMAL[None]) ** 2).sum(axis=2)
    assert (mine <= around.min(axis=1) + 1e-9).all()
    assert len(lattice.MINIMAL) == 240 and np.allclose((lattice.MINIMAL**2).sum(axis=1), 2)
    assert (np.rint(lattice.MINIMAL.sum(axis=1)) % 2 == 0).all()


def vectors_at(rng, cosine, size):
    a, b = rng.standard_normal((2, size))
    a /= np.linalg.norm(a)
    b -= a * (a @ b)
    b /= np.linalg.norm(b)
    return a, cosine * a + np.sqrt(1 - cosine**2) * b


@pytest.mark.parametrize("cosine", [0.931, 0.95, 0.99])
def test_recall_of_signatures(cosine):
    rng = np.random.default_rng(3)
    pairs = [vectors_at(rng, cosine, 64) for _ in range(600)]
    unit = np.concatenate([np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])])
    own, near = lattice.signature(unit, np.zeros(len(unit)), lattice.TABLES, lattice.PROBES, lattice.WIDTH, 7)
    u, v = np.arange(600), np.arange(600, 1200)
    found = np.logical_or.reduce([m for t in range(lattice.TABLES) for m in lattice.met(own, near, u, v, t)])
    assert found.mean() >= 0.97


def plain(rows, least=0.93):
    def usable(r):
        return r[2] is not None and r[1] is not None and len(r[1]) and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])

    links, up = [0] * len(rows), list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = rows[i], rows[j]
        if usable(a) and usable(b) and a[2] == b[2] and len(a[1]) == len(b[1]):
            x, y = np.array(a[1], dtype=float), np.array(b[1], dtype=float)
            if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least:
                links[i] += 1
                links[j] += 1
                up[top(i)] = top(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[top(i)] = min(r[0], low.get(top(i), r[0]))
    return sorted(((r[0], links[i], low.get(top(i))) for i, r in enumerate(rows)), key=repr)


@pytest.mark.parametrize("block", [1024, 5])
def test_near_copies_equal_all_pairs(spark, block):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((12, 64))
    rows = []
    for i in range(160):
        v = base[rng.integers(0, 12)] * rng.uniform(0.5, 2) + rng.standard_normal(64) * rng.choice((0.0, 0.05, 0.15, 3.0))
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(0, 2))))
    rows += [
        (200, None, 1), (201, [0.0] * 64, 1), (202, [float("nan")] + [1.0] * 63, 1), (203, [None] + [1.0] * 63, 1), (204, [float("inf")] * 64, 1),
        (205, [], 1), (206, rows[0][1], None), (None, rows[0][1], rows[0][2]), (0, rows[0][1], rows[0][2]), (207, rows[0][1][:30], rows[0][2]), (208, rows[0][1][:30], rows[0][2]),
    ]
    table = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, row int").repartition(4)
    got = lattice.near_copies(table, block=block).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=repr) == plain(rows)
    kept = [r for r in got if r.kept]
    assert all(r.vec_id == r.component_id for r in kept)
    assert len([r for r in kept if r.vec_id == 0]) == (1 if min(r.component_id for r in got if r.vec_id == 0) == 0 else 0)


def test_empty_table(spark):
    assert lattice.near_copies(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_recall_against_all_pairs(spark):
    sf = "/root/testdata/sf0.1"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    unit = np.array([r[1] for r in rows], dtype=float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    true = ((unit @ unit.T >= 0.93) & (label[:, None] == label[None])).sum() - len(rows)
    got = op4_embedding_near_dedup(spark, sf).agg({"n_links": "sum"}).first()[0]
    assert 0.9 * true <= got <= true
