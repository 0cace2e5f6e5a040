import itertools
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from panelcast.llm.mixing import flow, mixed, targets


def cheapest(words, members, quotas, repeats):
    """(largest flow, least cost) over all whole ways to route the words."""
    best = None
    ways = [list(itertools.product(range(repeats * n + 1), repeat=len(m))) for n, m in zip(words, members, strict=True)]
    for way in itertools.product(*ways):
        used, load, cost = 0, Counter(), 0
        for n, m, x in zip(words, members, way, strict=True):
            if sum(x) > repeats * n:
                break
            load.update(dict(zip(m, x, strict=True)))
            used += sum(x)
            cost += sum((k * (k + 1) // 2) * max(0, min(n, sum(x) - k * n)) for k in range(repeats))
        else:
            if all(load[s] <= q for s, q in enumerate(quotas)) and (best is None or (-used, cost) < best):
                best = (-used, cost)
    return best


def test_flow_is_largest_and_cheapest():
    rng = random.Random(1)
    for _ in range(40):
        words = [rng.randint(0, 2) for _ in range(3)]
        members = [sorted(rng.sample(range(2), rng.randint(0, 2))) for _ in words]
        quotas = [rng.randint(0, 4) for _ in range(2)]
        got = flow(words, members, quotas, 2)
        cost = sum(max(0, x - n) for x, n in zip(got, words, strict=True))
        assert (-sum(got), cost) == cheapest(words, members, quotas, 2)


def test_flow_spares_repetition():
    # the pattern of both sources helps the source that is short instead of a second pass over its own
    assert flow([10, 10], [[0], [0, 1]], [18, 0], 2) == [10, 8]
    assert flow([10], [[0]], [35], 3) == [30]


def test_targets():
    assert targets([100, 100, 100], [5, 2, 1], 400) == pytest.approx([200, 200 * 2 / 3, 200 / 3])
    assert targets([10, 1000], [5, 2], 100) == pytest.approx([20, 80])
    assert targets([0, 10], [5, 2], 15) == pytest.approx([0, 15])
    assert targets([], [], 0) == []


def rows_of(rng, count):
    out = []
    for i in range(count):
        source = rng.choices(["a", "b", "c", "Z", "é", None], weights=[30, 5, 3, 2, 2, 2])[0]
        out.append((i, " ".join(["w"] * rng.choice((0, 1, 5, 9, 20, 60))) if rng.random() < 0.97 else None, source, 1))
    return out


def test_mixed(spark):
    rows = rows_of(random.Random(6), 900) + [(None, "x y", "a", 1), (2000, "same row", "b", 1), (2000, "same row", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long").repartition(6)
    got = mixed(docs, F.array("source")).collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sums = Counter()
    for _, t, s, _ in rows:
        sums[s] += size(t)
    order = sorted(sums, key=lambda s: (s is None, s or ""))
    goal = dict(zip(order, targets([sums[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 1.5 * sum(sums.values())), strict=True))
    taken = Counter()
    text = {i: t for i, t, *_ in rows}
    for r in got:
        assert r.size == size(text[r.doc_id]) and r.taken in (0, r.size, 2 * r.size)
        assert (r.source_size, r.target) == (sums[r.sources[0]], pytest.approx(goal[r.sources[0]]))
        taken[r.sources[0]] += r.taken
    for s in order:
        assert abs(taken[s] - goal[s]) <= max(5, 0.02 * goal[s]), (s, taken[s], goal[s])
    again = mixed(docs.repartition(3), F.array("source")).collect()
    key = lambda rows: Counter((r.doc_id, tuple(r.sources), r.taken) for r in rows)
    assert key(again) == key(got)
    assert key(mixed(docs, F.array("source"), seed=1).collect()) != key(got)


def test_overlapping_sources(spark):
    rows = [(i, "w " * 10, ["a"] if i < 40 else ["b", "a"] if i < 80 else ["b"] if i < 90 else [] if i < 95 else None) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sources array<string>")
    got = mixed(docs, F.col("sources"), weights=(1.0, 1.0), budget=1.0).collect()
    by = Counter()
    for r in got:
        by[tuple(r.sources)] += r.taken
    # 900 words in quotas of 450 each: no document is needed twice
    assert sum(by.values()) == 900 and by[()] == 0 and all(r.taken <= r.size for r in got)


def test_empty_table(spark):
    assert mixed(spark.createDataFrame([], "doc_id long, text string, source string"), F.array("source")).collect() == []
