import random

import numpy as np
import pyarrow as pa
import pytest

from panelcast.llm import ngram_join as join
from panelcast.llm.words import words


def plain_set(text, width=5):
    tokens = (text or "").encode().lower().split()
    if len(tokens) < width:
        return {tuple(tokens)} if tokens else set()
    return {tuple(tokens[i : i + width]) for i in range(len(tokens) - width + 1)}


def plain_groups(rows):
    """Sizes and smallest reachable id, over all pairs."""
    sets = [plain_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                up[top(i)] = top(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[top(i)] = min(d, low.get(top(i), d))
    return sorted(((d, len(s), low.get(top(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def test_words_of_batches():
    texts = ["A b\tC", None, "", " \n", "é É x" * 3, "\x85 a\xa0b", "w" * 100 + " " + "w" * 99 + "x", "eight888 eight889 sixteen8sixteen8"]
    name, first = words(pa.array(texts))
    split = [t.encode().lower().split() if t else [] for t in texts]
    assert np.diff(first).tolist() == [len(s) for s in split]
    seen = {}
    for w, n in zip([w for s in split for w in s], name.tolist(), strict=True):
        assert seen.setdefault(w, n) == n
    assert len(set(seen.values())) == len(seen)


def test_first_filter_never_drops_a_link():
    a = lambda x, y: -(-3 * (x + y) // 7)
    for t in ((3, 4),):
        for x in range(1, 1500):
            y = np.arange(-(-x * 3 // 4), x * 4 // 3 + 1)
            px, py = join.low_prefix(x, t), np.array([join.low_prefix(int(v), t) for v in y])
            shared = np.minimum(px - x + a(x, y), py - y + a(x, y))
            assert (shared >= join.low_needed(x)).all(), x


def near_copies(rng, count, vocabulary):
    word = lambda: f"w{rng.randrange(vocabulary)}"
    texts = []
    for _ in range(count):
        if texts and rng.random() < 0.75:
            tokens = rng.choice(texts).split()
            for _ in range(rng.choice((0, 1, 1, 2, 3, 5))):
                at = rng.randrange(len(tokens) + 1)
                tokens[at : at + rng.randint(0, 2)] = [word() for _ in range(rng.randint(0, 2))]
        else:
            tokens = [word() for _ in range(rng.choice((0, 1, 4, 5, 6, 30, 90, 200)))]
        texts.append(" ".join(tokens))
    return texts


@pytest.mark.parametrize("seed,vocabulary", [(1, 3000), (2, 4), (3, 50)])
def test_groups_equal_all_pairs(spark, seed, vocabulary, monkeypatch):
    if seed > 1:
        monkeypatch.setattr(join, "BLOCK", 3)
    rng = random.Random(seed)
    rows = [(d, t) for d, t in enumerate(near_copies(rng, 220, vocabulary))]
    rows += [(900, None), (901, ""), (902, " \t"), (None, rows[3][1]), (5, rows[5][1]), (903, "A b\nC  d e f"), (904, "a B c D e F"), (905, "x y"), (906, "X\ty")]
    docs = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id long, text string, n string").repartition(5)
    got = sorted((tuple(r) for r in join.similar_groups(docs).collect()), key=repr)
    assert got == plain_groups(rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert join.similar_groups(docs).collect() == []


def test_shared_items_stream(monkeypatch):
    rng = np.random.default_rng(0)
    item = np.sort(rng.integers(0, 40, 500))
    owner = rng.integers(0, 30, 500)
    order = np.lexsort((owner, item))
    item, owner = item[order], owner[order]
    pairs = sorted({(int(i), int(o)) for i, o in zip(item, owner, strict=True)})
    count = {i: sum(a == i for a, _ in pairs) for i, _ in pairs}
    for limit in (1 << 20, 5):
        monkeypatch.setattr(join, "LONGEST_RUN", limit)
        for step in (1, 3, 7, 1000):
            batches = [pa.RecordBatch.from_arrays([pa.array(item[i : i + step]), pa.array(owner[i : i + step])], ["item", "owner"]) for i in range(0, 500, step)]
            got = [(r["item"], r["owner"], r["owners"]) for b in join._shared(iter(batches)) for r in b.to_pylist()]
            assert got == [(i, o, min(count[i], limit)) for i, o in pairs if count[i] > 1]


def test_families_of_one_pivot(spark):
    """Two families that share much of a text, and members too far from either."""
    rng = random.Random(9)
    core = [f"c{i}" for i in range(150)]
    texts = []
    for k in range(160):
        tokens = core[:]
        tokens[:25] = [f"f{k % 2}x{i}" for i in range(25)]
        for _ in range(rng.choice((0, 1, 2, 4, 6))):
            tokens[rng.randrange(150)] = f"e{rng.randrange(40)}"
        texts.append(" ".join(tokens))
    rows = list(enumerate(texts))
    got = sorted((tuple(r) for r in join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == plain_groups(rows)
    assert len({c for *_, c in got}) > 2
