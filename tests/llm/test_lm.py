import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.llm import lm
from panelcast.llm.elias_fano import EliasFano, built
from panelcast.llm.langid import remainder


@pytest.mark.parametrize("seed", range(6))
def test_elias_fano(seed):
    rng = np.random.default_rng(seed)
    top = [10, 300, 1 << 20, 1 << 40, 5000, 64][seed]
    values = np.sort(rng.integers(0, top, [0, 1, 1000, 5000, 3000, 640][seed]))
    for sorted_ in (values, np.unique(values), np.concatenate([values, values + top])):
        found = EliasFano(built(sorted_, "x"), "x")
        assert found.get(np.arange(len(sorted_))).tolist() == sorted_.tolist()
        keys = np.unique(np.concatenate([sorted_, rng.integers(0, 2 * top + 9, 500)]))
        place = found.find(np.concatenate([keys, [-1]]))
        first = np.searchsorted(sorted_, keys)
        want = [int(f) if f < len(sorted_) and sorted_[f] == k else -1 for f, k in zip(first, keys, strict=True)]
        assert place.tolist() == [*want, -1]


class Plain:
    """The same model over dictionaries, all n-grams seen at least twice, nothing quantised."""

    def __init__(self, texts):
        seqs = [(t or "").encode().lower().split() for t in texts]
        self.one = Counter(w for s in seqs for w in s)
        self.one["</s>"] = len(seqs)
        full = [["<s>", *s, "</s>"] for s in seqs]
        self.tokens, self.kinds = sum(self.one.values()), len(self.one)
        two = Counter(p for s in full for p in zip(s, s[1:], strict=False))
        self.two = {k: n for k, n in two.items() if n >= 2}
        three = Counter(p for s in full for p in zip(s, s[1:], s[2:], strict=False))
        self.three = {k: n for k, n in three.items() if n >= 2}
        self.follow = {**self.one, "<s>": len(seqs)}

    def p1(self, w):
        return (self.one[w] + 1) / (self.tokens + self.kinds + 1)

    def p2(self, v, w):
        free = max(1e-9, 1 - sum(n - 0.75 for (a, _), n in self.two.items() if a == v) / self.follow[v]) if v in self.follow else 1
        return (self.two[v, w] - 0.75) / self.follow[v] + free * self.p1(w) if (v, w) in self.two else free * self.p1(w)

    def p3(self, u, v, w):
        if (u, v) not in self.two:
            return self.p2(v, w)
        free = max(1e-9, 1 - sum(n - 0.75 for (a, b, _), n in self.three.items() if (a, b) == (u, v)) / self.two[u, v])
        return ((self.three[u, v, w] - 0.75) / self.two[u, v] if (u, v, w) in self.three else 0) + free * self.p2(v, w)

    def score(self, text):
        s = ["<s>", *(text or "").encode().lower().split(), "</s>"]
        total = math.log10(self.p2("<s>", s[1]))
        return total + sum(math.log10(self.p3(*s[i - 2 : i + 1])) for i in range(2, len(s)))


@pytest.mark.parametrize("shard", [60, 700, 1 << 20])
def test_scores(spark, shard, monkeypatch):
    rng = random.Random(8)
    vocabulary = [b"a", b"bb", b"The", b"the", "é".encode(), b"word-longer-than-eight", b"x"] + [f"r{i}".encode() for i in range(30)]
    texts = [b" ".join(rng.choices(vocabulary, weights=[9, 8, 7, 6, 5, 4, 3] + [0.3] * 30, k=rng.choice((0, 1, 2, 8, 40)))).decode() for _ in range(120)]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(200, None, 1), (201, "", 1), (3, texts[3], 1), (None, "bb never seen", 1), (202, "never seen before " * 400, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long")
    train = remainder("doc_id", 7) != 2
    trained = [t for t, in docs.where(train).select("text").collect()]
    plain = Plain(trained)
    monkeypatch.setattr(lm, "TALLIED", 500)
    monkeypatch.setattr(lm, "SHARD", shard)  # the smallest deals frequent contexts over many shards
    got = lm.scored(docs, train).collect()
    assert len(got) == len(rows)
    by_id = {i: t for i, t, _ in rows}
    for r in got:
        s = [*(by_id[r.doc_id] or "").encode().lower().split(), "</s>"]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(s), sum(plain.one[w] > 0 for w in s), plain.tokens)
        assert r.base_score == pytest.approx(sum(math.log10(plain.p1(w)) for w in s))
        assert r.score == pytest.approx(plain.score(by_id[r.doc_id]), abs=len(s) / lm.STEPS / 2 + 1e-9)


def test_probabilities_add_up():
    plain = Plain(["a b a b a c", "a b a b", "c a b", "a b a c"])
    words = list(plain.one)
    unseen = 1 / (plain.tokens + plain.kinds + 1)
    assert sum(plain.p1(w) for w in words) + unseen == pytest.approx(1)
    free = 1 - sum(n - 0.75 for (v, _), n in plain.two.items() if v == b"a") / plain.follow[b"a"]
    assert sum(plain.p2(b"a", w) for w in words) + free * unseen == pytest.approx(1)


def test_no_training_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    r = lm.scored(docs, F.lit(False)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)
    assert lm.scored(docs.limit(0), F.lit(True)).count() == 0


def test_better_than_single_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = lm.scored(docs, remainder("doc_id", 7) != 2).join(docs.where(remainder("doc_id", 7) == 2).select("doc_id"), "doc_id")
    r = held.agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r.s > r.b


def test_the_model_grows_with_the_words(spark):
    """140,000 words, each seen twice and in one order: all of them, their pairs and their triples are in the model."""
    text = " ".join(f"w{i}" for i in range(140_000))
    docs = spark.createDataFrame([(1, text, True), (2, text, True), (3, "w5 w6 w7", False), (4, "w139990 w139991 w139992", False)], "doc_id long, text string, t boolean")
    got = {r.doc_id: r for r in lm.scored(docs, F.col("t")).collect()}
    p1 = 3 / (2 * 140_001 + 140_001 + 1)
    seen, free = 1.25 / 2, 1 - 1.25 / 2
    p2 = seen + free * p1
    want = sum(math.log10(p) for p in (free * p1, p2, seen + free * p2, free * free * p1))
    for i in (3, 4):
        assert (got[i].n_tokens, got[i].n_known) == (4, 4)
        assert got[i].score == pytest.approx(want, abs=1 / lm.STEPS / 2) and got[i].base_score == pytest.approx(4 * math.log10(p1))
