import math
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelcast.llm import langid
from panelcast.llm.queries import op7_language_id


ROWS = [(i, "the cat and the dog" if i % 2 else "le chat et la souris", "en" if i % 2 else "fr") for i in range(40)]


class Plain:
    """The model over dictionaries of the labelled rows."""

    def __init__(self, rows):
        self.words, self.grams = defaultdict(Counter), defaultdict(Counter)
        for _, text, lang in rows:
            self.words[lang].update(langid.LETTERS.findall(text.lower()))
        for lang, words in self.words.items():
            for w, n in words.items():
                marked = f"^{w}$"
                for k in range(2, 6):
                    for i in range(len(marked) - k + 1):
                        self.grams[lang][marked[i : i + k]] += n
                for letter in w:
                    self.grams[lang][letter] += n

    def log(self, counts, item, kinds):
        total = sum(counts[k] for k in kinds)
        return math.log((counts[item] + 0.1) / (total + 0.1 * len(kinds)))

    def scores(self, text):
        total = dict.fromkeys(self.words, 0.0)
        for word in langid.LETTERS.findall(text.lower()):
            marked = f"^{word}$"
            if any(word in c for c in self.words.values()):
                for lang, c in self.words.items():
                    total[lang] += self.log(c, word, list(c))
                continue
            for i in range(len(marked)):
                part = next((marked[i : i + n] for n in range(5, 0, -1) if len(marked[i : i + n]) == n and any(marked[i : i + n] in c for c in self.grams.values())), None)
                for lang, c in self.grams.items() if part else ():
                    total[lang] += self.log(c, part, [g for g in c if len(g) == len(part)]) / 5
        return total


@pytest.fixture(scope="module")
def model(spark):
    rows = ROWS + [(100, None, "en"), (101, "das", None), (None, "der hund", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return langid.fitted(docs, F.col("doc_id").isNotNull())


def test_scores_equal_word_by_word(model):
    assert sorted(model.languages) == ["en", "fr"]
    texts = ["the cat", "Le  Chat, souriset!", "thed", "xq the42the", "中文", "çé", "the " * 3000, "x", None]
    names, score, words, familiar = langid.posteriors(model.languages, model.arrays(), pa.array(texts))
    plain = Plain(ROWS)
    for text, name, got in zip(texts[:-1], names, score, strict=False):
        total = plain.scores(text)
        top = max(total.values())
        assert total[name] == pytest.approx(top)
        assert got == pytest.approx(1 / sum(math.exp(t - top) for t in total.values()), rel=1e-5)
    assert names[:3] == ["en", "fr", "en"] and score[4] == pytest.approx(0.5)
    assert words.tolist() == [2, 3, 1, 3, 1, 1, 3000, 1, 0] and familiar[0] == familiar[6] == 1 and 0 < familiar[2] < 1 and familiar[4] == 0


def test_all_words_of_the_sample_are_known(spark):
    """More words than any fixed room: none is dropped, also not those of the smaller language."""
    rows = [(i, " ".join(spelled(k, "abcdefgh") for k in range(i * 700, i * 700 + 700)), "aa") for i in range(100)]
    rows += [(1000 + i, " ".join(spelled(k, "mnopqrst") for k in range(i * 700, i * 700 + 700)), "mm") for i in range(20)]
    model = langid.fitted(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    arrays = model.arrays()
    assert len(arrays["word_name"]) == 84_000 and len(arrays["word_first"]) == 84_001
    names, score, _, familiar = langid.posteriors(model.languages, arrays, pa.array([rows[99][1], rows[119][1]]))
    assert names == ["aa", "mm"] and familiar.tolist() == [1, 1] and score.min() > 0.99


def spelled(number, letters):
    return "".join(letters[number // 8**k % 8] for k in range(6))


def test_gibberish_goes_and_unseen_words_stay(spark):
    rng = random.Random(2)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fitted(docs, F.col("doc_id") % 2 == 0)
    noise = [(i, " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randint(4, 9))) for _ in range(60)), "x") for i in range(40)]
    bad = spark.createDataFrame(noise + [(99, "中文 日本", "x"), (98, "ЖЩ ЫЪ", "x")], "doc_id long, text string, lang string")
    assert langid.accepted(bad, model).count() == 0
    other = docs.where(F.col("doc_id") % 2 == 1).where(F.col("text").rlike("\\p{L}"))
    assert langid.accepted(other, model).count() >= 0.995 * other.count()


def test_edge_rows(spark, model):
    rows = [(1, None, "x"), (2, "", "x"), (3, "42 !!", "x"), (None, "the cat", "x"), (4, "le", "x"), (4, "le", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = sorted(((r.doc_id, r.lang_pred) for r in langid.predicted(docs, model).collect()), key=repr)
    assert got == sorted([(1, "und"), (2, "und"), (3, "und"), (None, "en"), (4, "fr"), (4, "fr")], key=repr)
    assert langid.predicted(docs.limit(0), model).count() == 0
    none = langid.fitted(docs.withColumn("lang", F.lit(None).cast("string")), F.lit(True))
    assert {(r.lang_pred, r.score) for r in langid.predicted(docs, none).collect()} == {("und", 0.0)}


def test_accepted(spark, model):
    rows = [(1, "the cat", "x"), (2, "中文", "x"), (3, "", "x"), (4, None, "x"), (5, "le", "x"), (None, "the", "x"), (5, "le", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string")
    got = langid.accepted(docs, model)
    assert got.columns == docs.columns
    assert sorted((r.doc_id for r in got.collect()), key=repr) == sorted([1, 5, 5, None], key=repr)
    assert langid.accepted(docs, model, least=1.0).count() == 0
    none = langid.fitted(docs.withColumn("lang", F.lit(None).cast("string")), F.lit(True))
    assert langid.accepted(docs, none).count() == len(rows)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    held = op7_language_id(spark, sf).where("held_out").join(truth, "doc_id").collect()
    assert len(held) > 150
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in held)
