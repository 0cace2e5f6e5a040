import random
import re
from collections import Counter

import public_tokenizers
import pytest
from test_ngram_join import near_copies, plain_groups
from tokenizers import Tokenizer

import corpus_pipeline
from panelcast.llm.exact_dedup import first_copies
from panelcast.llm.mixing import targets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    texts = near_copies(rng, 120, 900)
    texts += [None, "", "123 456", "!!!", texts[4], texts[4] + " ", " ".join(texts[9].split())]
    return [(i, t, "en" if i % 3 else "de", rng.choice(["a", "a", "b", None]), len(t or "")) for i, t in enumerate(texts)]


def test_stages(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    text = {r[0]: r[1] for r in rows}
    with_words = {i for i, t in text.items() if t and re.search("[a-z]", t)}
    first = corpus_pipeline.language_id(spark, docs, "").cache()
    assert first.columns == docs.columns and {r.doc_id for r in first.collect()} == with_words

    second = corpus_pipeline.exact_dedup(spark, first, "").cache()
    normal = {i: re.sub(r"[\x20\x09-\x0D]+", " ", text[i]) for i in with_words}
    stays = {min(j for j in with_words if normal[j] == normal[i]) for i in with_words}
    assert second.columns == docs.columns and sorted(r.doc_id for r in second.collect()) == sorted(stays)

    third = corpus_pipeline.near_dedup(spark, second, "").cache()
    lowest = {d for d, _, c in plain_groups([(i, text[i]) for i in sorted(stays)]) if d == c}
    assert third.columns == docs.columns and sorted(r.doc_id for r in third.collect()) == sorted(lowest)

    fourth = corpus_pipeline.mix(spark, third, "").cache()
    times = Counter(r.doc_id for r in fourth.collect())
    size = {i: len(text[i].split()) for i in lowest}
    source = {r[0]: r[3] for r in rows}
    sums, taken = Counter(), Counter()
    for i in lowest:
        sums[source[i]] += size[i]
        taken[source[i]] += size[i] * times[i]
    order = sorted(sums, key=lambda s: (s is None, s or ""))
    goal = targets([sums[s] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))], 1.5 * sum(sums.values()))
    assert fourth.columns == docs.columns and set(times) <= lowest and max(times.values()) <= 2
    for s, g in zip(order, goal, strict=True):
        assert abs(taken[s] - g) <= max(10, 0.05 * g)

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    last = corpus_pipeline.bpe(spark, fourth, "").collect()
    assert Counter(r.doc_id for r in last) == times
    assert all(r.ids == library.encode(text[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids) for r in last)


def test_run_is_the_stages(spark, rows, tmp_path):
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    step = docs
    for _, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, str(tmp_path)).cache()
    key = lambda rows: Counter((r.doc_id, tuple(r.ids)) for r in rows)
    assert key(got) == key(step.collect())


def test_repeated_ids(spark):
    rows = [(1, "a b", "x"), (1, "a  b", "y"), (2, "a b", "x"), (1, "c", "x"), (3, "c", "z"), (None, "d", "x"), (None, "d", "x")]
    got = first_copies(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert Counter((r.doc_id, " ".join(r.text.split())) for r in got) == Counter([(1, "a b"), (1, "c"), (None, "d")])


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


CLASHING = ["_id", "_times", "_time", "_gone", "_text", "_sha", "_own_sha", "__id", "id", "row", "lang_pred", "missing", "_salt", "name"]


def test_extra_columns_of_any_name(spark, rows):
    """Names that stages use inside stay what they were, also where ids repeat."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows[:400] + [rows[5], (rows[6][0], "another text of this id", "en", "b", 3)], SCHEMA)
    wide = docs.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in CLASHING])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got, plain = stage(spark, wide, ""), stage(spark, docs, "")
        assert got.columns == wide.columns
        found = got.collect()
        assert all(r[c] == f"{c}{r.doc_id}" for r in found for c in CLASHING)
        assert Counter((r.doc_id, r.text) for r in found) == Counter((r.doc_id, r.text) for r in plain.collect())
    assert corpus_pipeline.bpe(spark, wide, "").count() == wide.count()
