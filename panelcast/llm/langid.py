"""Language of a text: known words by their log frequency in each language, unseen words by shorter and shorter n-grams.

A word is a run of letters in lower case. The model holds, for all words of a labelled sample, the log frequency in every language
that has it. A word that it lacks is read from left to right with its ends marked: at every place the longest known character
n-gram counts, from GRAM letters down to one. The sums over a text, as a posterior with equal priors, give language and score.

Words and n-grams are found by 64-bit names in sorted arrays that tasks map into memory; a language that lacks an item takes no room, its
log frequency is the language's least. All distinct words of a batch are looked up together.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.mapped import opened, publish
from panelcast.llm.tables import slices, small, tidied
from panelcast.llm.words import GOLD, distinct_runs, mixed, named, spans
from panelcast.session import cut_lineage

LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
SAMPLE = 4_000  # documents of each language that the model is fitted on, about
GRAM = 5
SMOOTH = 0.1
HELD = 100_000  # entries of a counter in a task
TOGETHER = 8_192  # unseen words that are read at a time
DENSE = 16 << 20  # bytes of logs that a slice of texts may take, about
SHARES = 1 << 30
FAMILIAR, WIDE = 0.5, 3.0  # share of the usual familiarity that a text needs, and deviations it may lack besides
UNKNOWN = "und"


@dataclass
class Model:
    """Languages, the largest first, and the published file of the arrays:

    word_name, word_first, word_lang, word_gain: sorted names of words, and for word i, at word_first[i] to word_first[i + 1], the languages that
    have it and what that adds to the language's word_base. The same for gram_..., with gram_base by n-gram length and gram_once for n-grams
    that were met once.

    Besides, mean and deviation of a word's familiarity (see `read`) in the sample."""

    languages: list[str]
    file: str | None = None
    familiar: float = 0.0
    deviation: float = 0.0

    def arrays(self) -> dict[str, np.ndarray]:
        return opened(self.file) if self.file else {}


def word_names(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode() + b" " * 8, dtype=np.uint8)
    return named(data, *spans(data)) if words else np.zeros(0, np.uint64)


def gram_names(words: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For every place in the marked words: names of the n-grams from it by length (from 1), the number of its word, and the letters from it to
    the word's end, its mark included. A name at a place with fewer letters than its length, or of an end alone, means nothing."""
    code = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    length = np.array([len(w) + 2 for w in words], dtype=np.int64)
    word = np.repeat(np.arange(len(words)), length)
    room = np.cumsum(length)[word] - np.arange(len(code)) if len(words) else np.zeros(0, np.int64)
    name = mixed(code + GOLD)
    out = [name]
    for n in range(2, GRAM + 1):
        name = np.zeros(len(code), dtype=np.uint64)
        some = max(len(code) - n + 1, 0)
        name[:some] = mixed((out[-1][:some] ^ code[n - 1 : n - 1 + some]) + GOLD)
        out.append(name)
    return out, word, room


def _usable(n: int, word: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Places from which an n-gram lies within the word; of one letter, the marks do not count."""
    if n > 1:
        return room >= n
    return (room > 1) & np.concatenate([[False], word[1:] == word[:-1]])


def _places(names: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where wanted names are in sorted ones, and which are there."""
    if not len(names):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
    return at, names[at] == wanted


def longest(arrays: dict[str, np.ndarray], words: list[str], once: bool = True) -> tuple[np.ndarray, ...]:
    """Of unseen words, the places where an n-gram is known: their word, the n-gram's number and length; and each word's familiarity: letters
    of the longest known n-grams by what they could be. Without `once`, n-grams that were met once count as unknown."""
    names, word, room = gram_names(words)
    size, gram = np.zeros(len(word), np.int64), np.zeros(len(word), np.int64)
    for n in range(GRAM, 0, -1):
        rows = np.flatnonzero((size == 0) & _usable(n, word, room))
        at, there = _places(arrays["gram_name"], names[n - 1][rows])
        if not once and len(there):
            there = there & ~arrays["gram_once"][at]
        size[rows[there]], gram[rows[there]] = n, at[there]
    most = np.bincount(word, weights=np.minimum(room, GRAM) * _usable(2, word, room), minlength=len(words))
    share = np.bincount(word, weights=np.maximum(size - (size == 1), 0), minlength=len(words)) / np.maximum(most, 1)
    share = np.maximum(share, 1e-9 * np.bincount(word, weights=size, minlength=len(words)))  # a single letter is hardly anything
    found = np.flatnonzero(size)
    return word[found], gram[found], size[found], np.minimum(share, 1.0)


def _spread(first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries of many rows of a ragged array behind one another: the place of each, and the number of its row in `rows`."""
    size = first[rows + 1] - first[rows]
    begin = np.cumsum(size) - size
    return np.repeat(first[rows] - begin, size) + np.arange(int(size.sum())), np.repeat(np.arange(len(rows)), size)


def read(arrays: dict[str, np.ndarray], count: int, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Log evidence of each word by language, and its familiarity from 0 to 1. N-grams overlap, so each counts for a GRAM-th of a word."""
    at, known = _places(arrays["word_name"], word_names(words))
    rows = np.flatnonzero(known)
    entry, of = _spread(arrays["word_first"], at[rows])
    total = np.bincount(rows[of] * count + arrays["word_lang"][entry], weights=arrays["word_gain"][entry], minlength=len(words) * count)
    total = total.reshape(len(words), count).astype(float)  # no entries, no weights: whole numbers
    total[rows] += arrays["word_base"]
    share, unseen = np.ones(len(words)), np.flatnonzero(~known)
    for a in range(0, len(unseen), TOGETHER):
        rows = unseen[a : a + TOGETHER]
        word, gram, size, share[rows] = longest(arrays, [words[i] for i in rows])
        entry, of = _spread(arrays["gram_first"], gram)
        add = np.bincount(word[of] * count + arrays["gram_lang"][entry], weights=arrays["gram_gain"][entry], minlength=len(rows) * count).reshape(len(rows), count)
        met = np.bincount(word * (GRAM + 1) + size, minlength=len(rows) * (GRAM + 1)).reshape(len(rows), GRAM + 1)
        total[rows] = (add + met @ arrays["gram_base"]) / GRAM
    return total, share


def _counted(counts: Counter) -> pa.RecordBatch:
    keys = list(counts)
    return pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(counts.values()), pa.int64())],
        ["lang", "item", "n"],
    )


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        for part in slices(batch, "text"):
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                counts.update((lang, w) for w in LETTERS.findall((text or "").lower()))
                if len(counts) > HELD:
                    yield _counted(counts)
                    counts = Counter()
    yield _counted(counts)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, items, count = batch.column("lang").to_pylist(), batch.column("item").to_pylist(), np.asarray(batch.column("n"))
        by_lang: dict[str, list[int]] = {}
        for i, lang in enumerate(langs):
            by_lang.setdefault(lang, []).append(i)
        for lang, rows in by_lang.items():
            names, word, room = gram_names([items[i] for i in rows])
            for n in range(1, GRAM + 1):
                use = _usable(n, word, room)
                name, inverse = np.unique(names[n - 1][use], return_inverse=True)
                total = np.bincount(inverse.ravel(), weights=count[rows][word[use]], minlength=len(name)).astype(np.int64)
                same = pa.array([lang]).take(pa.array(np.zeros(len(name), np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [same, pa.array(np.full(len(name), n), pa.int32()), pa.array(name.view(np.int64)), pa.array(total)], ["lang", "size", "name", "n"]
                )


def _name_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = word_names(batch.column("item").to_pylist())
        columns = [batch.column("lang"), pa.array(np.zeros(len(batch)), pa.int32()), pa.array(names.view(np.int64)), batch.column("n")]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "size", "name", "n"])


def _familiarity(file: str):
    """Of words that the sample has once: count, sum and sum of squares of the familiarity that they would have without themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays, out = opened(file), np.zeros(3)
        for batch in batches:
            if len(batch):
                share = longest(arrays, batch.column("item").to_pylist(), once=False)[-1]
                out += [len(share), share.sum(), (share**2).sum()]
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in out], ["words", "sum", "squares"])

    return run


def _ragged(counts: DataFrame, languages: list[str], kind: str) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The arrays of words or n-grams from (lang, size, name, n), and the base of every language by size."""
    number = F.create_map(*[x for i, name in enumerate(languages) for x in (F.lit(name), F.lit(i))])
    rows = counts.select("name", number[F.col("lang")].cast("short").alias("lang"), F.col("size").cast("byte").alias("size"), "n").toArrow()
    name, lang, size = np.asarray(rows["name"]).view(np.uint64), np.asarray(rows["lang"]), np.asarray(rows["size"])
    n, kind_of = np.asarray(rows["n"]), size.astype(np.int64) * len(languages) + lang
    shape = (GRAM + 1, len(languages))
    total = np.bincount(kind_of, weights=n, minlength=shape[0] * shape[1]).reshape(shape)
    kinds = np.bincount(kind_of, minlength=shape[0] * shape[1]).reshape(shape)
    base = np.log(SMOOTH / (total + SMOOTH * np.maximum(kinds, 1)))
    gain_of = np.log1p(n / SMOOTH).astype(np.float32)
    order = np.argsort(name, kind="stable")
    found, first = np.unique(name[order], return_index=True)
    first = np.append(first, len(name))
    once = (np.diff(first) == 1) & (n[order][first[:-1]] == 1) if len(found) else np.zeros(0, bool)
    arrays = {"name": found, "first": first.astype(np.int32 if len(name) < 1 << 31 else np.int64), "lang": lang[order], "gain": gain_of[order], "once": once}
    return {f"{kind}_{k}": a for k, a in arrays.items()}, base


def fitted(
    docs: DataFrame, train: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE
) -> Model:
    """The model of the rows where `train` holds and text and language are not null. It is fitted on a sample bounded by a
    parameter: about `sample` documents of each language, chosen by a hash of the id; a language with fewer gives all. All words and
    n-grams of the sample are in the model. An empty table gives a model without languages."""
    spark: SparkSession = docs.sparkSession
    labelled = docs.where(train).where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    labelled = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.lit("sample")).alias("at"))
    sizes = cut_lineage(labelled.groupBy("lang").count())
    languages = [r[0] for r in sorted(sizes.collect(), key=lambda r: (-r[1], r[0]))]
    if not languages:
        return Model([])
    share = sizes.select("lang", F.least(F.lit(SHARES), F.lit(SHARES * sample) / F.col("count")).cast("long").alias("share"))
    some = labelled.join(small(share), "lang").where(F.pmod("at", F.lit(SHARES)) < F.col("share")).select("lang", "text")
    by_word = cut_lineage(some.mapInArrow(tidied(_count_words), "lang string, item string, n long").groupBy("lang", "item").agg(F.sum("n").alias("n")))
    schema = "lang string, size int, name long, n long"
    by_gram = by_word.mapInArrow(tidied(_count_grams), schema).groupBy("lang", "size", "name").agg(F.sum("n").alias("n"))
    words, base = _ragged(by_word.mapInArrow(tidied(_name_words), schema), languages, "word")
    grams, gram_base = _ragged(by_gram, languages, "gram")
    arrays = {**words, "word_base": base[0], **grams, "gram_base": gram_base}
    totals = by_word.groupBy("item").agg(F.sum("n").alias("n"))
    file = publish(spark, arrays)
    rare = totals.where("n = 1").select("item").mapInArrow(tidied(_familiarity(file)), "words double, sum double, squares double")
    rare = rare.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("words", "sum", "squares")]).first()
    known = totals.where("n > 1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    every = max(known + rare["words"], 1)
    mean = (known + rare["sum"]) / every
    return Model(languages, file, mean, max((known + rare["squares"]) / every - mean**2, 0.0) ** 0.5)


def posteriors(languages: list[str], arrays: dict[str, np.ndarray], column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Language and score of each text of a batch, its words, and their mean familiarity."""
    count = len(languages)
    if not count:
        return [UNKNOWN] * len(column), np.zeros(len(column)), np.zeros(len(column)), np.zeros(len(column))
    runs, inverse, _, before = distinct_runs(column)
    at_run, at_word = [], []
    slot: dict[str, int] = {}
    for i, run in enumerate(runs):
        for word in LETTERS.findall(run.lower()):
            at_run.append(i)
            at_word.append(slot.setdefault(word, len(slot)))
    logs, share = read(arrays, count, list(slot))
    at_run, at_word = np.array(at_run, dtype=np.int64), np.array(at_word, dtype=np.int64)

    def by_text(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(np.bincount(at_run, weights=values[at_word], minlength=len(runs))[inverse])])
        return sums[before[1:]] - sums[before[:-1]]

    words = np.rint(by_text(np.ones(len(slot))))
    total = np.stack([by_text(logs[:, k]) for k in range(count)], axis=1)
    best = np.round(total, 6).argmax(axis=1)  # equal sums may differ in their last bits: the larger language
    odds = np.exp(total - total.max(axis=1, keepdims=True))
    score = odds[np.arange(len(best)), best] / odds.sum(axis=1)
    has = words > 0
    named_ = [languages[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)]
    return named_, np.where(has, np.minimum(score, 1.0), 0.0), words, np.where(has, by_text(share) / np.maximum(words, 1), 0.0)


def _limit(languages: list[str]) -> int:
    """Bytes of text in a slice: the logs of its distinct words are held for every language."""
    return min(4 << 20, max(DENSE // max(len(languages), 1), 1 << 16))


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = model.arrays()
        for batch in batches:
            for part in slices(batch, "text", _limit(model.languages)):
                languages, score, _, _ = posteriors(model.languages, arrays, part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(languages), pa.array(score)], ["id", "lang_pred", "score"])

    return run


def predicted(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred and score (0 to 1) of every row, from the text alone. Null texts and texts without a letter get
    `und` and 0; so does every text if the model has no language. Letters that the model has never met say nothing: with no others the
    largest language is given, with an equal share. Repeated rows are judged each; an id may be null. An empty table gives an empty
    result; other columns are not read."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(tidied(_predict(model)), "id long, lang_pred string, score double").withColumnRenamed("id", id_col)


def _accept(model: Model, text_col: str, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = model.arrays()
        for batch in batches:
            for part in slices(batch, text_col, _limit(model.languages)):
                _, score, words, familiar = posteriors(model.languages, arrays, part.column(text_col))
                needed = FAMILIAR * model.familiar - WIDE * model.deviation / np.sqrt(np.maximum(words, 1))
                yield part.filter(pa.array((words > 0) & (score > least) & (familiar > 0) & (familiar >= needed), pa.bool_()))

    return run


def accepted(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.0) -> DataFrame:
    """The rows, with all their columns, whose text is in one of the model's languages, whichever it is: texts that several
    languages share are accepted. A text goes if it is null or has no letter, if the model knows nothing in it, or if its words are much less
    familiar than unseen words of the sample are on average, by more the fewer they are. `least` asks for a score above it besides.

    A model without languages rejects nothing. Repeated rows are judged each; null ids and clashing names do no harm, since no
    column is added. An empty table gives an empty result. Rows are judged where they are read; nothing is shuffled."""
    if not model.languages:
        return docs
    return docs.mapInArrow(tidied(_accept(model, text_col, least)), docs.schema)


def remainder(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % parts
