"""Language-model scores of whole texts by a trigram model of all n-grams seen at least twice, over all words.

p1 is add-one over all words; each longer order takes off DISCOUNT a kept n-gram and gives what that frees to the shorter one:

    p(w | u v) = (c(u v w) - d) / c(u v) + b(u v) p(w | v),   b(u v) = 1 - sum of the first term over kept w

The model is a trie, counted level by level and held in shards. Texts are dealt into blocks of some MB, which are numbered sequences of
words from then on. At each level a block sends a shard its distinct n-grams as (number of the context, number of the word), with
their counts in training texts. The shard adds up what all blocks sent, drops what was seen once and packs the rest as one compact
buffer: contexts, the pointers to where their successors begin, and the successors made monotone by their context, all as Elias-Fano
sequences, then counts or quantised probabilities. It searches every n-gram that a block has sent among the successors of its context, and
answers with its number, the context of the next level. So a bigram is sent only if both words are kept, a trigram only if both of its
bigrams are, which drops nothing that could be kept. Words are named by 64-bit hashes at the first level only.

A context goes to one shard by its number. One that is followed by more words than a shard's share is dealt over several by the
following word, in proportion; every block knows its count from the level before. A block asks each of those parts for what it takes
from the context and adds that up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm import mapped
from panelcast.llm.elias_fano import EliasFano, built
from panelcast.llm.tables import give_back, slices, tidied
from panelcast.llm.words import GOLD, mixed, words
from panelcast.session import cut_lineage, release_shuffles

LEAST = 2
DISCOUNT = 0.75
TALLIED = 8 << 20  # bytes of text of a block
SHARD = 16 << 20  # bytes of text a shard
STEPS = 4096  # steps of a quantised probability in a power of ten; 16 bits hold 16 powers
BEGIN, END = (np.uint64(x) for x in (0x243F6A8885A308D3, 0x13198A2E03707344))  # names of a text's begin and end
TEXTS, ASKED, TOTALS = 0, 1, 2  # kinds of rows; answers of level k are 10 + k
ROWS = "kind int, block long, shard long, n long, kinds long, data binary"
NAMES = [x.split()[0] for x in ROWS.split(", ")]


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of integers from 0 on: sorted ones as differences, then the bytes of equal weight together, as few as it takes."""
    head, body = [len(arrays)], []
    for a in arrays:
        a = a.astype(np.uint64)
        rising = bool((a[1:] >= a[:-1]).all())
        if rising:
            a = np.diff(a, prepend=np.uint64(0))
        width = -(-int(a.max()).bit_length() // 8) if len(a) else 0
        head += [len(a), width, int(rising)]
        body.append(a.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())
    raw = np.array(head, dtype=np.int64).tobytes() + b"".join(body)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd").compress(raw, asbytes=True)


def _parts(data: bytes) -> list[np.ndarray]:
    raw = np.frombuffer(pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little")), np.uint8)
    count = int(raw[:8].view(np.int64)[0])
    head = raw[8 : 8 + 24 * count].view(np.int64).reshape(count, 3)
    out, at = [], 8 + 24 * count
    for size, width, rising in head.tolist():
        a = np.zeros((size, 8), dtype=np.uint8)
        a[:, :width] = raw[at : at + size * width].reshape(width, size).T
        at += size * width
        a = a.view(np.uint64).ravel()
        out.append(np.cumsum(a, dtype=np.uint64) if rising else a)
    return out


def _row(kind: int, block: int = 0, shard: int = 0, n: int = 0, kinds: int = 0, data: bytes = b"") -> tuple:
    return kind, block, shard, n, kinds, data


def _columns(rows: list[tuple]) -> list[pa.Array]:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 6
    return [pa.array(c, t) for c, t in zip(columns, [pa.int32(), *[pa.int64()] * 4, pa.binary()], strict=True)]


def _sorted(shard: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by shard, and where each shard's begin and the last one's end."""
    narrow = shard.astype(np.uint16 if shards <= 1 << 16 else np.int64)  # narrow ones are sorted by their digits
    return np.argsort(narrow, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(shard, minlength=shards))])


def _read(shards: int):
    """Blocks of texts: their sequences of words, by the number of each among the block's sorted names, and the names as asked for."""

    def rows(block: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        name, first = words(pa.concat_arrays([x.column("text") for x in held]))
        texts = len(first) - 1
        word = np.empty(len(name) + 2 * texts, dtype=np.uint64)
        start, stop = first[:-1] + 2 * np.arange(texts), first[1:] + 2 * np.arange(texts) + 1
        inner = np.ones(len(word), dtype=bool)
        inner[start] = inner[stop] = False
        word[start], word[stop], word[inner] = BEGIN, END, name
        key, of = np.unique(word, return_inverse=True)
        train = np.concatenate([np.asarray(x.column("train").cast(pa.int8())) for x in held])
        n = np.bincount(of.ravel(), weights=np.repeat(train, np.diff(first) + 2), minlength=len(key))
        ids = pa.concat_arrays([x.column("id") for x in held])
        data = _packed(of.ravel(), np.diff(first), train, np.asarray(ids.is_valid()), np.asarray(ids.fill_null(0)).view(np.uint64))
        shard = ((key >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)  # sorted names have sorted shards
        cuts = np.searchsorted(shard, np.arange(shards + 1))
        asked = [_row(ASKED, block, int(r), data=_packed(*(x[cuts[r] : cuts[r + 1]] for x in (key, n)))) for r in np.flatnonzero(np.diff(cuts))]
        return pa.RecordBatch.from_arrays(_columns([_row(TEXTS, block, data=data), *asked]), NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() << 33, []
        for batch in batches:
            for part in slices(batch, "text", max(1, TALLIED // 4)):
                held.append(part)
                if sum(x.column("text").nbytes for x in held) >= TALLIED:
                    yield rows(block, held)
                    block, held = block + 1, []
        if held:
            yield rows(block, held)

    return tidied(run)


def _words(shards: int):
    """The first level, for the names of one shard: their counts and, if kept, numbers, the smaller the more frequent."""

    def run(asked: pa.Table) -> pa.Table:
        give_back()  # what the group before has freed
        r = asked.column("shard")[0].as_py()
        parts = [_parts(x.as_py()) for x in asked.column("data")]
        key, of = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        of = of.ravel()
        count = np.bincount(of, weights=np.concatenate([p[1] for p in parts]), minlength=len(key)).astype(np.int64)
        kept = np.flatnonzero(count >= LEAST)
        number = np.zeros(len(key), dtype=np.int64)
        number[kept[np.argsort(-count[kept], kind="stable")]] = 1 + r + shards * np.arange(len(kept))
        rows, at = [_row(TOTALS, n=int(count.sum()), kinds=int((count > 0).sum()))], 0
        for block, (names, _) in zip(asked.column("block").to_pylist(), parts, strict=True):
            some = of[at : at + len(names)]
            at += len(names)
            rows.append(_row(11, block, r, data=_packed(number[some], count[some])))
        return pa.Table.from_arrays(_columns(rows), NAMES)

    return run


def _level(context: np.ndarray, word: np.ndarray, count: np.ndarray, size: np.ndarray, last: bool) -> bytes:
    """The kept n-grams of a shard, sorted by context and word, as one buffer. `size` is the count of each one's context."""
    new = np.flatnonzero(np.diff(context, prepend=-1))
    span = int(word.max()) + 1 if len(word) else 1
    arrays = {**built(context[new], "context"), **built(np.append(new, len(context)), "pointer")}
    arrays |= built(np.repeat(np.arange(len(new)), np.diff(np.append(new, len(context)))) * span + word, "successor")
    if last:
        code = 1 + np.round(-np.log10((count - DISCOUNT) / size) * STEPS)
        arrays["value"] = np.clip(code, 1, 65535).astype(np.uint16)
    else:
        arrays["value"] = count
    arrays["sum"] = np.add.reduceat(count, new) if len(new) else np.zeros(0, np.int64)
    arrays["span"] = np.array([span])
    return mapped.packed(arrays)


class Level:
    def __init__(self, data: bytes):
        self.arrays = mapped.unpacked(np.frombuffer(data, np.uint8))
        self.context, self.pointer, self.successor = (EliasFano(self.arrays, x) for x in ("context", "pointer", "successor"))
        self.span = int(self.arrays["span"][0])

    def taken(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and summed counts of the successors of contexts by their places; 0 for place -1."""
        there = np.flatnonzero(at >= 0)
        many, total = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
        many[there] = self.pointer.get(at[there] + 1) - self.pointer.get(at[there])
        total[there] = self.arrays["sum"][at[there]]
        return many, total

    def find(self, at: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and value of each word among the successors of the context at a place, -1 and 0 where it is none of them."""
        place, value = np.full(len(at), -1, dtype=np.int64), np.zeros(len(at), dtype=np.int64)
        some = np.flatnonzero((word < self.span) & (at >= 0))
        place[some] = self.successor.find(at[some] * self.span + word[some])
        value[place >= 0] = self.arrays["value"][place[place >= 0]]
        return place, value


def _grams(order: int, shards: int):
    """The second or third level, for the contexts, or parts of contexts, of one shard."""

    def run(asked: pa.Table) -> pa.Table:
        give_back()  # what the group before has freed
        r = asked.column("shard")[0].as_py()
        parts = [[x.astype(np.int64) for x in _parts(p.as_py())] for p in asked.column("data")]
        own = np.concatenate([p[3] for p in parts])
        contexts, some = np.unique(own, return_index=True)
        size = np.concatenate([p[4] for p in parts])[some]
        word = np.concatenate([p[1] for p in parts])
        span = int(word.max(initial=0)) + 1
        key, of = np.unique(np.searchsorted(contexts, np.concatenate([p[0] for p in parts])) * span + word, return_inverse=True)
        count = np.bincount(of.ravel(), weights=np.concatenate([p[2] for p in parts]), minlength=len(key)).astype(np.int64)
        context, word = np.divmod(key, span)
        kept = count >= LEAST
        level = Level(_level(contexts[context[kept]], word[kept], count[kept], size[context[kept]], order == 3))
        at = level.context.find(contexts)
        place, value = level.find(at[context], word)
        # no level follows the third that would need its numbers
        place = np.where(place < 0, 0, 1 + r + shards * place) if order == 2 else np.zeros(len(key), dtype=np.int64)
        many, total = level.taken(at)
        rows, done = [], 0
        for block, (c, _, _, o, _) in zip(asked.column("block").to_pylist(), parts, strict=True):
            i, j = of.ravel()[done : done + len(c)], np.searchsorted(contexts, o)
            done += len(c)
            rows.append(_row(10 + order, block, r, data=_packed(place[i], value[i], many[j], total[j])))
        return pa.Table.from_arrays(_columns(rows), NAMES)

    return run


class Asked:
    """What a block asks of one level: for each of its n-grams, context and word with the count in training texts, and for each part of each
    of its contexts, the context with its count.

    `context` and `word` are those of each place, as numbers within the block; `number` and `size` are what the level before
    answered for each context, `words_` the numbers of the block's words. Both are in order of those numbers."""

    def __init__(self, context: np.ndarray, word: np.ndarray, open_: np.ndarray, train: np.ndarray, number: np.ndarray, size: np.ndarray, words_: np.ndarray, shards: int, share: int):
        self.shards, self.contexts = shards, len(number)
        self.open = open_ & (number[context] > 0) & (words_[word] > 0)
        key, of = np.unique(context[self.open] * len(words_) + word[self.open], return_inverse=True)
        self.of = of.ravel()
        c, w = np.divmod(key, len(words_))
        w = words_[w]
        splits = np.clip(-(-size // share), 1, shards)
        own = np.flatnonzero((np.bincount(context, minlength=len(number)) > 0) & (number > 0))
        self.own = np.repeat(own, splits[own])
        own_part = np.arange(len(self.own)) - np.repeat(np.cumsum(splits[own]) - splits[own], splits[own])
        part = (mixed(w.astype(np.uint64)) % splits[c].astype(np.uint64)).astype(np.int64)
        first = (mixed(number.astype(np.uint64) + GOLD) % np.uint64(shards)).astype(np.int64)  # parts of a context are in shards side by side
        self.order, self.cuts = _sorted((first[c] + part) % shards, shards)
        self.own_order, self.own_cuts = _sorted((first[self.own] + own_part) % shards, shards)
        n = np.bincount(self.of, weights=train[self.open], minlength=len(key)).astype(np.int64)
        self.asked, self.own_asked = (number[c], w, n), (number[self.own], size[self.own])

    def rows(self, block: int) -> list[tuple]:
        grams, own = [x[self.order] for x in self.asked], [x[self.own_order] for x in self.own_asked]
        out = []
        for r in np.flatnonzero(np.diff(self.own_cuts)):  # an n-gram's context is always asked for in the same shard
            a, b, c, d = *self.cuts[r : r + 2], *self.own_cuts[r : r + 2]
            out.append(_row(ASKED, block, int(r), data=_packed(*(x[a:b] for x in grams), *(x[c:d] for x in own))))
        return out

    def answered(self, answers: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number and value of each place, 0 where the n-gram is not kept, and what is taken from each context."""
        found = [np.concatenate([np.zeros(0, np.uint64), *x]).astype(np.int64) for x in (list(zip(*answers, strict=True)) or [()] * 4)]
        out = []
        for x in found[:2]:
            by_gram, by_place = np.empty(len(self.order), np.int64), np.zeros(len(self.open), np.int64)
            by_gram[self.order] = x
            by_place[self.open] = by_gram[self.of]
            out.append(by_place)
        return *out, np.bincount(self.own[self.own_order], weights=found[3] - DISCOUNT * found[2], minlength=self.contexts)


class Block:
    """A block's texts with the answers of the levels so far, in the order it has asked."""

    def __init__(self, found: pa.Table, shards: int, share: int):
        kind, shard, data = (found.column(c).to_pylist() for c in ("kind", "shard", "data"))
        self.of, size, train, self.valid, ids = _parts(data[kind.index(TEXTS)])
        self.of, self.size = self.of.astype(np.int64), size.astype(np.int64) + 1
        self.ids = ids.view(np.int64)
        self.start = np.cumsum(self.size + 1) - self.size - 1
        self.begin = np.zeros(len(self.of), dtype=bool)
        self.begin[self.start] = True
        answers: dict[int, list] = {}
        for _, k, i in sorted((s, k, i) for i, (k, s) in enumerate(zip(kind, shard, strict=True)) if k > 10):
            answers.setdefault(k, []).append(_parts(data[i]))
        self.number, self.count = (np.concatenate(x).astype(np.int64) for x in zip(*answers[11], strict=True))
        by_number = np.argsort(self.number, kind="stable")
        rank = np.empty(len(by_number), dtype=np.int64)
        rank[by_number] = np.arange(len(by_number))
        self.of, self.number, self.count = rank[self.of], self.number[by_number], self.count[by_number]
        trained = np.repeat(train > 0, self.size + 1)
        self.two = np.flatnonzero(~self.begin[1:]) + 1
        self.bigrams = Asked(self.of[self.two - 1], self.of[self.two], np.ones(len(self.two), bool), trained[self.two], self.number, self.count, self.number, shards, share)
        if 12 not in answers and len(self.bigrams.own):
            return
        pair, self.pairs, self.from_words = self.bigrams.answered(answers.get(12, []))
        key, some, pair_of = np.unique(pair, return_index=True, return_inverse=True)  # kept bigrams by their number in the block
        place = np.zeros(len(self.of), dtype=np.int64)
        place[self.two] = pair_of.ravel()
        self.three = self.two[~self.begin[self.two - 1]]
        self.before, self.pair_count = place[self.three - 1], self.pairs[some]
        last = key[place[self.three]] > 0
        self.trigrams = Asked(self.before, self.of[self.three], last, trained[self.three], key, self.pair_count, self.number, shards, share)
        if 13 in answers or not len(self.trigrams.own):
            _, self.codes, self.from_pairs = self.trigrams.answered(answers.get(13, []))

    def scores(self, tokens: int, kinds: int) -> list[np.ndarray]:
        """Per text: known tokens, base score, score."""
        one = (self.count[self.of] + 1.0) / (tokens + kinds + 1)
        known = (self.count[self.of] > 0) & ~self.begin
        p, v = one.copy(), self.of[self.two - 1]
        back = np.clip(1 - self.from_words / np.maximum(self.count, 1), 1e-9, 1.0)
        high = np.where(self.pairs > 0, (self.pairs - DISCOUNT) / np.maximum(self.count[v], 1), 0.0)
        p[self.two] = high + back[v] * one[self.two]
        back = np.clip(1 - self.from_pairs / np.maximum(self.pair_count, 1), 1e-9, 1.0)
        high = np.where(self.codes > 0, 10.0 ** ((1 - self.codes) / STEPS), 0.0)
        p[self.three] = np.where(self.pair_count[self.before] > 0, high + back[self.before] * p[self.three], p[self.three])
        base, score = (np.where(self.begin, 0.0, np.log10(x)) for x in (one, p))
        return [np.add.reduceat(x, self.start) for x in (known.astype(np.int64), base, score)]


def _ask(order: int, shards: int, share: int):
    def run(found: pa.Table) -> pa.Table:
        give_back()  # what the group before has freed
        block = Block(found, shards, share)
        asked = block.bigrams if order == 2 else block.trigrams
        return pa.Table.from_arrays(_columns(asked.rows(found.column("block")[0].as_py())), NAMES)

    return run


def _score(shards: int, share: int, tokens: int, kinds: int):
    def run(found: pa.Table) -> pa.Table:
        give_back()  # what the group before has freed
        block = Block(found, shards, share)
        known, base, score = block.scores(tokens, kinds)
        ids = pa.array(block.ids, pa.int64(), mask=block.valid == 0)
        return pa.Table.from_arrays([ids, pa.array(block.size), pa.array(known), pa.array(base), pa.array(score)], ["id", "n_tokens", "n_known", "base", "score"])

    return run


def _answers(blocks: DataFrame, order: int, shards: int, share: int) -> DataFrame:
    """What the shards of a level answer, written. No name of the caller keeps its shuffle files."""
    asked = blocks.groupBy("block").applyInArrow(_ask(order, shards, share), ROWS)
    return cut_lineage(asked.groupBy("shard").applyInArrow(_grams(order, shards), ROWS))


def scored(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_known (tokens seen in training), train_tokens, base_score (add-one over single tokens) and score (the
    model's log10 probability of the text) of every row, after training on the rows where `train` holds.

    Null and empty texts are one token, their end. Repeated rows are trained on and scored each; an id may be null; other
    columns are not read. Without training rows every token is unknown and both scores are 0. A trigram's own part of the probability is
    quantised to 1 / STEPS of a power of ten; all else is exact."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text_col).alias("text"))
    size = texts.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()[0]
    shards = -(-(size or 1) // SHARD)
    read = cut_lineage(texts.mapInArrow(_read(shards), ROWS))
    found = cut_lineage(read.where(F.col("kind") == ASKED).groupBy("shard").applyInArrow(_words(shards), ROWS))
    n, kinds = found.where(F.col("kind") == TOTALS).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    ends = texts.where("train").count()
    tokens, kinds = n - ends, kinds - (ends > 0)  # without the begins
    share = max(1, -(-tokens // shards))
    blocks = read.where(F.col("kind") == TEXTS).unionByName(found.where(F.col("kind") > 10))
    for order in (2, 3):
        release_shuffles(spark)  # of the level before
        blocks = blocks.unionByName(_answers(blocks, order, shards, share))
    release_shuffles(spark)
    rows = blocks.groupBy("block").applyInArrow(_score(shards, share, tokens, kinds), "id long, n_tokens long, n_known long, base double, score double")
    return rows.select(
        F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score"
    )
