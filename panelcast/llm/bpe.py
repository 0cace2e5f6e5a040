"""BPE encoding and decoding with a lexicon of frequent words.

The frequent words of the corpus and their token ids are compiled into a minimal acyclic transducer: an automaton whose
words share prefixes and suffixes, where the outputs along a word's path add up to its number, and numbers point at id
lists. The file is mapped into the memory of the tasks. A batch looks its distinct words up all together, one byte of
every word at a step. Words that the lexicon lacks are merged exactly, also all together: each round applies to each word
its leftmost lowest-ranked merge. So the lexicon decides only speed, never ids.

A text is cut at ASCII white space, which neither the normaliser nor the word pattern ever crosses; each distinct
run between is normalised and split once a batch.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.mapped import opened, publish
from panelcast.llm.tables import slices, tidied
from panelcast.llm.words import distinct_runs
from panelcast.session import cut_lineage

LEXICON = 1 << 17  # words
COUNTED = 300_000  # distinct words a task holds while it counts
LONG = 64  # bytes from which a word is merged by itself
NONE = np.iinfo(np.int64).max


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: bytes that are printable
    Latin-1 stand for themselves, the others take the code points from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(other)) for b in range(256)]


class Tokenizer:
    """The parts of a tokenizer file for word BPE: normaliser NFC, white space, lower case; a word pattern; byte
    symbols; merges with an end-of-word suffix; no decoder. Other files are refused."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps = spec["model"], [n["type"] for n in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        kinds = (model["type"], steps, split["behavior"], split["invert"], spec["decoder"], spec["post_processor"], model["dropout"], model["unk_token"])
        if kinds != ("BPE", ["NFC", "Replace", "Lowercase"], "Removed", True, None, None, None, None):
            raise ValueError(f"not a word BPE file of the known kind: {path}")
        self.pattern, suffix = split["pattern"]["Regex"], model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for text, i in {**vocab, **self.special}.items():
            self.pieces[i] = text
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], dtype=np.int64)
        self.final = np.array([vocab[s + suffix] for s in symbols], dtype=np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order
        self.joined = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)[order]
        self._compiled()

    def _compiled(self) -> None:
        self.split = regex.compile(self.pattern)
        self.mark = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.opening = next(iter(self.special))[:1].encode() if self.special else None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("split", "mark")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._compiled()

    def words(self, run: str) -> list[str | int]:
        """The words of a text, as they are merged, and the ids of special tokens in it."""
        if run.isascii() and run.isalpha():
            return [run.lower()]
        parts = self.mark.split(run) if self.mark and "<" in run else [run]
        out: list[str | int] = []
        for i, part in enumerate(parts):
            if i % 2:
                out.append(self.special[part])
            elif part:
                # letter by letter: a capital sigma does not look at its place in the word
                out += self.split.findall(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower())
        return out

    def merged(self, words: list[bytes]) -> list[np.ndarray]:
        """Token ids of words that are not empty."""
        out: list[np.ndarray | None] = [None] * len(words)
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = self._merged_alone(w)
        if not short:
            return out
        length = np.array([len(words[i]) for i in short])
        flat = np.frombuffer(b"".join([words[i] for i in short]), dtype=np.uint8)
        symbol, word = self.inner[flat], np.repeat(np.arange(len(short)), length)
        ends = np.cumsum(length) - 1
        symbol[ends] = self.final[flat[ends]]
        while len(symbol):
            key = (symbol[:-1] << 32) | symbol[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            fits = (self.keys[at] == key) & (word[:-1] == word[1:])
            best = np.full(len(symbol), NONE)
            where = np.flatnonzero(fits)
            best[where] = (self.rank[at[where]] << 32) | where
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(best, first)
            done = least == NONE
            size = np.diff(np.append(first, len(symbol)))
            for f, n in zip(first[done], size[done], strict=True):
                out[short[word[f]]] = symbol[f : f + n]
            left = least[~done] & 0xFFFFFFFF
            symbol = symbol.copy()
            symbol[left] = self.joined[at[left]]
            keep = np.repeat(~done, size)
            keep[left + 1] = False
            symbol, word = symbol[keep], word[keep]
        return out

    def _merged_alone(self, word: bytes) -> np.ndarray:
        """One long word, by a queue of its merges."""
        flat = np.frombuffer(word, dtype=np.uint8)
        symbol = [*self.inner[flat[:-1]].tolist(), int(self.final[flat[-1]])]
        after, before = [*range(1, len(symbol)), -1], [-1, *range(len(symbol) - 1)]
        queue: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0:
                key = (symbol[i] << 32) | symbol[j]
                at = int(np.searchsorted(self.keys, key))
                if at < len(self.keys) and self.keys[at] == key:
                    heapq.heappush(queue, (int(self.rank[at]), i, key, at))

        for i in range(len(symbol) - 1):
            offer(i)
        while queue:
            _, i, key, at = heapq.heappop(queue)
            j = after[i]
            if symbol[i] < 0 or j < 0 or (symbol[i] << 32) | symbol[j] != key:
                continue
            symbol[i], symbol[j] = int(self.joined[at]), -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return np.array([s for s in symbol if s >= 0], dtype=np.int64)


def automaton(words: list[bytes]) -> dict[str, np.ndarray]:
    """The minimal acyclic automaton of sorted distinct words. Edge arrays, sorted by (state, byte): `edge`
    (state * 256 + byte), `target` and `output`; `final` by state. Outputs along the path of a word add up to its number."""
    register: dict[tuple, int] = {}
    finals: list[bool] = []
    edges: list[tuple] = []

    def fixed(node: list) -> int:
        """The state for a node whose children are states already: one for all nodes with the same right language."""
        key = (node[0], tuple(node[1]))
        state = register.get(key)
        if state is None:
            state = register[key] = len(finals)
            finals.append(node[0])
            edges.append(key[1])
        return state

    path: list[list] = [[False, []]]  # nodes of the last word, open: [final, edges]
    last = b""
    for word in words:
        same = 0
        while same < len(last) and same < len(word) and last[same] == word[same]:
            same += 1
        while len(path) > same + 1:
            state = fixed(path.pop())
            path[-1][1].append((last[len(path) - 1], state))
        for _ in word[same:]:
            path.append([False, []])
        path[-1][0] = True
        last = word
    while len(path) > 1:
        state = fixed(path.pop())
        path[-1][1].append((last[len(path) - 1], state))
    root = fixed(path.pop())
    below = []  # words from each state; children come before their parents
    edge, target, output = [], [], []
    for state, (final, out) in enumerate(zip(finals, edges, strict=True)):
        total = int(final)
        for byte, to in out:
            edge.append(state * 256 + byte)
            target.append(to)
            output.append(total)
            total += below[to]
        below.append(total)
    return {
        "edge": np.array(edge, dtype=np.int64), "target": np.array(target, dtype=np.int32), "output": np.array(output, dtype=np.int32),
        "final": np.array(finals, dtype=bool), "root": np.array([root], dtype=np.int64),
    }


def numbers(lexicon: dict[str, np.ndarray], words: list[bytes]) -> np.ndarray:
    """The number of each word in the automaton, -1 for words it lacks."""
    length = np.array([len(w) for w in words], dtype=np.int64)
    flat = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.int64)
    begin = np.cumsum(length) - length
    state = np.full(len(words), lexicon["root"][0])
    number = np.zeros(len(words), dtype=np.int64)
    rows, step = np.flatnonzero(length > 0), 0
    edge = lexicon["edge"]
    while len(rows):
        key = state[rows] * 256 + flat[begin[rows] + step]
        at = np.minimum(np.searchsorted(edge, key), max(len(edge) - 1, 0))
        there = edge[at] == key if len(edge) else np.zeros(len(rows), dtype=bool)
        state[rows[~there]] = -1
        rows, at = rows[there], at[there]
        state[rows] = lexicon["target"][at]
        number[rows] += lexicon["output"][at]
        step += 1
        rows = rows[length[rows] > step]
    known = state >= 0
    known[known] = lexicon["final"][state[known]]
    return np.where(known, number, -1)


def compiled(tokenizer: Tokenizer, words: list[str]) -> dict[str, np.ndarray]:
    """The transducer of a set of words: the automaton and the ids of word number n at ids[first[n]:first[n + 1]]."""
    data = sorted({w.encode() for w in words if w})
    ids = tokenizer.merged(data)
    first = np.concatenate([[0], np.cumsum([len(i) for i in ids], dtype=np.int64)]).astype(np.int64)
    flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
    return automaton(data) | {"ids": flat, "first": first}


def ragged(flat: np.ndarray, first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists flat[first[r]:first[r + 1]] of many rows behind one another, and where each begins."""
    size = first[rows + 1] - first[rows]
    begin = np.concatenate([[0], np.cumsum(size)])
    return flat[np.repeat(first[rows] - begin[:-1], size) + np.arange(begin[-1])], begin


def encoded(tokenizer: Tokenizer, lexicon: dict[str, np.ndarray], column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of a batch of texts behind one another, and where those of each text begin."""
    runs, inverse, _, before = distinct_runs(column)
    parts = [tokenizer.words(r) for r in runs]
    slot: dict[str, int] = {}
    index = [slot.setdefault(w, len(slot)) if isinstance(w, str) else -1 - w for p in parts for w in p]
    words = [w.encode() for w in slot]
    number = numbers(lexicon, words)
    unseen = np.flatnonzero(number < 0)
    lists: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
    for i, ids in zip(unseen, tokenizer.merged([words[i] for i in unseen]), strict=True):
        lists[i] = ids
    seen = np.flatnonzero(number >= 0)
    flat, begin = ragged(lexicon["ids"], lexicon["first"], number[seen])
    for i, a, b in zip(seen.tolist(), begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        lists[i] = flat[a:b]
    marks = sorted({-1 - i for i in index if i < 0})
    place = {-1 - m: len(words) + k for k, m in enumerate(marks)}
    lists += [np.array([m]) for m in marks]
    first = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    flat = np.concatenate([np.zeros(0, np.int64), *lists]).astype(np.int64)
    by_word, begin = ragged(flat, first, np.array([i if i >= 0 else place[i] for i in index], dtype=np.int64))
    size = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    run_first = begin[size]
    ids, run_begin = ragged(by_word, run_first, inverse)
    return ids, run_begin[before]


def decoded(pieces: list[str], ids: list[int]) -> str:
    """The text that ids stand for: a file without a decoder joins the pieces by spaces."""
    return " ".join([pieces[i] for i in ids])


def _count(tokenizer: Tokenizer):
    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for part in slices(batch, "text"):
                runs, _, count, _ = distinct_runs(part.column("text"))
                for r, n in zip(runs, count.tolist(), strict=True):
                    for w in tokenizer.words(r):
                        if isinstance(w, str) and len(w) <= LONG:
                            counts[w] += n
                if len(counts) > COUNTED:
                    yield rows(counts)
                    counts = Counter()
        yield rows(counts)

    return run


def frequent_words(docs: DataFrame, tokenizer: Tokenizer, text_col: str = "text", limit: int = LEXICON) -> list[str]:
    """The most frequent words of all texts, `limit` at most; all words of one count come in or stay out together."""
    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(tidied(_count(tokenizer)), "word string, n long")
    counts = cut_lineage(counts.groupBy("word").agg(F.sum("n").alias("n")).where("n > 1"))
    least, room = None, limit
    for n, words in counts.groupBy("n").count().orderBy(F.desc("n")).limit(limit).collect():
        if words > room:
            break
        least, room = n, room - words
    return [] if least is None else counts.where(F.col("n") >= least).select("word").toArrow()["word"].to_pylist()


def _encode(tokenizer: Tokenizer, name: str, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = opened(name)
        names = [str(i) for i in range(len(tokenizer.pieces))]
        for batch in batches:
            for part in slices(batch, "text"):
                ids, begin = encoded(tokenizer, lexicon, part.column("text"))
                if not digests:
                    lists = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(ids, pa.int32()))
                    yield pa.RecordBatch.from_arrays([part.column("id"), lists], ["id", "ids"])
                    continue
                own, back = [], []
                for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
                    some = ids[a:b].tolist()
                    own.append(hashlib.sha256(" ".join([names[i] for i in some]).encode()).hexdigest())
                    back.append(hashlib.sha256(decoded(tokenizer.pieces, some).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(np.diff(begin), pa.int64()), pa.array(own), pa.array(back)],
                    ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return run


def _run(docs: DataFrame, path: str, id_col: str, text_col: str, lexicon: int, digests: bool) -> DataFrame:
    spark: SparkSession = docs.sparkSession
    tokenizer = Tokenizer(path)
    name = publish(spark, compiled(tokenizer, frequent_words(docs, tokenizer, text_col, lexicon)))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    kind = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "id long, ids array<int>"
    return texts.mapInArrow(tidied(_encode(tokenizer, name, digests)), kind).withColumnRenamed("id", id_col)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lexicon: int = LEXICON) -> DataFrame:
    """id and token `ids` of every row; null and empty texts have none. Repeated rows are encoded each; an id may be
    null; other columns are not read. Fitting the lexicon reads all texts once."""
    return _run(docs, path, id_col, text_col, lexicon, digests=False)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lexicon: int = LEXICON) -> DataFrame:
    """`encode`, then `decode`, as digests: id, n_tokens, ids_sha256 (decimal ids joined by one space), decoded_sha256."""
    return _run(docs, path, id_col, text_col, lexicon, digests=True)


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and the `text` that its ids stand for; null for null ids. An id outside the vocabulary is an error."""
    pieces = Tokenizer(path).pieces

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if i is None else decoded(pieces, i) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    ids = rows.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids"))
    return ids.mapInArrow(tidied(run), "id long, text string").withColumnRenamed("id", id_col)
