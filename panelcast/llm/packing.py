"""Documents as token sequences of a fixed size: sum-of-squares packing.

A document is its token ids and an end id. Only documents longer than a sequence are cut, into whole sequences and a rest; every other
piece stays in one. A piece goes into the open sequence (or a new one) after which the sum, over all residual gaps, of the
squared number of open sequences with that gap is smallest: that keeps many different gaps open, so that later pieces find one they
fill exactly. Of equal choices the smallest gap is taken. Longer pieces come first.

The pieces are dealt by hash into shards of bounded size, each packed by one task from lengths alone, not from ids. Sequences
that a shard leaves unfilled are emptied, and their pieces are packed again over fewer shards, until one shard is left or nothing
is gained. So the number of sequences hardly depends on the number of shards.

Ids are those of the tokenizers library. A text is cut at ASCII white space, which neither the normaliser nor the word pattern of the
file ever crosses, and a task encodes each distinct run between once, as long as it remembers it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.bpe import Tokenizer, ragged
from panelcast.llm.tables import slices
from panelcast.llm.words import SPACE, named, spans, text_bytes
from panelcast.session import cut_lineage

SIZE = 4096  # tokens of a sequence
END = 1  # id after each document
SHARD = 400_000  # pieces that one task packs
FILLED = 0.98  # share from which a sequence of one of several shards is left as it is
REMEMBERED = 24 << 20  # bytes of runs and their ids a task remembers before it starts anew
WINDOW = 4 << 20  # bytes of text that are encoded at a time
PIECES = "row long, id long, piece int, start long, length long, ids_crc32 long"


class Runs:
    """Token ids of the runs between white space that a task has met, found by a 64-bit name."""

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer = tokenizer
        self._forget()

    def _forget(self) -> None:
        self.names, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.first = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _encoded(self, runs: list[str]) -> list[np.ndarray]:
        """The ids of each run: its distinct words are merged all together."""
        parts = [self.tokenizer.words(r) for r in runs]
        words = list({w: None for p in parts for w in p if isinstance(w, str)})
        ids = dict(zip(words, self.tokenizer.merged([w.encode() for w in words]), strict=True))
        ids |= {w: np.array([w]) for p in parts for w in p if isinstance(w, int)}  # special tokens
        none = np.zeros(0, np.int64)
        return [ids[p[0]] if len(p) == 1 else np.concatenate([none, *[ids[w] for w in p]]) for p in parts]

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of a batch of texts behind one another, and where those of each text begin (and the last end)."""
        data, bounds = text_bytes(column)
        start, end = spans(data)
        name, first, inverse = np.unique(named(data, start, end), return_index=True, return_inverse=True)
        if self.flat.nbytes + 32 * len(self.names) > REMEMBERED:
            self._forget()
        at = np.minimum(np.searchsorted(self.names, name), max(len(self.names) - 1, 0))
        fresh = np.flatnonzero(self.names[at] != name) if len(self.names) else np.arange(len(name))
        if len(fresh):
            raw = data.tobytes()
            lists = self._encoded([raw[a:b].decode() for a, b in zip(start[first[fresh]].tolist(), end[first[fresh]].tolist(), strict=True)])
            slot = len(self.first) - 1 + np.arange(len(fresh))
            self.flat = np.concatenate([self.flat, *lists]).astype(np.int32)
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum([len(x) for x in lists])])
            place = np.searchsorted(self.names, name[fresh])
            self.names, self.slot = np.insert(self.names, place, name[fresh]), np.insert(self.slot, place, slot)
            at = np.searchsorted(self.names, name)
        ids, begin = ragged(self.flat, self.first, self.slot[at][inverse.ravel()] if len(name) else np.zeros(0, np.int64))
        return ids, begin[np.searchsorted(start, bounds)]


def windows(text: str, limit: int) -> Iterator[str]:
    """A text in parts of about `limit` characters, cut at ASCII white space only: a run without any stays whole."""
    at = 0
    while at < len(text):
        stop = at + limit
        while stop < len(text) and not (ord(text[stop]) < 128 and SPACE[ord(text[stop])]):
            stop += 1
        yield text[at:stop]
        at = stop


def _pieces(tokenizer: Tokenizer, size: int, end_id: int, keep_ids: bool):
    def documents(runs: Runs, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each text with its end id, and where each begins."""
        if len(column) == 1 and column[0].is_valid and len(text := column[0].as_py()) > WINDOW:
            ids = np.concatenate([runs.ids(pa.array([w]))[0] for w in windows(text, WINDOW)])
            begin = np.array([0, len(ids)])
        else:
            ids, begin = runs.ids(column)
        begin = begin + np.arange(len(begin))
        out = np.full(int(begin[-1]), end_id, dtype="<u4")
        own = np.ones(len(out), dtype=bool)
        own[begin[1:] - 1] = False
        out[own] = ids
        return out, begin

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, row = Runs(tokenizer), TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices(batch, "text", WINDOW):
                ids, begin = documents(runs, part.column("text"))
                count = -(-np.diff(begin) // size)
                of = np.repeat(np.arange(len(part)), count)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * size
                length = np.minimum(begin[of + 1] - begin[of] - start, size)
                at = begin[of] + start
                raw = memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
                columns = [
                    pa.array(row + np.arange(len(of)), pa.int64()), part.column("id").take(pa.array(of)), pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                ]
                names = ["row", "id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:  # pieces follow one another without a gap
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, begin[-1]), pa.int32()), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                row += len(of)
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def placed(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum-of-squares packing of pieces in the given order: number of the sequence of each piece and its offset there.
    A sequence that is full is open no longer and counts in no square."""
    open_: list[list[int]] = [[] for _ in range(size)]  # sequences by residual gap
    count = np.zeros(size, dtype=np.int64)
    into, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    sequences = 0
    for i, n in enumerate(lengths.tolist()):
        if n >= size:
            into[i], sequences = sequences, sequences + 1
            continue
        # moving a sequence from gap g to g - n changes the sum by 2 (N[g - n] - N[g]) + 2, by 1 - 2 N[n] where it fills up
        gaps = n + np.flatnonzero(count[n:])
        best, change = size, 2 * int(count[size - n]) + 1
        if len(gaps):
            moved = 2 * (count[gaps - n] - count[gaps]) + 2
            if gaps[0] == n:
                moved[0] = 1 - 2 * count[n]
            least = int(moved.argmin())
            if moved[least] <= change:
                best = int(gaps[least])
        if best == size:
            number, sequences = sequences, sequences + 1
        else:
            number = open_[best].pop()
            count[best] -= 1
        into[i], offset[i] = number, size - best
        if best > n:
            open_[best - n].append(number)
            count[best - n] += 1
    return into, offset


def best(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """`placed` for lengths that fall. Sequences that stay unfilled are emptied and their pieces placed again, as long as
    that saves sequences."""
    into, offset = placed(lengths, size)
    rows = np.arange(len(lengths))
    while True:
        fill = np.bincount(into[rows], weights=lengths[rows], minlength=into.max(initial=-1) + 1)
        loose = (fill > 0) & (fill < size * FILLED)
        rows = rows[loose[into[rows]]]
        again, at = placed(lengths[rows], size)
        if again.max(initial=-1) + 1 >= loose.sum():
            return into, offset
        into[rows], offset[rows] = np.flatnonzero(loose)[again], at


def _shard(size: int, last: bool):
    """Packs one shard. `again` marks pieces of sequences that the next round packs anew."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("row", "ascending")])
        lengths = np.asarray(table["length"])
        into, offset = best(lengths, size)
        full = np.bincount(into, weights=lengths) >= size * (0 if last else FILLED)
        return pa.table(
            {
                "row": table["row"], "length": table["length"], "shard": table["shard"],
                "number": pa.array(into), "offset": pa.array(offset), "again": pa.array(~full[into]),
            }
        )

    return run


def sequences_of(pieces: DataFrame, size: int = SIZE, shard: int = SHARD) -> DataFrame:
    """(row, sequence_id, offset) of every row of `pieces` (row, a number of its own; length, 1 to `size`)."""
    whole = pieces.where(F.col("length") >= size).select("row", F.concat(F.lit("w"), "row").alias("key"), F.lit(0).cast("long").alias("offset"))
    left, done, turn = pieces.where(F.col("length") < size).select("row", "length"), whole, 0
    count = left.count()
    while count:
        shards = -(-count // shard)
        dealt = left.withColumn("shard", F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(shards)))
        schema = "row long, length long, shard long, number long, offset long, again boolean"
        packed = cut_lineage(dealt.groupBy("shard").applyInArrow(_shard(size, shards == 1), schema))
        more = packed.where("again").count()
        stop = more * 2 > count  # no shard can fill its sequences: as they are
        rows = packed if stop else packed.where("not again")
        key = F.concat_ws("/", F.lit(turn), "shard", "number")
        done = done.unionByName(rows.select("row", key.alias("key"), "offset"))
        left, count, turn = packed.where("again").select("row", "length"), 0 if stop else more, turn + 1
    return done


def packed(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end_id: int = END,
    shard: int = SHARD, keep_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, piece (from 0), start (ids of its document before it), length, ids_crc32 (of the ids as unsigned
    little-endian 32-bit numbers), sequence_id, offset (its place there; pieces of a sequence follow without a gap from 0), and
    `ids` if asked for.

    A null or empty text is its end id only, so every row has a piece. Repeated rows are packed each; an id may be null. Ties
    are broken by the order in which rows are read. An empty table gives an empty result; other columns are not read."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    pieces = cut_lineage(texts.mapInArrow(_pieces(Tokenizer(path), size, end_id, keep_ids), PIECES + (", ids array<int>" if keep_ids else "")))
    found = sequences_of(pieces, size, shard).select("row", F.xxhash64("key").alias("sequence_id"), "offset")
    columns = [F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return pieces.join(found, "row").select(*columns, *(["ids"] if keep_ids else []))


def filled(rows: DataFrame) -> DataFrame:
    """(sequence_id, length, ids) of every sequence of a result of `packed` with ids: its pieces joined in order of their offset. A
    sequence has `size` ids at most, so nothing unbounded is gathered."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    whole = rows.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
    return whole.select("sequence_id", F.size("ids").cast("long").alias("length"), "ids")
