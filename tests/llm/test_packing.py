import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer as Library

from panelcast.llm import packing
from panelcast.llm.bpe import Tokenizer
from panelcast.llm.queries import op13_best_fit_packing

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def library():
    return Library.from_file(PATH)


def expected(library, rows, size):
    """(id, piece, start, length, crc) of every piece, text by text."""
    out = []
    for i, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        out += [(i, k, a, len(ids[a : a + size]), zlib.crc32(ids[a : a + size].tobytes())) for k, a in enumerate(range(0, len(ids), size))]
    return sorted(out, key=repr)


def check_places(rows, size):
    """Pieces of a sequence follow one another from 0 and fit; the number of sequences."""
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= size
    return len(by)


def plain_placed(lengths, size):
    """The sum of squares of every choice, written out."""
    gaps, into = [], []
    for n in lengths:
        if n == size:
            gaps.append(0)
            into.append(len(gaps) - 1)
            continue
        choices = []
        for at, gap in [*enumerate(gaps), (len(gaps), size)]:
            if gap >= n and (gap > 0):
                after = [*gaps, size][: max(len(gaps), at + 1)]
                after[at] = gap - n
                count = defaultdict(int)
                for g in after:
                    count[g] += 0 < g < size
                choices.append((sum(c * c for c in count.values()), gap, -at))
        _, gap, at = min(choices)
        if -at == len(gaps):
            gaps.append(size)
        gaps[-at] = gap - n
        into.append((gap, -at))
    return sum(g < size for g in gaps), sorted(gaps)


def test_places_by_sum_of_squares():
    rng = random.Random(1)
    for _ in range(60):
        size = rng.choice([7, 12, 30])
        lengths = np.array([rng.randint(1, size) for _ in range(rng.randint(0, 40))], dtype=np.int64)
        into, offset = packing.placed(lengths, size)
        fill = np.bincount(into, weights=lengths) if len(into) else np.zeros(0)
        count, gaps = plain_placed(lengths.tolist(), size)
        assert len(fill) == count and sorted((size - fill).astype(int).tolist()) == gaps
        again, _ = packing.best(np.sort(lengths)[::-1], size)
        assert len(set(again.tolist())) <= len(set(packing.placed(np.sort(lengths)[::-1], size)[0].tolist()))


def test_all_documents(spark, library):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = op13_best_fit_packing(spark, SF).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == expected(library, docs, 4096)
    used, least = check_places(got, 4096), -(-sum(r.length for r in got) // 4096)
    assert used <= least + 1 + least // 100


def test_edge_rows(spark, library):
    words = "Ünï-code á don't <|endoftext|> 12 x" + "y" * 300
    rows = [(1, None, 5), (2, "", 5), (2, "", 5), (None, words, 5), (3, " \t\n", 5), (4, words * 40, 5), (5, "a\x1cb\x85c", 5), (6, "<|endoftext|>" * 9, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row long")
    for size, shard in ((16, 1000), (16, 5), (64, 1000)):
        got = packing.packed(docs, PATH, size=size, shard=shard, keep_ids=True).collect()
        assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == expected(library, [r[:2] for r in rows], size)
        check_places(got, size)
        assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32 for r in got)
    empty = packing.packed(docs.limit(0), PATH)
    assert empty.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and empty.count() == 0


def test_sequences_hold_their_pieces(spark, library):
    docs = spark.createDataFrame([(i, "word " * (i % 9) + str(i)) for i in range(200)], "doc_id long, text string")
    rows = packing.packed(docs, PATH, size=32, keep_ids=True).cache()
    whole = {r.sequence_id: r for r in packing.filled(rows).collect()}
    for r in rows.collect():
        assert whole[r.sequence_id].ids[r.offset : r.offset + r.length] == r.ids and whole[r.sequence_id].length <= 32
    total = sum(len(library.encode("word " * (i % 9) + str(i), add_special_tokens=False).ids) + 1 for i in range(200))
    assert sum(r.length for r in whole.values()) == total


def test_shards_cost_few_sequences(spark):
    rng = np.random.default_rng(3)
    lengths = np.minimum(4095, np.exp(rng.normal(6.3, 0.9, 6000)).astype(int) + 2)
    pieces = spark.createDataFrame(enumerate(lengths.tolist()), "row long, length long").cache()
    one = packing.sequences_of(pieces).select("key").distinct().count()
    many = packing.sequences_of(pieces, shard=500).select("key").distinct().count()
    assert one <= -(-lengths.sum() // 4096) + 3 and many <= one + 6


def test_long_texts_in_windows(monkeypatch):
    monkeypatch.setattr(packing, "WINDOW", 50)
    text = " ".join(f"word{i}" + "z" * (i % 70) for i in range(300))
    assert "".join(packing.windows(text, 50)) == text
    runs = packing.Runs(Tokenizer(PATH))
    whole, _ = runs.ids(pa.array([text]))
    parts = [packing.Runs(Tokenizer(PATH)).ids(pa.array([w]))[0] for w in packing.windows(text, 50)]
    assert np.concatenate(parts).tolist() == whole.tolist()


def test_what_is_forgotten_is_encoded_again(monkeypatch, library):
    monkeypatch.setattr(packing, "REMEMBERED", 100)
    runs = packing.Runs(Tokenizer(PATH))
    for texts in (["a b c", None, "b"], ["c d", ""], ["a b c d e f"] * 3):
        ids, begin = runs.ids(pa.array(texts, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(begin[:-1], begin[1:], strict=True)] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
