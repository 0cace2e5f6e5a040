import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer as Library

from panelcast.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "", None, " \n", "Hello, World!", "it's WE'LL 'S don't", "ÀÉÎ ño é Σίσυφος ΟΔΟΣ İstanbul ß", "a b c　d", "12345 3.14 ½²", "日本語テキスト 한국어 العربية",
    "😀😀👨‍👩‍👧 tags", "<|startoftext|>a<|endoftext|> <|endoftext|", "x<|ENDOFTEXT|>", "a" * 70, "ab" * 700 + " " + "z" * 65, "!!!???...--- *** &&&", "\x00\x01\x7f ok", "́x ́", "thontion " * 3000,
    "line\r\nbreak\ttab\x0bvt\x0cff\x85nel ls", "aaaaaaa bbbbbb abababab", "ǅ ŉ ﬁ K Å",
]


@pytest.fixture(scope="module")
def library():
    own = Library.from_file(PATH)
    own.no_truncation()
    own.no_padding()
    return own


@pytest.mark.parametrize("words", [[], ["hello", "world", "thontion", "don", "日本語"]])
def test_encoded_equals_library(library, words):
    own = bpe.Tokenizer(PATH)
    rng = random.Random(1)
    letters = "abcdeéßΣ'!. \n1Ω日"
    texts = TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 90))) for _ in range(300)]
    ids, begin = bpe.encoded(own, bpe.compiled(own, words), pa.array(texts))
    for i, text in enumerate(texts):
        want = library.encode(text or "", add_special_tokens=False).ids
        got = ids[begin[i] : begin[i + 1]].tolist()
        assert got == want, text
        assert bpe.decoded(own.pieces, got) == library.decode(want, skip_special_tokens=False)


def test_automaton_is_minimal_and_numbers_words():
    words = sorted({w.encode() for w in ("tap", "taps", "top", "tops", "stop", "stops", "é", "x")})
    found = bpe.automaton(words)
    assert bpe.numbers(found, words).tolist() == list(range(len(words)))
    assert bpe.numbers(found, [b"", b"ta", b"tapss", b"q", "è".encode()]).tolist() == [-1] * 5
    right = {}
    for w in words:  # states of the minimal automaton: different sets of endings
        for i in range(len(w) + 1):
            right.setdefault(w[:i], set()).add(w[i:])
    assert len(found["final"]) == len({frozenset(v) for v in right.values()})
    assert bpe.numbers(bpe.automaton([]), [b"a"]).tolist() == [-1]


def test_long_word_equals_rounds():
    own = bpe.Tokenizer(PATH)
    rng = random.Random(2)
    for _ in range(50):
        word = "".join(rng.choice("abcther") for _ in range(rng.randint(2, 60))).encode()
        assert own._merged_alone(word).tolist() == own.merged([word])[0].tolist()


def test_round_trip(spark, library):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, "none", "c"), (3, TEXTS[3], "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.round_trip(docs, PATH, lexicon=40).collect()
    assert len(got) == len(rows)
    texts = {i: t for i, t, _ in rows}
    for r in got:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
    ids = bpe.encode(docs, PATH)
    assert {r.doc_id: r.text for r in bpe.decode(ids, PATH).collect()}[3] == "hello</w> ,</w> world</w> !</w>"
    assert bpe.round_trip(docs.limit(0), PATH).count() == 0
