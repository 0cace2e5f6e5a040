"""Functions that run inside tasks must load where this package is not installed."""

import subprocess
import sys
from functools import partial

import public_tokenizers
import pytest
from pyspark import cloudpickle

from panelcast.llm import bpe, conversation_repair, exact_dedup, html_wrappers, langid, lattice, lm, mixing, ngram_join, packing, secret_scan, whitening

MODEL = langid.Model([])
FUNCTIONS = {
    "blocks": exact_dedup._blocks(10, 10),
    "prefixes": ngram_join._prefixes(5, (3, 4)),
    "whole": ngram_join._whole(5),
    "shared": ngram_join._shared,
    "compare": ngram_join._compare((3, 4)),
    "encode": bpe._encode(bpe.Tokenizer(public_tokenizers.path("word_bpe_49k.json")), "x", True),
    "signed": lattice._signed(2, 2, 1.0, 1),
    "cells": lattice._compare(0.9, 2, 2),
    "sizes": mixing._sizes,
    "scan": secret_scan._scan(10),
    "predict": langid._predict(MODEL),
    "words": langid._count_words,
    "grams": langid._count_grams,
    "familiarity": langid._familiarity("x"),
    "pieces": packing._pieces(bpe.Tokenizer(public_tokenizers.path("word_bpe_49k.json")), 16, 1, True),
    "shard": packing._shard(16, True),
    "factor": whitening._factor([0, 0], 1),
    "stacked": whitening._stacked(2),
    "symbols": conversation_repair._pieces,
    "report": conversation_repair._report,
    "replay": conversation_repair._replay(True),
    "learn": html_wrappers._learn,
    "unite": partial(html_wrappers._unite, last=True),
    "extract": html_wrappers._extract,
    "read": lm._read(2),
    "numbered": lm._words(2),
    "level": lm._grams(2, 2),
    "ask": lm._ask(2, 2, 1),
    "score": lm._score(2, 1, 1, 1),
}


@pytest.mark.parametrize("name", FUNCTIONS)
def test_loads_without_the_package(name, tmp_path):
    (tmp_path / "f").write_bytes(cloudpickle.dumps(FUNCTIONS[name]))
    code = "from pyspark import cloudpickle; assert callable(cloudpickle.load(open('f', 'rb')))"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin", "PYTHONPATH": ""}, timeout=60)
