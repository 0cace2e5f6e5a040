import hashlib
import random
import re

import pytest

from panelcast.llm.components import components
from panelcast.llm.exact_dedup import exact_groups


def plain(rows):
    normal = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    out = []
    for (d, _), n in zip(rows, normal, strict=True):
        same = [x for (x, _), m in zip(rows, normal, strict=True) if m == n]
        ids = [x for x in same if x is not None]
        out.append((d, min(ids) if ids else None, len(same), hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block,buckets", [(3, 2), (16_384, 64)])
def test_groups(spark, block, buckets):
    rng = random.Random(4)
    texts = ["", None, " ", "\n\t", "a b", "a  b", "a\r\nb", "a b ", "a\xa0b", "é" * 50, "é" * 49] + ["ab" * n for n in range(12)] + ["abcabc" * 7, "abcabc" * 7 + "x"]
    rows = [(i, rng.choice(texts)) for i in range(150)] + [(None, "a b"), (None, "only null"), (7, "a b"), (7, "a b")]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, kept int").repartition(4)
    got = exact_groups(docs, block=block, buckets=buckets).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == plain(rows)
    stays = [r for r in got if r.kept]
    assert len({r.text_sha256 for r in stays}) == len(stays) == len({r.text_sha256 for r in got})
    assert all(r.doc_id == r.keep_id for r in stays)


def test_empty_table(spark):
    assert exact_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(10, 60)] + [(200, x) for x in range(300, 340)] + [(5, 5), (7, 8), (8, 7), (7, 8)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 10 for i in range(10, 61)} | {x: 200 for x in [200, *range(300, 340)]} | {5: 5, 7: 7, 8: 7}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
