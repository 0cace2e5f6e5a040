"""Secret scans that link the parts of a credential.

Three kinds are findings by themselves: `assign` (a value assigned to a telling name), `access` (an access key id)
and `hex` (a long hexadecimal run). Three more are weak, common in clean text, and are reported only when the parts
complete one another inside a scope:

- `key`      a long mixed token that may be the secret half of a key pair,
- `id`       a value named as a user, client or account,
- `endpoint` a host or URL that such a pair may open.

A scope reaches `reach` characters from the part, within the same paragraph (no blank line between). A `key` needs an access
identifier (`access` or `id`) or an assigned secret in its scope; an `id` needs a secret (`assign`, `hex` or `key`) and an
endpoint; an `endpoint` needs both an access identifier and a secret. The link is a join of intervals sorted by place:
two binary searches a part, in time n log n, with no pair written out. All parts of a scope come from one text, so
nothing is shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from panelcast.llm.tables import slices

BASE = ("assign", "access", "hex")
WEAK = ("key", "id", "endpoint")
KINDS = BASE + WEAK
REACH = 400

# The patterns of the base findings and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18

KEY = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
ID = re.compile(r"""(?:user(?:name)?|client_?id|account(?:_?id)?|access_?key_?id|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+/_.=-]{3,})""", re.I | re.A)
ENDPOINT = re.compile(r"""(?:https?|ftps?|ssh|jdbc:[a-z]+|mongodb|postgres(?:ql)?|mysql|redis|amqps?)://[^\s"'<>]+|\b(?:host|endpoint|server|url)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.:/-]{4,}""", re.I | re.A)
HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
PARAGRAPH = re.compile(r"\n[ \t\r]*\n")
HEX_CLASS = bytes(1 if chr(c) in "0123456789abcdef" else 0 for c in range(256))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the findings that stand by themselves, each kind without overlaps. The span of `assign` is
    the whole match, name and value."""
    found = []
    low = text.lower()
    if any(h in low for h in HINTS):
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    if b"\1" * 16 in text.encode("utf-8", "surrogatepass").translate(HEX_CLASS):
        found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return found


def _mixed(token: str) -> bool:
    """Upper case, lower case and digits, and more different characters than a word or a counter has."""
    return bool(re.search("[a-z]", token) and re.search("[A-Z]", token) and re.search("[0-9]", token)) and len(set(token)) >= 10


def weak_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """(start, end, kind) of parts that mean nothing alone, outside the base findings."""
    parts = [(*m.span(), "key") for m in KEY.finditer(text) if _mixed(m[0])]
    parts += [(*m.span(), "id") for m in ID.finditer(text)]
    parts += [(*m.span(), "endpoint") for m in ENDPOINT.finditer(text)]
    taken = sorted(base)
    starts = [s for s, _, _ in taken]
    ends = np.maximum.accumulate([e for _, e, _ in taken]) if taken else []
    free = []
    for part in parts:
        before = bisect_left(starts, part[1])
        if part[2] == "endpoint" or not before or ends[before - 1] <= part[0]:
            free.append(part)
    return free


def linked(base: list[tuple[int, int, str]], weak: list[tuple[int, int, str]], breaks: list[int], reach: int) -> list[tuple[int, int, str]]:
    """The weak parts whose complement lies in their scope."""
    place: dict[str, list[int]] = {}
    for start, _, kind in sorted(base + weak):
        place.setdefault(kind, []).append(start)

    def near(part: tuple[int, int, str], kinds: tuple[str, ...]) -> bool:
        cell = bisect_right(breaks, part[0])
        low = max(part[0] - reach, breaks[cell - 1] if cell else 0)
        high = min(part[1] + reach, breaks[cell] if cell < len(breaks) else part[1] + reach)
        return any(bisect_left(at, low) < bisect_left(at, high) for at in (place.get(k, ()) for k in kinds))

    needs = {
        "key": (("access", "id", "assign"),),
        "id": (("assign", "hex", "key"), ("endpoint",)),
        "endpoint": (("access", "id"), ("assign", "hex", "key")),
    }
    return [p for p in weak if all(near(p, kinds) for kinds in needs[p[2]])]


def findings(text: str, reach: int = REACH) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base findings and linked weak ones, by start, then kind as listed in KINDS."""
    base = base_spans(text)
    extra = []
    # without an identifier or an assigned secret no part can be linked: `key` needs one, the others need one too
    if any(k != "hex" for _, _, k in base) or ID.search(text):
        weak = weak_spans(text, base)
        extra = linked(base, weak, [m.end() for m in PARAGRAPH.finditer(text)], reach) if weak else []
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(base, key=lambda x: (x[0], order[x[2]])), sorted(extra, key=lambda x: (x[0], order[x[2]]))


def _scan(reach: int):
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = {k: i for i, k in enumerate(KINDS)}
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for text in part.column("text").to_pylist():
                    base, extra = findings(text or "", reach)
                    every = [(*x, True) for x in base] + [(*x, False) for x in extra]
                    every.sort(key=lambda x: (x[0], order[x[2]]))
                    out.append([{"kind": k, "start": s, "end": e, "base": b} for s, e, k, b in every])
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(out, pa.list_(span))], ["id", "spans"])

    return run


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """id and `spans` (kind, start, end in code points, end exclusive; base: stands by itself) of every row, ordered by
    start, then kind. Null and empty texts have no spans; repeated rows are scanned each; other columns are not read."""
    texts = docs.selectExpr(f"cast(`{id_col}` as bigint) AS id", f"`{text_col}` AS text")
    spans = texts.mapInArrow(_scan(reach), "id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>")
    return spans.withColumnRenamed("id", id_col)
