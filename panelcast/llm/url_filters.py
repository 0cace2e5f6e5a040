"""URL filters: all glob rules over every canonical URL at once, by a bit-parallel automaton.

A URL's canonical form is a dot, its host in lower case and its path: `.www.example.net/en/1`. A glob over it
knows `*` (any run within the host or within one path step: no `/`), `**` (any run), `?` (one byte) and literal bytes; a
backslash takes the next byte literally. Every state of every rule is one bit of a row of 64-bit words. Reading a byte
shifts all states at once (Shift-And); a star is a state that also keeps itself. Rules that span words carry
over between them. Many URLs advance together, longest first, so that a batch costs its longest URL, not each one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLASH = ord("/")


@dataclass(frozen=True)
class Rule:
    """`name` is reported, `glob` is matched; of the rules that match, the largest `weight` wins, then block over
    allow, then the first. A rule without a weight counts as many as its glob has literal bytes."""

    name: str | None
    glob: str
    allow: bool
    weight: int | None = None


def host_rule(host: str, path: str, allow: bool) -> Rule:
    """Fits the host and all its subdomains where the URL's path starts with `path`; the longer rule wins."""
    return Rule(host + path, f"*.{_literal(host)}{_literal(path)}**", allow, len(host + path))


def _literal(text: str) -> str:
    return "".join("\\" + c if c in "*?\\" else c for c in text)


def _parsed(glob: str) -> tuple[list[int | None], dict[int, bool]]:
    """The bytes to read (None: any one) and, by the number read before, the stars (True: also over slashes)."""
    data, reads, stars, i = glob.encode(), [], {}, 0
    while i < len(data):
        if data[i] == ord("*"):
            wide = data[i : i + 2] == b"**"
            stars[len(reads)] = wide or stars.get(len(reads), False)
            i += 1 + wide
            continue
        if data[i] == ord("\\") and i + 1 < len(data):
            i += 1
            reads.append(data[i])
        else:
            reads.append(None if data[i] == ord("?") else data[i])
        i += 1
    return reads, stars


def compiled(rules: Iterable[Rule]) -> dict:
    """Masks of all rules: per byte the states that reading it enters and those that it stays in."""
    rules = list(rules)
    parsed = [_parsed(r.glob) for r in rules]
    width = max(1, -(-sum(len(reads) + 1 for reads, _ in parsed) // 64))
    enter, stay, start = np.zeros((256, width), np.uint64), np.zeros((256, width), np.uint64), np.zeros(width, np.uint64)
    last, bit = [], 0
    not_slash = np.arange(256) != SLASH
    for reads, stars in parsed:
        start[bit // 64] |= np.uint64(1 << bit % 64)
        for k in range(len(reads) + 1):
            word, flag = (bit + k) // 64, np.uint64(1 << (bit + k) % 64)
            if k:
                enter[slice(None) if reads[k - 1] is None else reads[k - 1], word] |= flag
            if k in stars:
                stay[slice(None) if stars[k] else not_slash, word] |= flag
        last.append(bit + len(reads))
        bit += len(reads) + 1
    weight = [len(reads) if r.weight is None else r.weight for r, (reads, _) in zip(rules, parsed, strict=True)]
    order = sorted(range(len(rules)), key=lambda i: (-weight[i], rules[i].allow, i))
    return {"enter": enter, "stay": stay, "start": start, "last": last, "order": order}


def matched(masks: dict, urls: list[bytes]) -> np.ndarray:
    """Per URL the number of the rule that wins, -1 where none matches."""
    enter, stay, last = masks["enter"], masks["stay"], masks["last"]
    length = np.array([len(u) for u in urls], dtype=np.int64)
    order = np.argsort(-length, kind="stable")
    flat = np.frombuffer(b"".join(urls), dtype=np.uint8)
    begin = (np.cumsum(length) - length)[order]
    ends = length[order]
    state = np.tile(masks["start"], (len(urls), 1))
    open_ = len(urls)
    for at in range(int(length.max(initial=0))):
        while open_ and ends[open_ - 1] <= at:
            open_ -= 1
        byte = flat[begin[:open_] + at]
        now = state[:open_]
        moved = now << np.uint64(1)
        moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
        state[:open_] = (moved & enter[byte]) | (now & stay[byte])
    won = np.full(len(urls), -1)
    for rule in reversed(masks["order"]):
        won[(state[:, last[rule] // 64] >> np.uint64(last[rule] % 64)) & np.uint64(1) == 1] = rule
    out = np.empty_like(won)
    out[order] = won
    return out


def _judge(rules: list[Rule], otherwise: bool) -> Callable[[Column], Column]:
    masks = compiled(rules)
    names = np.array([r.name for r in rules] + [None], dtype=object)
    verdicts = np.array(["allow" if r.allow else "block" for r in rules] + ["allow" if otherwise else "block"], dtype=object)

    @F.pandas_udf(T.StructType([T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())]))
    def judge(urls: pd.Series) -> pd.DataFrame:
        won = matched(masks, [u.encode() for u in urls])
        return pd.DataFrame({"rule": names[won], "verdict": verdicts[won]})

    return judge


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased; path: from there up to ?, # or the end.
    Both empty for a null or a text without ://."""
    parts = r"://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, parts, 1), UPPER, LOWER), F.regexp_extract(text, parts, 2)


def judged(pages: DataFrame, rules: list[Rule], url_col: str = "url", id_col: str = "page_id", otherwise: bool = True) -> DataFrame:
    """id, host, path, rule (null if none matches or the rule has no name) and verdict (`allow` or `block`) of every
    row; `otherwise` is the verdict where no rule matches. Null URLs and texts without :// are judged as an empty host and path.
    Repeated rows give repeated results, other columns are not read, an empty table gives an empty result."""
    host, path = host_and_path(F.col(url_col))
    parts = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    found = parts.withColumn("_found", _judge(rules, otherwise)(F.concat(F.lit("."), "host", "path")))
    return found.select(id_col, "host", "path", "_found.rule", "_found.verdict")
