"""Words of whole texts as 64-bit names, for many documents at a time.

A word is a longest run of bytes outside space and tab..carriage return, with A-Z lower-cased. It is named by
a 64-bit hash of its bytes, computed eight bytes at a time over the whole batch, so that no Python object is
made for a word. Nothing is cut: a text of any length is one run of positions in the batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

GOLD = np.uint64(0x9E3779B97F4A7C15)
MIX1 = np.uint64(0xBF58476D1CE4E5B9)
MIX2 = np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words under which every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts behind one another with a space after each, and where each begins (and the last ends).
    A null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    lengths = np.diff(offsets)
    if column.null_count:  # a null may still own bytes
        null = ~np.asarray(column.is_valid())
        raw = raw[np.repeat(~null, lengths)]
        lengths = np.where(null, 0, lengths)
    bounds = np.concatenate([[0], np.cumsum(lengths + 1)])
    out = np.full(int(bounds[-1]) + 8, 32, dtype=np.uint8)  # eight more: words are read in eights
    keep = np.ones(int(bounds[-1]), dtype=bool)
    keep[bounds[1:] - 1] = False
    out[: len(keep)][keep] = raw
    return out, bounds


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The names of all words of a batch of texts in order, and the number of words before each text (and in all)."""
    data, bounds = text_bytes(column)
    start, end = spans(data)
    return named(LOWER[data], start, end), np.searchsorted(start, bounds)


def spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-end byte of every word."""
    space = SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(data) and not space[0]:
        edge = np.concatenate([[0], edge])
    return edge[::2], edge[1::2]


def named(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; spans of equal bytes have equal names."""
    left = end - start
    name = mixed(left.astype(np.uint64) * GOLD)
    if not len(start):
        return name
    eights = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data.data, strides=(1,))
    rows = None  # all words in the first round, later the longer ones
    at = start
    while len(at):
        part = eights[at]
        short = left < 8
        if short.any():
            part = np.where(short, part & ((np.uint64(1) << (np.uint64(8) * np.minimum(left, 7).astype(np.uint64))) - np.uint64(1)), part)
        if rows is None:
            name = mixed((name ^ part) + GOLD)
            rows = np.flatnonzero(left > 8)
            at, left = at[rows] + 8, left[rows] - 8
        else:
            name[rows] = mixed((name[rows] ^ part) + GOLD)
            more = left > 8
            rows, at, left = rows[more], at[more] + 8, left[more] - 8
    return name


def distinct_runs(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The distinct runs between white space of a batch, the number of each run in order, counts, and the
    number of runs before each text (and in all)."""
    data, bounds = text_bytes(column)
    start, end = spans(data)
    _, first, inverse, count = np.unique(named(data, start, end), return_index=True, return_inverse=True, return_counts=True)
    raw = data.tobytes()
    runs = [raw[a:b].decode() for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
    return runs, inverse.ravel(), count, np.searchsorted(start, bounds)


def shingles(name: np.ndarray, first: np.ndarray, width: int) -> list[np.ndarray]:
    """Per text the sorted distinct names of its runs of `width` words. A text of fewer words has its whole
    sequence as its only one; a text without words has none."""
    count = len(name) - width + 1
    run = np.zeros(max(count, 0), dtype=np.uint64)
    for k in range(width if count > 0 else 0):
        run = mixed(run + name[k : k + count] + GOLD)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(run[a : b - width + 1]))
        elif b > a:
            whole = np.full(1, b - a, dtype=np.uint64)
            for k in range(a, b):
                whole = mixed(whole * MIX1 + name[k] + GOLD)
            out.append(whole)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
