"""Elias-Fano sequences: sorted integers in about two bits and the logarithm of their mean gap each, read in bulk.

A value's high part is written in unary into a bitmap (value number i with high part h sets bit h + i), its low part as a
fixed number of bits. The rank of every bitmap word leads to the word that holds a given one or zero.
"""

from __future__ import annotations

import numpy as np

BYTE_ONES = np.array([bin(b).count("1") for b in range(256)], dtype=np.int64)
BYTE_SELECT = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[:8] for b in range(256)], dtype=np.int64)
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def built(values: np.ndarray, name: str) -> dict[str, np.ndarray]:
    """The arrays of a sequence of sorted integers, none negative; repeats are allowed."""
    values = values.astype(np.uint64)
    count = len(values)
    top = int(values[-1]) if count else 0
    width = max(0, (top // max(count, 1)).bit_length() - 1)
    high = (values >> np.uint64(width)).astype(np.int64)
    bits = count + (top >> width) + 1
    flat = np.zeros(-(-bits // 64) * 64, dtype=np.uint8)
    flat[high + np.arange(count)] = 1
    bitmap = np.packbits(flat, bitorder="little").view("<u8")
    ones = flat.reshape(-1, 64).sum(axis=1, dtype=np.int64)
    low = np.zeros(-(-count * width // 64) + 2, dtype=np.uint64)
    if width:
        part = values & np.uint64((1 << width) - 1)
        at = np.arange(count) * width
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        np.bitwise_or.at(low, word, part << shift)
        over = (at & 63) + width > 64
        np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
    return {
        f"{name}.bitmap": bitmap, f"{name}.rank": np.concatenate([[0], np.cumsum(ones)[:-1]]).astype(np.int64),
        f"{name}.low": low, f"{name}.shape": np.array([count, width, top >> width], dtype=np.int64),
    }


class EliasFano:
    def __init__(self, arrays: dict[str, np.ndarray], name: str):
        self.bitmap, self.rank, self.low = (arrays[f"{name}.{k}"] for k in ("bitmap", "rank", "low"))
        self.count, self.width, self.top = (int(x) for x in arrays[f"{name}.shape"])
        self.zeros = np.arange(len(self.rank)) * 64 - self.rank

    def _select(self, rank: np.ndarray, number: np.ndarray, one: bool) -> np.ndarray:
        """The place of the bit with each number, counted from 0, among the ones or the zeros."""
        word = np.searchsorted(rank, number, side="right") - 1
        left = number - rank[word]
        bits = self.bitmap[word] if one else self.bitmap[word] ^ FULL
        at = word * 64
        for _ in range(7):
            ones = BYTE_ONES[(bits & np.uint64(255)).astype(np.int64)]
            on = left >= ones
            if not on.any():
                break
            left = np.where(on, left - ones, left)
            bits = np.where(on, bits >> np.uint64(8), bits)
            at = np.where(on, at + 8, at)
        return at + BYTE_SELECT[(bits & np.uint64(255)).astype(np.int64), left]

    def _low(self, index: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(index), dtype=np.int64)
        at = index * self.width
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        both = self.low[word] >> shift
        over = shift > 0
        both[over] |= self.low[word[over] + 1] << (np.uint64(64) - shift[over])
        return (both & np.uint64((1 << self.width) - 1)).astype(np.int64)

    def get(self, index: np.ndarray) -> np.ndarray:
        """The values at these places."""
        high = self._select(self.rank, index, True) - index
        return (high << self.width) | self._low(index)

    def find(self, key: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for keys that are no value: first its high part, then its low part by halving."""
        out = np.full(len(key), -1, dtype=np.int64)
        high = key >> self.width
        rows = np.flatnonzero((key >= 0) & (high <= self.top) & (self.count > 0))
        if not len(rows):
            return out
        high, want = high[rows], key[rows] & ((1 << self.width) - 1)
        begin = np.zeros(len(rows), dtype=np.int64)
        some = high > 0
        begin[some] = self._select(self.zeros, high[some] - 1, False) - (high[some] - 1)
        stop = self._select(self.zeros, high, False) - high
        end = stop.copy()
        open_ = np.flatnonzero(begin < end)
        while len(open_):
            mid = (begin[open_] + end[open_]) >> 1
            less = self._low(mid) < want[open_]
            begin[open_] = np.where(less, mid + 1, begin[open_])
            end[open_] = np.where(less, end[open_], mid)
            open_ = open_[begin[open_] < end[open_]]
        there = np.flatnonzero(begin < stop)
        there = there[self._low(begin[there]) == want[there]]
        out[rows[there]] = begin[there]
        return out
