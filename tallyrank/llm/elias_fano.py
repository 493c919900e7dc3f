"""Elias-Fano coding of non-decreasing integers, with select for random access.

A value keeps its low bits verbatim and its high part as a unary gap in a bit vector, about
2 + log2(universe / n) bits a value. Every ``RATE``-th one of that vector has its position
kept in 32 bits, so ``access`` scans a few bytes instead of decoding the sequence.
"""

from __future__ import annotations

import struct

import numpy as np

RATE = 256
_HEAD = struct.Struct("<2sBxIqQI")  # magic, low bits, n, base, bits of the high vector, samples
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)
#: Place of the k-th one of a byte.
_PLACE = np.array([([b for b in range(8) if i >> b & 1] + [0] * 8)[:8] for i in range(256)], np.int64)


def encode(values: np.ndarray) -> bytes:
    values = np.asarray(values, np.int64)
    n = len(values)
    if n and (np.diff(values) < 0).any():
        raise ValueError("values must not decrease")
    base = int(values[0]) if n else 0
    rest = (values - base).astype(np.uint64)
    top = int(rest[-1]) if n else 0
    low = max(0, (top // n).bit_length() - 1) if n and top > n else 0
    lows = ((rest[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    ones = (rest >> np.uint64(low)).astype(np.int64) + np.arange(n)
    size = int(ones[-1]) + 1 if n else 0
    high = np.zeros(size, np.uint8)
    high[ones] = 1
    samples = ones[::RATE].astype("<u4")
    head = _HEAD.pack(b"EF", low, n, base, size, len(samples))
    return head + samples.tobytes() + np.packbits(lows.ravel(), bitorder="little").tobytes() + np.packbits(high, bitorder="little").tobytes()


class EliasFano:
    def __init__(self, blob: bytes):
        magic, self.low, self.n, self.base, self.size, count = _HEAD.unpack_from(blob)
        if magic != b"EF":
            raise ValueError("not an Elias-Fano block")
        at = _HEAD.size
        self.samples = np.frombuffer(blob, "<u4", count, at)
        at += 4 * count
        width = (self.n * self.low + 7) // 8
        self.lows = np.frombuffer(blob, np.uint8, width, at)
        self.high = np.frombuffer(blob, np.uint8, (self.size + 7) // 8, at + width)

    def __len__(self) -> int:
        return self.n

    def select(self, i: int) -> int:
        """Position of the i-th one (from 0) in the high vector."""
        start = int(self.samples[i // RATE])
        left, byte = i % RATE, start >> 3
        word = int(self.high[byte]) >> (start & 7) << (start & 7)
        while (c := int(_POPCOUNT[word])) <= left:
            left, byte = left - c, byte + 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        return byte * 8 + (word & -word).bit_length() - 1

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = self.select(i) - i
        if self.low:
            at = i * self.low
            chunk = int.from_bytes(self.lows[at >> 3 : (at + self.low + 7) >> 3].tobytes(), "little")
            value = value << self.low | chunk >> (at & 7) & ((1 << self.low) - 1)
        return value + self.base

    def select_many(self, i: np.ndarray) -> np.ndarray:
        """``select`` of ascending positions, over the stretch of the high vector that they span."""
        first, last = int(self.samples[i[0] // RATE]) >> 3, self.select(int(i[-1])) >> 3
        part = self.high[first : last + 1]
        # ones before the stretch: those of the sample's rank, less those of its byte that stand before it
        before = int(i[0]) // RATE * RATE - int(_POPCOUNT[part[0] & ((1 << (int(self.samples[i[0] // RATE]) & 7)) - 1)])
        upto = np.cumsum(_POPCOUNT[part], dtype=np.int64)
        byte = np.searchsorted(upto, i - before, side="right")
        return (first + byte) * 8 + _PLACE[part[byte], i - before - (upto[byte] - _POPCOUNT[part[byte]])]

    def access_many(self, i: np.ndarray) -> np.ndarray:
        """``access`` of ascending positions."""
        if not len(i):
            return np.zeros(0, np.int64)
        value = (self.select_many(i) - i) << self.low
        for b in range(self.low):
            at = i * self.low + b
            value |= (self.lows[at >> 3].astype(np.int64) >> (at & 7) & 1) << b
        return value + self.base

    def first_at_least(self, value: int) -> int:
        """Index of the first number not below ``value``, by binary search."""
        a, b = 0, self.n
        while a < b:
            m = (a + b) // 2
            a, b = (m + 1, b) if self.access(m) < value else (a, m)
        return a

    def decode(self) -> np.ndarray:
        """All values."""
        ones = np.flatnonzero(np.unpackbits(self.high, count=self.size, bitorder="little")) if self.n else np.zeros(0, np.int64)
        values = (ones - np.arange(self.n)) << self.low
        if self.low:
            bits = np.unpackbits(self.lows, count=self.n * self.low, bitorder="little").reshape(self.n, self.low)
            values = values + (bits.astype(np.int64) << np.arange(self.low)).sum(axis=1)
        return values + self.base
