"""Elias-Fano sequences and the two-level trie of word pairs that is made of them."""

from __future__ import annotations

import mmap
import os
import tempfile

import numpy as np


def encode(values: np.ndarray, universe: int) -> bytes:
    """A sorted sequence below ``universe`` in about 2 + log2(universe / n) bits a value."""
    values = values.astype(np.uint64)
    n = len(values)
    low_bits = max(0, (universe // n).bit_length() - 1) if n else 0
    low = values & np.uint64((1 << low_bits) - 1)
    planes = ((low[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    packed = np.packbits(planes.ravel(), bitorder="little")
    high = np.zeros(n + int(universe >> low_bits) + 1, np.uint8)
    high[(values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)] = 1
    bits = np.packbits(high, bitorder="little")
    head = np.array([n, low_bits, universe, len(packed), len(high)], np.int64)
    return head.tobytes() + packed.tobytes() + bytes(8) + bits.tobytes()


class EliasFano:
    """Reads an encoded sequence from a buffer, which may be a mapped file."""

    def __init__(self, buffer, at: int = 0):
        self.n, self.low_bits, self.universe, packed, n_high = np.frombuffer(buffer, np.int64, 5, at).tolist()
        self.low = np.frombuffer(buffer, np.uint8, packed + 8, at + 40)
        bits = np.frombuffer(buffer, np.uint8, -(-n_high // 8), at + 48 + packed)
        high = np.unpackbits(bits, count=n_high, bitorder="little")
        self.ones, self.zeros = np.flatnonzero(high), np.flatnonzero(high == 0)
        self.size = 48 + packed + len(bits)

    def _low(self, i: np.ndarray) -> np.ndarray:
        bit = i * self.low_bits
        out = np.zeros(len(i), np.uint64)
        for k in range(8):
            out |= self.low[(bit >> 3) + k].astype(np.uint64) << np.uint64(8 * k)
        return (out >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at places ``i``."""
        return ((self.ones[i] - i).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(i)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Place of the first value that is at least ``x``: jump to the high part's run, then step in it."""
        high = (x >> np.uint64(self.low_bits)).astype(np.int64)
        inside = high < len(self.zeros)
        top = np.minimum(high, len(self.zeros) - 1)
        place = np.where(top > 0, self.zeros[top - 1] - (top - 1), 0)
        end = self.zeros[top] - top
        place = np.where(inside, place, self.n)
        end = np.where(inside, end, self.n)
        low = x & np.uint64((1 << self.low_bits) - 1)
        live = np.flatnonzero(place < end)
        while len(live):
            short = self._low(place[live]) < low[live]
            live = live[short]
            place[live] += 1
            live = live[place[live] < end[live]]
        return place

    def find(self, x: np.ndarray) -> np.ndarray:
        """Place of each ``x``, -1 where it is missing."""
        if not self.n:
            return np.full(len(x), -1)
        place = self.successor(x)
        at = np.minimum(place, self.n - 1)
        return np.where((place < self.n) & (self.get(at) == x), at, -1)


STEP = 8  # quantisation steps per bit of probability


def quantise(p: np.ndarray) -> np.ndarray:
    """Probabilities as codes 1 to 255, rounded down so that sums stay below one; 0 stands for absent."""
    return np.clip(255 - np.ceil(-np.log2(p) * STEP), 1, 255).astype(np.uint8)


def dequantise(codes: np.ndarray) -> np.ndarray:
    table = np.exp2((np.arange(256) - 255.0) / STEP)
    table[0] = 0.0
    return table[codes]


def build_trie(keys: np.ndarray, p: np.ndarray) -> bytes:
    """Trie of sorted distinct pairs (context << 32 | word) with their probabilities.

    Levels: the contexts; pointers to where each context's successors begin; the successors, each offset
    by its context's rank so that the whole level is monotone; one code a pair.
    """
    context, word = keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)
    opens = np.flatnonzero(np.r_[True, context[1:] != context[:-1]]) if len(keys) else np.zeros(0, np.int64)
    rank = np.repeat(np.arange(len(opens), dtype=np.uint64), np.diff(np.r_[opens, len(keys)]))
    width = int(word.max()) + 1 if len(keys) else 1
    head = np.array([width, len(keys)], np.int64).tobytes()
    return b"".join([
        head, encode(context[opens], int(context[-1]) + 1 if len(keys) else 1),
        encode(np.r_[opens, len(keys)], len(keys) + 1),
        encode(rank * np.uint64(width) + word, max(1, len(opens)) * width), quantise(p).tobytes(),
    ])


class Trie:
    """A trie in a memory-mapped file that is gone when the trie is."""

    def __init__(self, blob: bytes):
        handle, path = tempfile.mkstemp()
        try:
            os.write(handle, blob) if len(blob) < 1 << 30 else os.fdopen(os.dup(handle), "wb").write(blob)
            self.map = mmap.mmap(handle, 0, access=mmap.ACCESS_READ)
        finally:
            os.close(handle)
            os.unlink(path)
        self.width, n = np.frombuffer(self.map, np.int64, 2).tolist()
        at = 16
        self.contexts = EliasFano(self.map, at)
        at += self.contexts.size
        self.pointers = EliasFano(self.map, at)
        at += self.pointers.size
        self.successors = EliasFano(self.map, at)
        at += self.successors.size
        self.codes = np.frombuffer(self.map, np.uint8, n, at)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Code of each pair; 0 where the context or its successor is missing."""
        out = np.zeros(len(keys), np.uint8)
        rank = self.contexts.find(keys >> np.uint64(32))
        word = keys & np.uint64(0xFFFFFFFF)
        some = np.flatnonzero((rank >= 0) & (word < self.width))
        if not len(some):
            return out
        rank = rank[some]
        place = self.successors.find(rank.astype(np.uint64) * np.uint64(self.width) + word[some])
        begin, end = self.pointers.get(rank).astype(np.int64), self.pointers.get(rank + 1).astype(np.int64)
        good = (place >= begin) & (place < end)
        out[some[good]] = self.codes[place[good]]
        return out
