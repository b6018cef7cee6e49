"""Words of whole texts as numpy arrays, for use inside Arrow tasks.

Texts of a batch are laid end to end and cut into words with array operations; a word is a 64-bit hash
of its lower-cased (A-Z) bytes. Long texts are worked on in pieces, so memory beyond the text itself and
one hash per word does not grow with it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

PIECE = 1 << 20  # bytes worked on at a time
GIANT = 1 << 20  # longer words are hashed one by one

_BLANK = np.ones(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = False
_LETTERS = np.zeros(256, bool)
_LETTERS[0x30:0x3A] = _LETTERS[0x61:0x7B] = _LETTERS[0x41:0x5B] = _LETTERS[0x80:] = True
#: Bytes that belong to a word: everything but blanks; or digits, letters and all beyond ASCII.
UNBLANK, LETTERS = _BLANK, _LETTERS


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    byte = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    byte[0x41:0x5B] = byte[0x61:0x7B]
    powers = np.full(PIECE + GIANT + 2, np.uint64(0x9E3779B97F4A7C15 | 5), np.uint64)
    powers[0] = 1
    return byte, np.cumprod(powers, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that all bits depend on all bits."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _cut(buf: np.ndarray, at: int, word: np.ndarray) -> int:
    """First place from ``at`` on that is no word byte, looking at most GIANT bytes ahead; -1 if none."""
    stop = min(len(buf), at + GIANT)
    for lo in range(at, stop, 4096):
        gap = np.flatnonzero(~word[buf[lo:min(lo + 4096, stop)]])
        if len(gap):
            return lo + int(gap[0])
    return len(buf) if stop == len(buf) else -1


def flat_words(buf: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of every word of a byte buffer."""
    byte, powers = _tables()
    hashes, starts, ends = [], [], []
    at, n = 0, len(buf)
    while at < n:
        end = n if n - at <= PIECE else _cut(buf, at + PIECE, word)
        if end < 0:  # a giant word: end the piece before it, or take it alone
            before = np.flatnonzero(~word[buf[at:at + PIECE]])
            if len(before):
                end = at + int(before[-1]) + 1
            else:
                stop = at + PIECE
                while (end := _cut(buf, stop, word)) < 0:
                    stop += GIANT
                hashes.append(_giants(buf, [(at, end)]))
                starts.append(np.array([at]))
                ends.append(np.array([end]))
                at = end
                continue
        b = buf[at:end]
        edge = np.diff(word[b].view(np.int8), prepend=np.int8(0), append=np.int8(0))
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(byte[b] * powers[:len(b)], out=total[1:])
        h = (total[e] - total[s]) * powers[len(powers) - 1 - s]
        h = mix(h)
        long = np.flatnonzero(e - s > GIANT)
        if len(long):
            h[long] = _giants(buf, [(at + int(s[i]), at + int(e[i])) for i in long])
        hashes.append(h)
        starts.append(s + at)
        ends.append(e + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends)


def _giants(buf: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    digests = [hashlib.blake2b(buf[s:e].tobytes().lower(), digest_size=8).digest() for s, e in spans]
    return np.frombuffer(b"".join(digests), np.uint64)


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def groups(parts: list[bytes], limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of texts that together have about ``limit`` bytes."""
    first, size = 0, 0
    for i, p in enumerate(parts):
        if size and size + len(p) > limit:
            yield first, i
            first, size = i, 0
        size += len(p)
    if first < len(parts):
        yield first, len(parts)


class Words:
    """Words of several texts: ``hash``, and per text the range ``first[i]:first[i + 1]``.

    ``start`` and ``end`` are byte places in the texts laid end to end, text i beginning at ``base[i]``.
    """

    def __init__(self, parts: list[bytes], word: np.ndarray):
        self.buf = np.frombuffer(b" ".join(parts), np.uint8)
        self.hash, self.start, self.end = flat_words(self.buf, word)
        lengths = np.array([len(p) + 1 for p in parts], np.int64)
        self.base = np.concatenate([[0], np.cumsum(lengths)])
        self.first = np.searchsorted(self.start, self.base)
        self.counts = np.diff(self.first)

    def owner(self) -> np.ndarray:
        """Number of the text of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


_ODD = [np.uint64(x) for x in (
    0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
)]


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each ``n`` consecutive words; empty if there are fewer."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(m, np.uint64(n), np.uint64)
    for k in range(n):
        out = out * _ODD[4] + h[k:k + m] * _ODD[k % 4]
    return mix(out)


def shingle_sets(parts: list[bytes], n: int) -> Iterator[np.ndarray]:
    """Sorted distinct word ``n``-gram hashes of each text; a text of fewer words has one of all its words."""
    for lo, hi in groups(parts):
        words = Words(parts[lo:hi], UNBLANK)
        all_grams = grams(words.hash, n)
        for i in range(hi - lo):
            a, b = words.first[i], words.first[i + 1]
            if b - a >= n:
                yield np.unique(all_grams[a:b - n + 1])
            elif b > a:
                yield grams(words.hash[a:b], int(b - a))
            else:
                yield np.zeros(0, np.uint64)
