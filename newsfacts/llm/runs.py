"""Periodic runs of words by internal pattern matching.

A run is a stretch of words with smallest period q and at least ``times * q`` words, as long as it can be. For each
b = 1, 2, 4, ... the blocks of b words that begin at multiples of b / 2 are asked for their next occurrence in the
window of b places after them. Occurrences of a block in such a window form an arithmetic progression, whose
difference is a candidate for the period: a run of period b / 2 < q <= b and 4 q words holds a block together with
its copy q words on, and no copy stands nearer, as the block is no shorter than the period. So every run is met, with
its smallest period, and is then extended to both ends.

Blocks are found in a suffix array of the words (by prefix doubling, whose classes after round k are the ranges of
the blocks of 2**k words), and next occurrences by a range successor in a wavelet tree over it. Only suffixes whose
first words occur again in their text stay in either. Texts are worked on by themselves, many at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsfacts.llm.text import groups, texts
from newsfacts.session import ship

LEAST, TIMES = 6, 4  # words in a run, at least; also its length in periods
STEPS = 12  # of extension in all candidates at once


class WaveletTree:
    """Numbers in levels of bits, from the highest: counts of zeros before each place."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.zeros = bits, []
        for bit in reversed(range(bits)):
            zero = ((values >> bit) & 1) == 0
            self.zeros.append(np.concatenate([[0], np.cumsum(zero, dtype=np.int32)]).astype(np.int32))
            values = np.concatenate([values[zero], values[~zero]])

    def smaller(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many of the numbers lo..hi are below x."""
        found = np.zeros(len(lo), np.int64)
        for level, zeros in enumerate(self.zeros):
            a, b, all_zero = zeros[lo].astype(np.int64), zeros[hi].astype(np.int64), int(zeros[-1])
            one = (x >> (self.bits - 1 - level)) & 1 == 1
            found += np.where(one, b - a, 0)
            lo, hi = np.where(one, all_zero + lo - a, a), np.where(one, all_zero + hi - b, b)
        return found

    def smallest(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest (from 0) of the numbers lo..hi."""
        value = np.zeros(len(lo), np.int64)
        for level, zeros in enumerate(self.zeros):
            a, b, all_zero = zeros[lo].astype(np.int64), zeros[hi].astype(np.int64), int(zeros[-1])
            one = k >= b - a
            k = np.where(one, k - (b - a), k)
            value += np.where(one, 1 << (self.bits - 1 - level), 0)
            lo, hi = np.where(one, all_zero + lo - a, a), np.where(one, all_zero + hi - b, b)
        return value

    def successor(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The smallest of the numbers lo..hi that is at least x; -1 if there is none."""
        out = np.full(len(lo), -1, np.int64)
        within = np.flatnonzero(x < 1 << self.bits)
        below = self.smaller(lo[within], hi[within], x[within])
        some = below < hi[within] - lo[within]
        at = within[some]
        out[at] = self.smallest(lo[at], hi[at], below[some])
        return out


def _classes(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a sorted key, the first place of each one's class and the class's size."""
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[first, len(key)])
    return np.repeat(first, size), np.repeat(size, size)


def _candidates(codes: np.ndarray, begins: np.ndarray, ends: np.ndarray, place: np.ndarray):
    """(start, period, block length) wherever a block's next copy is b / 2 to b words on.

    ``codes`` are the words of several texts end to end; ``begins`` and ``ends`` the text's borders for each word and
    ``place`` its number in the text.
    """
    n = len(codes)
    key = begins * (int(codes.max()) + 1) + codes
    suffix = np.argsort(key, kind="stable")
    first, size = _classes(key[suffix])
    rank = np.empty(n, np.int64)
    rank[suffix] = first
    slots = np.flatnonzero(size > 1)
    kept = np.zeros(n + 1, np.int64)  # place among the suffixes whose first word occurs again
    np.cumsum(size > 1, out=kept[1:])
    every = slots
    b, asked = 1, []
    while len(slots):
        at = suffix[slots]  # suffixes of one class follow each other, in the classes' order
        low, high = rank[at], rank[at] + size[slots]
        ask = place[at] % max(1, b // 2) == 0
        asked.append((at[ask], kept[low[ask]], kept[high[ask]], np.full(int(ask.sum()), b)))
        following = np.where(at + b < ends[at], rank[np.minimum(at + b, n - 1)], -1)
        order = np.lexsort((following, low))
        at, low, following = at[order], low[order], following[order]
        suffix[slots] = at
        first, count = _classes(low * (n + 1) + following + 1)
        rank[at] = slots[first]
        size[slots] = count
        slots = slots[count > 1]
        b *= 2
    if not asked:
        return (np.zeros(0, np.int64),) * 3
    values = place[suffix[every]]
    tree = WaveletTree(values, max(1, int(values.max()).bit_length()))
    out = []
    for at, low, high, b in asked:
        for i in range(0, len(at), 1 << 18):
            s = slice(i, i + (1 << 18))
            period = tree.successor(low[s], high[s], place[at[s]] + 1) - place[at[s]]
            good = (2 * period > b[s]) & (period <= b[s])
            out.append((at[s][good], period[good], b[s][good]))
    return tuple(np.concatenate(c) for c in zip(*out))


def _stretch(codes: np.ndarray, begin: int, end: int, left: int, right: int, period: int) -> tuple[int, int]:
    """Extend left..right, where words a period apart are equal, to both ends; by slices that grow."""
    step = STEPS
    while right + period < end:
        m = min(step, end - period - right)
        unequal = np.flatnonzero(codes[right:right + m] != codes[right + period:right + period + m])
        if len(unequal):
            right += int(unequal[0])
            break
        right, step = right + m, step * 2
    step = STEPS
    while left > begin:
        m = min(step, left - begin)
        unequal = np.flatnonzero(codes[left - m:left] != codes[left - m + period:left + period])
        if len(unequal):
            left += int(unequal[-1]) + 1 - m
            break
        left, step = left - m, step * 2
    return left, right


def find_runs(codes: np.ndarray, first: np.ndarray, least: int = LEAST,
              times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period; text i has the words first[i]..first[i + 1].

    Starts count from the first word of the first text. ``times`` is 4 or more.
    """
    if times < 4:
        raise ValueError("blocks are sure to meet runs of four periods or more")
    if not len(codes):
        return []
    counts = np.diff(first)
    begins, ends = np.repeat(first[:-1], counts), np.repeat(first[1:], counts)
    at, period, b = _candidates(codes, begins, ends, np.arange(len(codes)) - begins)
    begin, end = begins[at], ends[at]
    left, right = at.copy(), at + b
    for _ in range(STEPS):
        more = right + period < end
        right += more & (codes[np.where(more, right, 0)] == codes[np.where(more, right + period, 0)])
        more = left > begin
        left -= more & (codes[np.where(more, left - 1, 0)] == codes[np.where(more, left - 1 + period, 0)])
    open_right = (right + period < end) & (codes[right] == codes[np.minimum(right + period, len(codes) - 1)])
    open_left = (left > begin) & (codes[left - 1] == codes[np.minimum(left - 1 + period, len(codes) - 1)])
    closed = ~(open_right | open_left)
    likely = np.flatnonzero(~closed | (right + period - left >= np.maximum(least, times * period)))
    found, reached = set(), {}
    for i in likely[np.lexsort((at[likely], period[likely]))].tolist():
        p, s = int(period[i]), int(at[i])
        if s < reached.get(p, -1):
            continue  # within the last run of this period
        if closed[i]:
            x, y = int(left[i]), int(right[i])
        else:
            x, y = _stretch(codes, int(begin[i]), int(end[i]), int(left[i]), int(right[i]), p)
        reached[p] = y
        if y + p - x >= max(least, times * p):
            found.add((x, y + p - x, p))
    return sorted(found, key=lambda run: (run[0], run[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    start, length, period = np.array(runs).T
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _runs(least: int, times: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = texts(batch.column(1))
            for lo, hi in groups(parts, 1 << 22):
                words = [p.split() for p in parts[lo:hi]]
                first = np.concatenate([[0], np.cumsum([len(w) for w in words])])
                codes = pa.array([x for w in words for x in w], pa.binary()).dictionary_encode().indices.to_numpy()
                by_text = [[] for _ in words]
                found = find_runs(codes.astype(np.int64), first, least, times)
                owner = np.searchsorted(first, [r[0] for r in found], "right") - 1
                for i, (start, length, period) in zip(owner.tolist(), found):
                    by_text[i].append((start - int(first[i]), length, period))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[lo:hi], pa.array([len(w) for w in words], pa.int64()),
                    pa.array([[dict(zip(("start", "length", "period"), r)) for r in runs] for runs in by_text],
                             pa.list_(_RUN)),
                    pa.array([b" ".join(collapse(w, r)) for w, r in zip(words, by_text)], pa.binary()).cast(pa.string())],
                    names=["id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST,
                  times: int = TIMES) -> DataFrame:
    """(id, n_words, runs, collapsed): one row per row of ``docs``.

    ``runs`` has (start, length, period) of each run of at least ``least`` words and ``times`` periods, by start and
    period, words being counted from 0; they are what stands between the bytes 0x20 and 0x09 to 0x0D, and case counts.
    ``collapsed`` is the text without the words that a run repeats, joined by one space. Null and empty texts have no
    words, no runs and an empty collapsed text. Repeated rows give repeated rows and null ids stay null. An empty
    table gives no rows. Extra columns are not read. A text is worked on whole by one task, in memory that grows
    with its own length only, about 200 bytes a word.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(
        _runs(least, times), f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>,"
                             " collapsed string").withColumnRenamed("id", id_col)
