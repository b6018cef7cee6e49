"""Benchmark decontamination over a distributed positional inverted index of the training texts.

The index is partitioned by document. A segment holds about a million words in one numbering of places
with a gap between texts; for each term it stores the sorted places as gaps of the least byte width. Only
postings of terms that occur in the benchmark are read for a search. A segment intersects the
offset-adjusted lists of a phrase's terms from its rarest term on, for all phrases at once.

Searching costs one group per segment, whose size is fixed. The benchmark is read in blocks of bounded
bytes; one block at a time is broadcast and searched against every segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsfacts.llm.store import stored
from newsfacts.llm.text import LETTERS, Words, groups, texts
from newsfacts.session import ship

SEGMENT = 1 << 20  # words
BLOCK_BYTES = 32 << 20  # of benchmark text
CANDIDATES = 1 << 21  # places checked at a time
_SHIFT = 33  # a posting's sort key is term number << 33 | place
INDEX = "segment long, id long, start long, n_words long, term long, n int, width byte, gaps binary"


def _gaps(terms: np.ndarray, places: np.ndarray):
    """Distinct terms, their counts, the byte width of their gaps, and the gaps as one binary column."""
    order = np.argsort(terms, kind="stable")
    terms, places = terms[order], places[order].astype(np.int64)
    opens = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]]) if len(terms) else np.zeros(0, np.int64)
    gap = np.diff(places, prepend=0)
    gap[opens] = places[opens]
    counts = np.diff(np.r_[opens, len(terms)])
    most = np.maximum.reduceat(gap, opens) if len(opens) else opens
    width = np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4))
    offsets = np.r_[0, np.cumsum(width * counts)]
    each = np.repeat(width, counts)
    at = np.repeat(offsets[:-1] - opens * width, counts) + np.arange(len(gap)) * each
    out = np.zeros(offsets[-1], np.uint8)
    for k in range(4):
        some = each > k
        out[at[some] + k] = (gap[some] >> (8 * k)) & 255
    blobs = pa.Array.from_buffers(pa.large_binary(), len(opens), [
        None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(out.tobytes())]).cast(pa.binary())
    return terms[opens], counts, width, blobs


def _segment(number: int, ids: list, lengths: list[int], hashes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    size = np.array(lengths, np.int64)
    start = np.r_[0, np.cumsum(size + 1)][:-1]
    words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    places = np.arange(len(words)) + np.repeat(np.arange(len(size)), size)
    names = ["segment", "id", "start", "n_words", "term", "n", "width", "gaps"]

    def batch(rows, **some):
        kinds = dict(zip(names, [pa.int64()] * 5 + [pa.int32(), pa.int8(), pa.binary()]))
        some["segment"] = np.full(rows, number)
        return pa.RecordBatch.from_arrays(
            [pa.array(some[c]).cast(kinds[c]) if c in some else pa.nulls(rows, kinds[c]) for c in names], names=names)

    yield batch(len(ids), id=pa.array(ids, pa.int64()), start=start, n_words=size)
    term, n, width, gaps = _gaps(words, places)
    for lo in range(0, len(term), 20_000):
        part = slice(lo, lo + 20_000)
        yield batch(len(term[part]), term=term[part].view(np.int64), n=n[part], width=width[part],
                    gaps=gaps[lo:lo + 20_000])


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 24
    ids, lengths, hashes, total = [], [], [], 0
    for b in batches:
        keys, parts = b.column(0).to_pylist(), texts(b.column(1))
        for lo, hi in groups(parts):
            words = Words(parts[lo:hi], LETTERS)
            ids += keys[lo:hi]
            lengths += words.counts.tolist()
            hashes.append(words.hash)
            total += len(words.hash)
            if total >= SEGMENT:
                yield from _segment(number, ids, lengths, hashes)
                number += 1
                ids, lengths, hashes, total = [], [], [], 0
    if ids:
        yield from _segment(number, ids, lengths, hashes)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored index: per segment one row per text (id, start, n_words) and one per term (term, n, gaps)."""
    ship(docs.sparkSession)
    return stored(docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(_build, INDEX), "postings")


class Phrases:
    """Windows of ``size`` consecutive words of test items; an item of fewer words is one window."""

    def __init__(self, ids: list, parts: list[bytes], size: int):
        terms, lengths, items = [], [], []
        for lo, hi in groups(parts):
            words = Words(parts[lo:hi], LETTERS)
            for i in range(hi - lo):
                h = words.hash[words.first[i]:words.first[i + 1]]
                if len(h):
                    row = np.zeros((max(1, len(h) - size + 1), size), np.uint64)
                    for k in range(min(size, len(h))):
                        row[:, k] = h[k:k + len(row)]
                    terms.append(row)
                    lengths.append(np.full(len(row), min(size, len(h))))
                    items.append(np.full(len(row), lo + i))
        self.ids = ids
        self.terms = np.concatenate(terms) if terms else np.zeros((0, size), np.uint64)
        self.length = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
        self.item = np.concatenate(items) if items else np.zeros(0, np.int64)

    def vocabulary(self) -> np.ndarray:
        return np.unique(self.terms[np.arange(self.terms.shape[1]) < self.length[:, None]])


def _matches(phrases: Phrases, terms: np.ndarray, keys: np.ndarray, counts: np.ndarray, start: np.ndarray,
             slop: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(phrase, first place, exact) of every occurrence in one segment.

    ``terms`` is sorted, ``keys`` holds all their places as term number << 33 | place, sorted.
    """
    if not len(terms) or not len(phrases.terms):
        return
    number = np.minimum(np.searchsorted(terms, phrases.terms), len(terms) - 1)
    used = np.arange(phrases.terms.shape[1]) < phrases.length[:, None]
    there = ((terms[number] == phrases.terms) | ~used).all(axis=1)
    rows = np.flatnonzero(there)
    number, length = number[rows], phrases.length[rows]
    order = np.argsort(np.where(used[rows], counts[number], np.iinfo(np.int64).max), axis=1, kind="stable")
    lead = number[np.arange(len(rows)), order[:, 0]]
    offset = np.r_[0, np.cumsum(counts)]
    cost = np.cumsum(counts[lead])
    lo = 0
    while lo < len(rows):
        hi = max(lo + 1, int(np.searchsorted(cost, (cost[lo - 1] if lo else 0) + CANDIDATES, "right")))
        r = np.repeat(np.arange(lo, hi), counts[lead[lo:hi]])
        within = np.arange(len(r)) - np.repeat(np.r_[0, np.cumsum(counts[lead[lo:hi]])][:-1], counts[lead[lo:hi]])
        first = (keys[offset[lead[r]] + within] & ((1 << _SHIFT) - 1)) - order[r, 0]
        exact = np.ones(len(r), bool)
        keep = first >= 0 if not slop else np.ones(len(r), bool)
        r, first, exact = r[keep], first[keep], exact[keep]
        for k in range(1, order.shape[1]):
            if not len(r):
                break
            column = order[r, k]
            need = (number[r, column].astype(np.int64) << _SHIFT) + first + column
            at = np.minimum(np.searchsorted(keys, need - slop), len(keys) - 1)
            short = k >= length[r]
            found = (keys[at] >= need - slop) & (keys[at] <= need + slop)
            if slop:
                hit = np.minimum(np.searchsorted(keys, need), len(keys) - 1)
                exact &= (keys[hit] == need) | short
                lead_at = first + order[r, 0]
                same = (np.searchsorted(start, keys[at] & ((1 << _SHIFT) - 1), "right")
                        == np.searchsorted(start, lead_at, "right"))
                found &= same
            keep = found | short
            r, first, exact = r[keep], first[keep], exact[keep]
        yield rows[r], first, exact
        lo = hi


def _search(block, slop: int):
    def run(group: pa.Table) -> pa.Table:
        phrases = block.value
        docs = group.filter(pc.is_null(group["term"])).sort_by("start")
        posts = group.filter(pc.is_valid(group["term"]))
        start, size = docs["start"].to_numpy(), docs["n_words"].to_numpy()
        terms = posts["term"].to_numpy().view(np.uint64)
        by = np.argsort(terms)
        terms, counts = terms[by], posts["n"].to_numpy().astype(np.int64)[by]
        kinds = {1: np.uint8, 2: np.uint16, 4: np.uint32}
        gaps, widths = posts["gaps"].to_numpy()[by], posts["width"].to_numpy()[by]
        keys = np.concatenate([
            np.cumsum(np.frombuffer(g, kinds[int(w)]), dtype=np.int64) + (i << _SHIFT)
            for i, (g, w) in enumerate(zip(gaps, widths))]) if len(terms) else np.zeros(0, np.int64)
        total = int(start[-1] + size[-1]) + 1 if len(start) else 0
        cover = np.zeros(total + 1, np.int64)
        pairs, near = [], [np.zeros(0, np.int64)]
        for phrase, first, exact in _matches(phrases, terms, keys, counts, start, slop):
            doc = np.searchsorted(start, np.maximum(first, 0), "right") - 1
            if slop:
                near.append(doc[~exact] * len(phrases.ids) + phrases.item[phrase[~exact]])
            first = np.clip(first, start[doc], None)
            last = np.minimum(first + phrases.length[phrase], start[doc] + size[doc])
            np.add.at(cover, first, 1)
            np.add.at(cover, last, -1)
            pairs.append(np.unique(doc * len(phrases.ids) + phrases.item[phrase]))
        hit = np.cumsum(cover[:total]) > 0
        edge = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
        owner = np.searchsorted(start, edge[:, 0], "right") - 1
        spans = [[] for _ in start]
        for d, (a, b) in zip(owner.tolist(), edge.tolist()):
            spans[d].append({"begin": a - int(start[d]), "end": b - int(start[d])})
        items = [set() for _ in start]
        for p in np.unique(np.concatenate(pairs)).tolist() if pairs else []:
            items[p // len(phrases.ids)].add(phrases.ids[p % len(phrases.ids)])
        loose = np.bincount(np.unique(np.concatenate(near)) // max(1, len(phrases.ids)), minlength=len(start))
        return pa.table({
            "segment": docs["segment"], "id": docs["id"], "start": start, "n_words": size,
            "spans": pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
            "items": pa.array([sorted(s, key=lambda x: (x is None, x or 0)) for s in items], pa.list_(pa.int64())),
            "n_near": loose[:len(start)],
        })

    return run


_FOUND = ("segment long, id long, start long, n_words long, spans array<struct<begin:long,end:long>>, "
          "items array<long>, n_near long")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, slop: int = 0,
                  id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text: str = "text") -> DataFrame:
    """(id, n_words, n_hit, spans, items, n_near), one row per row of ``docs``.

    ``spans`` are the runs of words inside any occurrence of a window of ``window`` consecutive item words
    (the whole item if it has fewer), ``n_hit`` their words, ``items`` the sorted distinct ids of items with
    occurrences. With ``slop`` above 0 each other term may be that many places off from where the rarest
    term puts it; ``n_near`` counts items with such inexact occurrences. Null and blank texts have no
    words, match nothing and stay in the result; null ids stay null. An item with a null id is listed as
    null. Repeated rows are found each on its own. Without documents there are no rows; without items no
    hits. Extra columns are not read.
    """
    spark = docs.sparkSession
    index = build_index(docs, id_col, text_col)
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).alias("text"))
    size = items.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    n_blocks = -(-size // BLOCK_BYTES) or 1
    split = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)))
    found = None
    for number in range(n_blocks):
        rows = split.filter(F.col("block") == number).collect()  # at most about BLOCK_BYTES of text
        phrases = Phrases([r["item"] for r in rows], [(r["text"] or "").encode() for r in rows], window)
        # The vocabulary of one block of the benchmark is bounded by BLOCK_BYTES.
        words = F.broadcast(spark.createDataFrame([(int(t),) for t in phrases.vocabulary().view(np.int64)], "term long"))
        postings = index.filter("term is not null").join(words, "term", "left_semi").select(index.columns)
        part = (
            index.filter("term is null").union(postings)
            .groupBy("segment").applyInArrow(_search(spark.sparkContext.broadcast(phrases), slop), _FOUND)
        )
        found = part if found is None else found.union(part)
    if n_blocks > 1:
        found = found.groupBy("segment", "start").agg(
            F.first("id").alias("id"), F.first("n_words").alias("n_words"),
            F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"),  # one entry per block
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            F.sum("n_near").alias("n_near"))
    covered = F.expr(
        "aggregate(spans, named_struct('n', 0L, 'last', 0L), (a, s) -> named_struct("
        "'n', a.n + greatest(0L, s.end - greatest(s.begin, a.last)), 'last', greatest(a.last, s.end)), a -> a.n)")
    return found.select(F.col("id").alias(id_col), "n_words", covered.alias("n_hit"), "spans", "items", "n_near")
