"""Language-model scoring with a sharded Elias-Fano trie of word pairs.

The model is an interpolated pair model. With c a training count, N all tokens and n1 the words seen once:

    p(w)     = c(w) / N * (1 - n1 / N), and n1 / N for the one unknown word (at least 1 / (N + 1))
    p(w | h) = c(h, w) / (c(h) + mu) + mu / (c(h) + mu) * p(w)

where h is the token before, or the begin of the text; an unknown h leaves p(w). The first summand is what
the trie stores, in 8 bits.

Texts are cut into blocks of about a million tokens. A block asks for its distinct words and its distinct
pairs only, as sorted arrays, one message per block and shard; a shard adds up all messages' counts, builds
its part of a level, and answers each message in its own order. So nothing is replicated to all executors,
what a task holds is a block or a shard, and the number of shards grows with the input. Words are dealt
by hash; pairs by their context, and a context with many pairs is split by its successors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsfacts.llm.elias_fano import Trie, build_trie, dequantise
from newsfacts.llm.store import stored
from newsfacts.llm.text import UNBLANK, Words, groups, mix, texts
from newsfacts.session import ship

BLOCK = 1 << 20  # tokens
SHARD_BYTES = 16 << 20  # of text for each shard
END = np.uint64(1)  # the token after the last word
MESSAGE = "kind int, block long, shard int, n1 long, n2 long, n3 long, a binary, b binary, c binary, d binary"
TEXTS, WORDS, LEVEL1, COUNTS, PAIRS, LEVEL2, CODES = range(7)
_NAMES = [c.split()[0] for c in MESSAGE.split(", ")]
_TYPES = [pa.int32(), pa.int64(), pa.int32(), *[pa.int64()] * 3, *[pa.binary()] * 4]


def _message(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r.get(c) for r in rows], t) for c, t in zip(_NAMES, _TYPES)], names=_NAMES)


def _messages(rows: list[dict]) -> pa.Table:
    return pa.Table.from_batches([_message(rows)])


def _array(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(blob, kind)


def _thin(values: np.ndarray) -> bytes:
    """32-bit numbers by planes: the low 16 bits of all, then the two other bytes, which compress well."""
    x = values.astype(np.uint32)
    return x.astype(np.uint16).tobytes() + (x >> 16).astype(np.uint8).tobytes() + (x >> 24).astype(np.uint8).tobytes()


def _wide(blob: bytes) -> np.ndarray:
    n = len(blob) // 4
    low, middle, high = (np.frombuffer(blob, k, n, at) for k, at in (
        (np.uint16, 0), (np.uint8, 2 * n), (np.uint8, 3 * n)))
    return low | (middle.astype(np.uint32) << np.uint32(16)) | (high.astype(np.uint32) << np.uint32(24))


def _block(number: int, ids: list, held: list, parts: list[tuple], bits: int) -> list[dict]:
    """The block's texts as places in its sorted distinct words, and one message of words for each shard."""
    flat, lengths = [], []
    for words in parts:
        m = len(words.counts)
        tokens = np.empty(len(words.hash) + m, np.uint64)
        at = np.arange(len(words.hash)) + words.owner()
        tokens[at] = words.hash
        tokens[words.first[1:] + np.arange(m)] = END
        flat.append(tokens)
        lengths.append(words.counts + 1)
    flat, lengths = np.concatenate(flat), np.concatenate(lengths).astype(np.int64)
    known, place = np.unique(flat, return_inverse=True)
    train = np.repeat(~np.array(held), lengths)
    counts = np.bincount(place[train], minlength=len(known))
    missing = np.array([i is None for i in ids])
    rows = [{"kind": TEXTS, "block": number, "a": np.array([i or 0 for i in ids], np.int64).tobytes(),
             "b": (np.array(held) + 2 * missing).astype(np.uint8).tobytes(), "c": lengths.tobytes(),
             "d": _thin(place)}]
    edges = np.searchsorted(known >> np.uint64(64 - bits), np.arange((1 << bits) + 1))
    for s in range(1 << bits):
        part = slice(edges[s], edges[s + 1])
        rows.append({"kind": WORDS, "block": number, "shard": s, "a": known[part].tobytes(),
                     "b": _thin(counts[part])})
    return rows


def _blocks(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        ids, held, parts, total = [], [], [], 0
        for b in batches:
            keys, out, docs = b.column(0).to_pylist(), b.column(1).to_pylist(), texts(b.column(2))
            for lo, hi in groups(docs):
                parts.append(Words(docs[lo:hi], UNBLANK))
                parts[-1].buf = parts[-1].start = parts[-1].end = None
                ids += keys[lo:hi]
                held += out[lo:hi]
                total += len(parts[-1].hash) + hi - lo
                if total >= BLOCK:
                    yield _message(_block(number, ids, held, parts, bits))
                    number += 1
                    ids, held, parts, total = [], [], [], 0
        if ids:
            yield _message(_block(number, ids, held, parts, bits))

    return run


def _word_level(group: pa.Table) -> pa.Table:
    """Add up the counts of a shard's words; answer each block with the counts and ranks of its words."""
    asked = [_array(x, np.uint64) for x in group["a"].to_pylist()]
    counts = [_wide(x) for x in group["b"].to_pylist()]
    words, place = np.unique(np.concatenate(asked), return_inverse=True)
    total = np.bincount(place, np.concatenate(counts), len(words)).astype(np.int64)
    seen = total > 0
    rank = np.cumsum(seen) - 1
    shard = group["shard"][0].as_py()
    rows = [{"kind": LEVEL1, "shard": shard, "n1": int(seen.sum()), "n2": int(total.sum()),
             "n3": int((total == 1).sum()), "a": words[seen].tobytes(), "b": total[seen].tobytes()}]
    at = 0
    for block, a in zip(group["block"].to_pylist(), asked):
        p = place[at:at + len(a)]
        at += len(a)
        rows.append({"kind": COUNTS, "block": block, "shard": shard, "a": total[p].tobytes(),
                     "b": _thin(rank[p])})
    return _messages(rows)


class _Asked:
    """A block with the answers to its words, and its distinct pairs in the order in which they are asked."""

    def __init__(self, block: pa.Table, answers: pa.Table, offsets: list[int], texts_seen: int, tokens: int):
        kinds = block["kind"].to_pylist()
        row = kinds.index(TEXTS)
        self.ids, self.flags = _array(block["a"][row].as_py(), np.int64), _array(block["b"][row].as_py(), np.uint8)
        self.lengths = _array(block["c"][row].as_py(), np.int64)
        place = _wide(block["d"][row].as_py())
        answers = sorted(zip(answers["shard"].to_pylist(), answers["a"].to_pylist(), answers["b"].to_pylist()))
        counts = np.concatenate([_array(a, np.int64) for _, a, _ in answers])
        number = np.concatenate([_wide(b).astype(np.uint64) + np.uint64(offsets[s] + 1)
                                 for s, _, b in answers])
        self.count, number = counts[place], number[place]
        opens = np.r_[0, np.cumsum(self.lengths)[:-1]]
        before = np.r_[0, number[:-1]].astype(np.uint64)
        self.before = np.r_[0, self.count[:-1]]
        before[opens] = 0
        self.before[opens] = texts_seen
        self.pair = np.flatnonzero((self.count > 0) & (self.before > 0))
        keys, first, self.place = np.unique(
            (before[self.pair] << np.uint64(32)) | number[self.pair], return_index=True, return_inverse=True)
        train = np.repeat((self.flags & 1) == 0, self.lengths)[self.pair]
        shards = len(offsets)
        # A context with more than a quarter of a shard's tokens is split by its successors.
        parts = 1 + self.before[self.pair[first]] * 4 * shards // max(1, tokens)
        salt = (keys & np.uint64(0xFFFFFFFF)) % parts.astype(np.uint64)
        shard = (mix((keys >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15) + salt) % np.uint64(shards))
        self.order = np.argsort(shard.astype(np.int64), kind="stable")
        self.keys = keys[self.order]
        self.counts = np.bincount(self.place[train], minlength=len(keys))[self.order]
        self.totals = self.before[self.pair[first]][self.order]
        self.edges = np.searchsorted(shard[self.order], np.arange(shards + 1))


def _ask(offsets, texts_seen, tokens):
    def run(key, block: pa.Table, answers: pa.Table) -> pa.Table:
        if not block.num_rows:
            return _messages([])
        asked = _Asked(block, answers, offsets, texts_seen, tokens)
        rows = []
        for s in range(len(offsets)):
            part = slice(asked.edges[s], asked.edges[s + 1])
            context = asked.keys[part] >> np.uint64(32)
            opens = np.flatnonzero(np.r_[True, context[1:] != context[:-1]][:len(context)])
            rows.append({
                "kind": PAIRS, "block": key[0].as_py(), "shard": s,
                "a": _thin(context[opens]) + _thin(np.diff(np.r_[opens, len(context)])),
                "b": _thin(asked.keys[part] & np.uint64(0xFFFFFFFF)), "c": _thin(asked.counts[part]),
                "d": asked.totals[part][opens].tobytes()})
        return _messages(rows)

    return run


def _pair_level(mu: float):
    def run(group: pa.Table) -> pa.Table:
        """Build a shard's trie from all blocks' pairs, and look every block's pairs up in it."""
        keys, counts, totals, sizes = [], [], [], []
        for a, b, c, d in zip(*(group[x].to_pylist() for x in "abcd")):
            context, each = _wide(a[:len(a) // 2]), _wide(a[len(a) // 2:])
            keys.append((np.repeat(context.astype(np.uint64), each) << np.uint64(32)) | _wide(b))
            counts.append(_wide(c))
            totals.append(np.repeat(_array(d, np.int64), each))
            sizes.append(len(keys[-1]))
        known, first, place = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        count = np.bincount(place, np.concatenate(counts), len(known))
        total = np.concatenate(totals)[first]
        seen = count > 0
        blob = build_trie(known[seen], count[seen] / (total[seen] + mu))
        codes = Trie(blob).find(known)[place]
        shard = group["shard"][0].as_py()
        rows = [{"kind": LEVEL2, "shard": shard, "n1": int(seen.sum()), "a": blob}]
        ends = np.cumsum(sizes)
        for block, lo, hi in zip(group["block"].to_pylist(), np.r_[0, ends[:-1]], ends):
            rows.append({"kind": CODES, "block": block, "shard": shard, "a": codes[lo:hi].tobytes()})
        return _messages(rows)

    return run


SCORES = ("id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
          "score double")


def _score(offsets, texts_seen, tokens, types, once, mu):
    def run(key, block: pa.Table, answers: pa.Table) -> pa.Table:
        if not block.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(
                [c.split()[0] for c in SCORES.split(", ")],
                [pa.int64(), pa.bool_(), *[pa.int64()] * 3, pa.float64(), pa.float64()])})
        kind = np.array(answers["kind"].to_pylist())
        asked = _Asked(block, answers.filter(pa.array(kind == COUNTS)), offsets, texts_seen, tokens)
        codes = answers.filter(pa.array(kind == CODES))
        codes = sorted(zip(codes["shard"].to_pylist(), codes["a"].to_pylist()))
        given = np.zeros(len(asked.keys), np.uint8)
        given[asked.order] = np.concatenate([_array(a, np.uint8) for _, a in codes]) if codes else given
        unknown = max(once / tokens, 1 / (tokens + 1)) if tokens else 1.0
        alone = np.where(asked.count > 0, asked.count / max(1, tokens) * (1 - once / max(1, tokens)), unknown)
        alone = np.where(alone > 0, alone, unknown)  # every word was seen once
        p = alone * (mu / (asked.before + mu))
        p[asked.pair] += dequantise(given[asked.place])
        base = np.log10((asked.count + 1) / (tokens + types + 1))
        opens = np.r_[0, np.cumsum(asked.lengths)[:-1]]
        return pa.table({
            "id": pa.array(asked.ids, pa.int64(), mask=(asked.flags & 2) > 0),
            "held_out": (asked.flags & 1) > 0, "n_tokens": asked.lengths,
            "n_known": np.add.reduceat((asked.count > 0).astype(np.int64), opens),
            "train_tokens": np.full(len(asked.ids), tokens),
            "base_score": np.add.reduceat(base, opens), "score": np.add.reduceat(np.log10(p), opens)})

    return run


def score_texts(docs: DataFrame, held_out: Column, mu: float = 200.0, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per row of ``docs``.

    Learns from the rows for which ``held_out`` is not true and scores all. Tokens are the words and one end
    for each text, so a null or blank text has one token. ``base_score`` adds log10((c + 1) / (N + V + 1))
    over the tokens, ``score`` is the model's log10 probability. Repeated rows count as often as they
    occur; null ids stay null. If nothing is learned, every token is the unknown word with probability
    1. An empty table gives no rows. Extra columns are not read.

    The driver sees one row of counts per shard.
    """
    spark = docs.sparkSession
    ship(spark)
    size = docs.agg(F.sum(F.octet_length(text_col)).alias("b")).first()["b"] or 0
    bits = max(1, int(size // SHARD_BYTES).bit_length())
    rows = docs.select(F.col(id_col).cast("long").alias("id"),
                       F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text_col).alias("text"))
    texts_seen = rows.filter(~F.col("held")).count()
    blocks = stored(rows.mapInArrow(_blocks(bits), MESSAGE), "lm-blocks")
    if not blocks.head(1):
        return spark.createDataFrame([], SCORES.replace("id long", f"`{id_col}` long"))
    words = stored(
        blocks.filter(F.col("kind") == WORDS).groupBy("shard").applyInArrow(_word_level, MESSAGE), "lm-words")
    levels = words.filter(F.col("kind") == LEVEL1).select("shard", "n1", "n2", "n3").collect()
    offsets, types = [0] * (1 << bits), 0
    for r in sorted(levels, key=lambda r: r["shard"]):
        offsets[r["shard"]] = types
        types += r["n1"]
    tokens, once = sum(r["n2"] for r in levels), sum(r["n3"] for r in levels)
    if types >= 2**32 - 1:
        raise ValueError("more distinct words than 32 bits can number")
    by_block = blocks.filter(F.col("kind") == TEXTS).groupBy("block")
    counts = words.filter(F.col("kind") == COUNTS)
    pairs = by_block.cogroup(counts.groupBy("block")).applyInArrow(_ask(offsets, texts_seen, tokens), MESSAGE)
    level = stored(pairs.groupBy("shard").applyInArrow(_pair_level(mu), MESSAGE), "lm-pairs")
    answers = counts.union(level.filter(F.col("kind") == CODES))
    scored = by_block.cogroup(answers.groupBy("block")).applyInArrow(
        _score(offsets, texts_seen, tokens, types, once, mu), SCORES)
    return scored.withColumnRenamed("id", id_col)
