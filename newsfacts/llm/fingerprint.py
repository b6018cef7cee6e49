"""Improbable-feature digests: rare byte windows in chained Bloom filters, compared by bit overlap.

Each window of 16 bytes has an entropy. How rare that entropy is among all windows of the corpus, counted
in 1024 bins, is the window's rank. In each run of 32 windows the leftmost rarest one scores; windows that
score 8 times or more are the features. A feature sets 5 bits of a Bloom filter of 2048 bits; a filter that
holds 160 features is followed by the next one of the chain.

The likeness of two digests is, for each filter of the shorter chain, the best overlap with a filter of the
other, normalised so that the overlap expected by chance is 0 and the largest possible one is 1, and
averaged with the features as weights.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsfacts.llm.text import groups, mix, texts
from newsfacts.session import ship

WINDOW = 16
RUN = 32  # windows among which the rarest scores
LEAST = 8  # scores that make a feature
BINS = 1024
BITS, HASHES, FULL = 2048, 5, 160

# Integer entropies: sums of c * log2(c) over the byte counts of a window.
_UNIT = ((1 << 20) - 1) / (WINDOW * np.log2(WINDOW))
_G = np.floor(np.r_[0, np.arange(1, WINDOW + 2) * np.log2(np.arange(1, WINDOW + 2))] * _UNIT).astype(np.int32)
_STEP = (_G[1:] - _G[:-1]).astype(np.int32)  # of adding one more of a byte that occurs c times
_MOST = int(_G[WINDOW])


def entropy_bins(b: np.ndarray) -> np.ndarray:
    """Bin 0 (one repeated byte) to BINS - 1 (all bytes differ) of every window of a byte array."""
    n = len(b)
    if n < WINDOW:
        return np.zeros(0, np.int16)
    ahead = np.zeros(n, np.uint8)  # equal bytes among the next WINDOW - 1
    behind = np.zeros(n, np.uint8)
    for lo in range(0, n, 1 << 16):  # in pieces that stay in the cache
        hi = min(n, lo + (1 << 16))
        for d in range(1, WINDOW):
            end = min(hi, n - d)
            if end <= lo:
                break
            same = b[lo:end] == b[lo + d:end + d]
            ahead[lo:end] += same
            behind[lo + d:end + d] += same
    first = int(_STEP[_counts_so_far(b[:WINDOW])].sum())
    m = n - WINDOW
    change = _STEP[behind[WINDOW:]] - _STEP[ahead[:m]]
    total = np.empty(m + 1, np.int32)
    total[0] = _MOST - first
    np.cumsum(change, dtype=np.int32, out=total[1:])
    np.subtract(total[0], total[1:], out=total[1:])
    return (total >> 10).astype(np.int16)


def _counts_so_far(b: np.ndarray) -> np.ndarray:
    return np.array([int((b[:i] == b[i]).sum()) for i in range(len(b))])


_POWERS = np.cumprod(np.r_[1, np.full(WINDOW - 1, 0x9E3779B97F4A7C15)].astype(np.uint64), dtype=np.uint64)
SPAN = 1 << 19  # bytes worked on at a time; longer texts are cut into runs of windows of this length


def _features(segments: list[bytes], rank: np.ndarray) -> list[np.ndarray]:
    """Hashes of the features of each segment: the windows that are the leftmost rarest of LEAST runs.

    The segments, each of a window at least, lie end to end; what crosses a border is left out. If none of
    a segment's windows scores LEAST, those that score most are its features; a segment too short for a run
    has all its windows.
    """
    b = np.frombuffer(b"".join(segments), np.uint8)
    size = np.array([len(s) for s in segments])
    base = np.r_[0, np.cumsum(size)]
    bins = entropy_bins(b)
    n = len(bins)
    key = (rank[bins] << 20) | np.arange(n, dtype=np.int32)
    padded = np.full(-(-n // RUN) * RUN, np.iinfo(np.int32).max, np.int32)
    padded[:n] = key
    rows = padded.reshape(-1, RUN)
    front = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    whole = np.zeros(max(0, n - RUN + 1) + 1, np.int8)
    runs = size - WINDOW - RUN + 2
    long = np.flatnonzero(runs > 0)
    whole[base[long]] += 1
    whole[base[long] + runs[long]] -= 1
    inside = np.cumsum(whole[:-1], dtype=np.int8) > 0
    least = np.minimum(back[:max(0, n - RUN + 1)], front[RUN - 1:n])[inside] & ((1 << 20) - 1)
    opens = np.flatnonzero(np.r_[True, least[1:] != least[:-1]]) if len(least) else np.zeros(0, np.int64)
    scores, places = np.diff(np.r_[opens, len(least)]), least[opens]
    owner = np.searchsorted(base, places, "right") - 1
    most = np.zeros(len(segments), np.int64)
    np.maximum.at(most, owner, scores)
    places = places[scores >= np.minimum(LEAST, most)[owner]]
    few = [np.arange(base[i], base[i + 1] - WINDOW + 1) for i in np.flatnonzero(runs <= 0)]
    places = np.sort(np.concatenate([places.astype(np.int64), *few]))
    h = np.zeros(len(places), np.uint64)
    for k in range(WINDOW):
        h += (b[places + k].astype(np.uint64) + np.uint64(1)) * _POWERS[k]
    return np.split(mix(h), np.searchsorted(places, base[1:-1]))


def digests(parts: list[bytes], rank: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Filters (n x 256 bytes) of each text and their numbers of distinct features.

    The features of a text shorter than a window are its strings of 4 bytes, or itself; an empty one has none.
    """
    found: list[list[np.ndarray]] = [[] for _ in parts]
    held, owners, total = [], [], 0

    def flush():
        for i, h in zip(owners, _features(held, rank) if held else []):
            found[i].append(h)
        held.clear()
        owners.clear()

    for i, text in enumerate(parts):
        if len(text) < WINDOW:
            if text:
                found[i].append(np.frombuffer(b"".join(
                    hashlib.blake2b(text[k:k + 4], digest_size=8).digest()
                    for k in range(max(1, len(text) - 3))), np.uint64))
            continue
        for lo in range(0, len(text) - WINDOW + 1, SPAN // 2):
            piece = text[lo:lo + SPAN // 2 + WINDOW - 1]
            if total + len(piece) > SPAN:
                flush()
                total = 0
            held.append(piece)
            owners.append(i)
            total += len(piece)
    flush()
    out = []
    for pieces in found:
        if not pieces:
            out.append((np.zeros((0, BITS // 8), np.uint8), np.zeros(0, np.int64)))
            continue
        h = pieces[0] if len(pieces) == 1 else np.concatenate(pieces)
        _, first = np.unique(h, return_index=True)
        h = h[np.sort(first)]
        number = np.arange(len(h)) // FULL
        bits = np.zeros((number[-1] + 1, BITS), np.uint8)
        for k in range(HASHES):
            bits[number, (h >> np.uint64(11 * k)).astype(np.int64) & (BITS - 1)] = 1
        out.append((np.packbits(bits, axis=1), np.bincount(number)))
    return out


def write_digest(filters: np.ndarray, counts: np.ndarray) -> str:
    """Text form: one ``features:base64`` for each filter, joined by commas; empty for an empty text."""
    return ",".join(f"{c}:{base64.b64encode(f.tobytes()).decode()}" for c, f in zip(counts.tolist(), filters))


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """0 to 1; equal digests have 1, an empty one and another have 0."""
    if len(a[1]) > len(b[1]) or len(a[1]) == len(b[1]) and a[1].sum() > b[1].sum():
        a, b = b, a
    if not len(b[1]):
        return 1.0
    if not len(a[1]):
        return 0.0
    if a[0].shape == b[0].shape and (a[0] == b[0]).all() and (a[1] == b[1]).all():
        return 1.0
    total = 0.0
    ones_b = np.bitwise_count(b[0]).sum(axis=1).astype(np.int64)
    for f, c in zip(*a):
        ones = int(np.bitwise_count(f).sum())
        both = np.bitwise_count(f & b[0]).sum(axis=1).astype(np.int64)
        chance = ones * ones_b / BITS
        most = np.minimum(ones, ones_b)
        score = (both - chance) / np.maximum(most - chance, 1e-9)
        total += float(c) * float(np.clip(score, 0, 1).max())
    return total / float(a[1].sum())


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(BINS, np.int64)
    for batch in batches:
        parts = [t for t in texts(batch.column(0)) if len(t) >= WINDOW]
        for lo, hi in groups(parts, SPAN):
            b = np.frombuffer(b"".join(parts[lo:hi]), np.uint8)
            for at in range(0, len(b) - WINDOW + 1, SPAN):
                counts += np.bincount(entropy_bins(b[at:at + SPAN + WINDOW - 1]), minlength=BINS)
    yield pa.RecordBatch.from_pydict({"bin": np.arange(BINS, dtype=np.int32), "n": counts})


def rarity(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Rank of each entropy bin, the rarest first, over all windows of all texts laid end to end."""
    ship(docs.sparkSession)
    rows = docs.select(text_col).mapInArrow(_histogram, "bin int, n long").groupBy("bin").agg(
        F.sum("n").alias("n")).collect()  # BINS rows
    counts = np.zeros(BINS, np.int64)
    for r in rows:
        counts[r["bin"]] = r["n"]
    rank = np.empty(BINS, np.int32)
    rank[np.lexsort((np.arange(BINS), counts))] = np.arange(BINS)
    return rank


def _chars(text: bytes, n: int) -> bytes:
    """The first ``n`` code points of UTF-8 bytes."""
    starts = np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    return text if n >= len(starts) else text[:int(starts[n])]


def edit(text: bytes, following: bytes) -> tuple[bytes, int]:
    """``text`` with its last third of code points replaced by as many, or all, of the next text's first."""
    n = int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))
    return _chars(text, n - n // 3) + _chars(following, n // 3), n


RESULT = ("id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


_SCHEMA = pa.schema([
    ("id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _compare(rank):
    """Rows come sorted by part and place; each is compared with the next one of its part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, held = rank.value, []
        for batch in batches:
            part, guard, ids = (batch.column(i).to_pylist() for i in range(3))
            parts = texts(batch.column(3))
            for lo, hi in groups(parts, 8 * SPAN):
                own = digests(parts[lo:hi], ranks)
                rows = held + list(zip(part[lo:hi], guard[lo:hi], ids[lo:hi], parts[lo:hi], own))
                pairs = [(x, y) for x, y in zip(rows, rows[1:]) if not x[1] and x[0] == y[0]]
                edits = [edit(x[3], y[3]) for x, y in pairs]
                changed = digests([e for e, _ in edits], ranks)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*[
                    (x[2], n, hashlib.sha256(e).hexdigest(), write_digest(*x[4]), write_digest(*c),
                     likeness(x[4], c), likeness(x[4], y[4]))
                    for (x, y), (e, n), c in zip(pairs, edits, changed)]) if pairs else [[]] * 7, _SCHEMA)],
                    schema=_SCHEMA)
                held = rows[-1:]

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 part_bytes: int = 16 << 20) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) per row.

    The next document is that of the next smaller id (null ids come last, rows of one id by their text's
    hash); after the last comes the first, and a single row follows itself. Null and empty texts have an
    empty fingerprint. Equal texts have equal fingerprints. An empty table gives no rows. Extra columns are
    not read.

    Texts move once: rows are dealt into ranges of ids, and the first row of each range goes to the range
    before as well. The driver sees the bounds and the first id of each range. Rows of one id
    share a range.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    ranks = spark.sparkContext.broadcast(rarity(docs, text_col))
    n = int(min(4096, size // part_bytes + 1))
    known = rows.filter("id is not null")
    bounds = known.approxQuantile("id", [i / n for i in range(1, n)], 0.1 / n) if n > 1 else []
    bounds = sorted({int(x) for x in bounds}, reverse=True)
    # Part 0 has the largest ids; ids below the last bound and null ids come at the end.
    part = F.coalesce(
        sum((F.when(F.col("id") < b, 1).otherwise(0) for b in bounds), F.lit(0)), F.lit(len(bounds) + 1)
    ) if len(bounds) < 32 else F.coalesce(F.expr(
        f"aggregate(array({','.join(f'{b}L' for b in bounds)}), 0, (a, b) -> a + if(id < b, 1, 0))"),
        F.lit(len(bounds) + 1))
    part = F.when(F.col("id").isNull(), len(bounds) + 1).otherwise(part)
    rows = rows.withColumn("part", part)
    tops = rows.groupBy("part").agg(F.max("id").alias("top")).orderBy("part").collect()
    before = {r["part"]: (tops[i - 1]["part"], r["top"]) for i, r in enumerate(tops)}
    table = spark.createDataFrame([(p, q, top) for p, (q, top) in before.items()], "part int, back int, top long")
    # One row per range.
    dealt = rows.join(F.broadcast(table), "part").withColumn("hash", F.xxhash64("text"))
    guards = dealt.filter(F.col("id").eqNullSafe(F.col("top"))).select(
        F.col("back").alias("part"), F.lit(True).alias("guard"), "id", "hash", "text")
    return (
        dealt.select("part", F.lit(False).alias("guard"), "id", "hash", "text").union(guards)
        .repartition("part")
        .sortWithinPartitions("part", "guard", F.col("id").desc_nulls_last(), "hash", "text")
        .select("part", "guard", "id", "text").mapInArrow(_compare(ranks), RESULT)
        .withColumnRenamed("id", id_col)
    )
