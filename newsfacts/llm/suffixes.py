"""Repeated passages by a sparse suffix array.

Of all word suffixes of the texts only those that begin at a content-selected place are kept: where, in a
window of 39 successive 12-word grams, the gram's hash is the smallest. Any passage of 50 words has such a
window, so equal passages keep equal suffixes. Kept suffixes are sorted by their words; each is
compared with its neighbour, and the match is extended to the left and to the right. The same is done in
the order of the words before, as the longest match to the left may stand elsewhere. Matches of 50
words or more are repeated passages; those of one text that overlap are one.

Where three or more suffixes share a gram, a pair may match neither's neighbours in full: others with longer matches on
one side stand between them in either order. There each window of 50 words over such a gram is met by the first equal
one. So every window of 50 words that occurs twice is in a passage.

Before any words move, suffixes that cannot match are left out: in a match of 50 words a kept suffix has 31
equal words to the right or 20 to the left of its gram, so one of two hashes must occur twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsfacts.llm.store import stored
from newsfacts.llm.text import UNBLANK, Words, grams, groups, texts
from newsfacts.session import ship

LEAST = 50  # words in a repeated passage
GRAM = 12
WINDOW = LEAST - GRAM + 1
RIGHT = 31  # words from a kept place on that a match has, unless it has LEFT before its gram
LEFT = LEAST - RIGHT + 1
BEFORE, AFTER = LEAST - GRAM, LEAST  # words of context compared on each side of a kept place
SORTED = 100_000  # suffixes sorted in one task, of some 400 bytes each; fewer, larger tasks need more memory


def minimisers(g: np.ndarray) -> np.ndarray:
    """Places of the smallest gram of each window, leftmost among equals; of all grams if there are fewer."""
    found, most = [], (1 << 20) - 1
    for lo in range(0, max(1, len(g) - WINDOW + 1), most - WINDOW):
        part = g[lo:lo + most]
        width = min(WINDOW, len(part))
        if not width:
            break
        n = len(part) - width + 1
        key = (part & ~np.uint64(most)) | np.arange(len(part), dtype=np.uint64)
        padded = np.full(-(-len(part) // width) * width, np.iinfo(np.uint64).max, np.uint64)
        padded[:len(part)] = key
        rows = padded.reshape(-1, width)
        front = np.minimum.accumulate(rows, axis=1).ravel()
        back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(back[:n], front[width - 1:width - 1 + n]) & np.uint64(most)
        found.append(least[np.r_[True, least[1:] != least[:-1]]].astype(np.int64) + lo)
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, pos, left, right) of each kept suffix; one row (h, -1, number of words) for each text."""
    seen: set[int] = set()
    for batch in batches:
        hs, parts = batch.column(0).to_pylist(), texts(batch.column(1))
        for lo, hi in groups(parts):
            words = Words(parts[lo:hi], UNBLANK)
            gram, left, right = (grams(words.hash, n) for n in (GRAM, LEFT + GRAM, RIGHT))
            out = {"h": [], "pos": [], "left": [], "right": []}
            for i in range(hi - lo):
                if hs[lo + i] in seen:
                    continue
                if len(seen) < 1_000_000:  # copies met later are removed in Spark
                    seen.add(hs[lo + i])
                a, b = int(words.first[i]), int(words.first[i + 1])
                at = minimisers(gram[a:max(a, b - GRAM + 1)])
                out["h"].append(np.full(len(at) + 1, hs[lo + i]))
                out["pos"].append(np.r_[-1, at])
                for name, hashes, ok, shift in (("left", left, at >= LEFT, -LEFT),
                                                ("right", right, at + RIGHT <= b - a, 0)):
                    value = np.zeros(len(at) + 1, np.int64)  # 0 stands for none
                    value[1:][ok] = hashes[a + at[ok] + shift].view(np.int64)
                    if name == "left":
                        value[0] = b - a
                    out[name].append(value)
            if out["h"]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c).astype(np.int64)) for c in out.values()], names=list(out))


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For given places of a text: the words before and after as 4 bytes each, 0 beyond the text."""
    for batch in batches:
        hs, places, parts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2))
        for lo, hi in groups(parts):
            words = Words(parts[lo:hi], UNBLANK)
            short = (words.hash >> np.uint64(32)).astype(">u4")
            short[short == 0] = 1
            gram = grams(words.hash, GRAM)
            for i in range(hi - lo):
                a, b = int(words.first[i]), int(words.first[i + 1])
                text = np.zeros(b - a + BEFORE + AFTER, ">u4")
                text[BEFORE:BEFORE + b - a] = short[a:b]
                at = np.array(sorted(places[lo + i]), np.int64)
                before = text[at[:, None] + np.arange(BEFORE - 1, -1, -1)]  # the nearest word first
                after = text[at[:, None] + np.arange(BEFORE, BEFORE + AFTER)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(gram[a + at].view(np.int64)), pa.array([x.tobytes() for x in after], pa.binary()),
                    pa.array([x.tobytes() for x in before], pa.binary()),
                    pa.array(np.full(len(at), hs[lo + i])), pa.array(at)],
                    names=["gram", "after", "before", "h", "pos"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(window, h, begin): the hashes of all windows of 50 words that hold the grams at given places of a text."""
    for batch in batches:
        hs, places, parts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2))
        for lo, hi in groups(parts):
            words = Words(parts[lo:hi], UNBLANK)
            for i in range(hi - lo):
                h = words.hash[words.first[i]:words.first[i + 1]]
                begin = (np.array(places[lo + i], np.int64)[:, None] - np.arange(WINDOW)).ravel()
                begin = np.unique(begin[(begin >= 0) & (begin <= len(h) - LEAST)])
                if len(begin):
                    yield pa.RecordBatch.from_arrays([
                        pa.array(grams(h, LEAST)[begin].view(np.int64)), pa.array(np.full(len(begin), hs[lo + i])),
                        pa.array(begin)], names=["window", "h", "begin"])


def _neighbours(gram, after, before, h, pos):
    """Matches of successive rows, each seen from both sides: (h, begin, end, other)."""
    same = np.flatnonzero((gram[1:] == gram[:-1]))
    right = after[same + 1] == after[same]
    right &= after[same] != 0
    left = before[same + 1] == before[same]
    left &= before[same] != 0
    r = np.where(right.all(axis=1), AFTER, np.argmin(right, axis=1))
    x = np.where(left.all(axis=1), BEFORE, np.argmin(left, axis=1))
    good = x + r >= LEAST
    same, r, x = same[good], r[good], x[good]
    out = [(h[i], pos[i] - x, pos[i] + r, h[j]) for i, j in ((same, same + 1), (same + 1, same))]
    return [np.concatenate(c) for c in zip(*out)]


def _columns(batch: pa.RecordBatch):
    n = batch.num_rows
    gram, h, pos = (batch.column(i).to_numpy() for i in (0, 3, 4))
    after, before = (np.frombuffer(b"".join(batch.column(i).to_pylist()), ">u4").reshape(n, -1) for i in (1, 2))
    return [gram, after, before, h, pos]


_MATCH = "h long, begin long, end long, other long, part int, last boolean, row binary"
_ROW = np.dtype([("gram", np.int64), ("after", ">u4", AFTER), ("before", ">u4", BEFORE), ("h", np.int64),
                 ("pos", np.int64)])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches within the partition, and its first and last row for the comparison across borders."""
    part, held, first = TaskContext.get().partitionId(), None, None

    def record(match, edges):
        n, m = len(match[0]), len(edges)
        none = pa.nulls(m, pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.concat_arrays([pa.array(c.astype(np.int64)), none]) for c in match]
            + [pa.concat_arrays([pa.nulls(n, pa.int32()), pa.array([part] * m, pa.int32())]),
               pa.concat_arrays([pa.nulls(n, pa.bool_()), pa.array([e[0] for e in edges], pa.bool_())]),
               pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array([e[1] for e in edges], pa.binary())])],
            names=[c.split()[0] for c in _MATCH.split(", ")])

    def packed(columns, i):
        row = np.zeros(1, _ROW)
        for name, c in zip(_ROW.names, columns):
            row[name][0] = c[i]
        return row.tobytes()

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = _columns(batch)
        if held is None:
            first = packed(columns, 0)
        else:
            columns = [np.concatenate([x, y]) for x, y in zip(held, columns)]
        yield record(_neighbours(*columns), [])
        held = [c[-1:] for c in columns]
    if held is not None:
        yield record([np.zeros(0, np.int64)] * 4, [(False, first), (True, packed(held, 0))])


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, begin, end, n_words, others): one row per repeated passage of a row of ``docs``.

    ``begin`` and ``end`` count words from 0; words are runs of bytes that are not blank, A-Z lower-cased.
    ``others`` lists the smallest ids of the texts that the passage's suffixes met as neighbours in either
    order, or its windows as the first equal ones, which include at least one other text or another place of the same text for every passage.
    Equal texts of at least 50 words are one passage over the whole text, whose ``others`` is the smallest other
    id of the group for the first, and the first for the rest; rows that repeat an id are equal texts or not
    like any others. Null, empty and short texts have no passages, and a text without any is not in the
    result. A null id stays null and is listed by none. An empty table gives no rows. Extra columns are not
    read. A match is judged by 32 bits a word.

    Suffixes of a very frequent passage are range-partitioned by what follows them, so they spread over many
    tasks; each is compared with one neighbour, never with all.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter(
        "text is not null").withColumn("h", F.xxhash64("text"))
    kept = stored(rows.select("h", "text").mapInArrow(_kept, "h long, pos long, left long, right long")
                  .dropDuplicates(["h", "pos"]), "suffix-kept")
    size = kept.filter("pos = -1").select("h", F.col("left").alias("n_words"))
    suffixes = kept.filter("pos >= 0")

    def twice(side: str) -> DataFrame:
        return suffixes.filter(F.col(side) != 0).groupBy(side).agg(
            F.count(F.lit(1)).alias("f")).filter("f > 1").select(side)

    likely = stored(
        suffixes.join(twice("left"), "left", "left_semi").select("h", "pos")
        .union(suffixes.join(twice("right"), "right", "left_semi").select("h", "pos")).distinct()
        .groupBy("h").agg(F.collect_list("pos").alias("places")), "suffix-likely")  # places of one text
    ids = stored(rows.groupBy("h").agg(
        F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("copies"),
        F.min(F.struct(F.coalesce("id", F.lit(2**62)).alias("key"))).alias("low")), "suffix-ids")
    keyed = rows.select("h", F.coalesce("id", F.lit(2**62)).alias("key"), "text")

    def with_text(places: DataFrame) -> DataFrame:
        """One row for each text: the copy with the smallest id."""
        chosen = ids.select("h", F.col("low.key").alias("key")).join(places, "h")
        return chosen.join(keyed.hint("merge"), ["h", "key"]).select("h", "places", "text").dropDuplicates(["h"])

    contexts = stored(
        with_text(likely).mapInArrow(_contexts, "gram long, after binary, before binary, h long, pos long"),
        "suffix-contexts")
    parts = max(1, -(-contexts.count() // SORTED))
    matches = None
    for order in (["gram", "after", "h", "pos"], ["gram", "before", "h", "pos"]):
        ordered = contexts.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        found = stored(ordered.mapInArrow(_compare, _MATCH), "suffix-matches")
        edges = found.filter("part is not null").orderBy("part", "last").select("row").collect()  # two a partition
        border = np.frombuffer(b"".join(bytes(r["row"]) for r in edges), _ROW)
        across = []
        for i in range(1, len(border) - 1, 2):
            pair = border[i:i + 2]
            across += list(zip(*(c.tolist() for c in _neighbours(
                pair["gram"], pair["after"], pair["before"], pair["h"], pair["pos"]))))
        inside = found.filter("part is null").select("h", "begin", "end", "other").union(
            spark.createDataFrame(across, "h long, begin long, end long, other long"))
        matches = inside if matches is None else matches.union(inside)

    crowded = contexts.groupBy("gram").agg(F.count(F.lit(1)).alias("f")).filter("f > 2").select("gram")
    places = contexts.select("gram", "h", "pos").join(crowded, "gram", "left_semi").groupBy("h").agg(
        F.collect_list("pos").alias("places"))
    windows = stored(with_text(places).mapInArrow(_windows, "window long, h long, begin long"), "suffix-windows")
    place = F.struct("h", "begin")
    firsts = windows.groupBy("window").agg(
        F.min(place).alias("low"), F.max(place).alias("high")).filter("low <> high")
    met = windows.join(firsts, "window").select(
        "h", "begin", (F.col("begin") + LEAST).alias("end"),
        F.when(place == F.col("low"), F.col("high.h")).otherwise(F.col("low.h")).alias("other"))
    matches = matches.union(met)

    by_text = Window.partitionBy("h").orderBy("begin", "end", "other")
    reach = F.max("end").over(by_text.rowsBetween(Window.unboundedPreceding, -1))
    opened = F.when(reach.isNull() | (F.col("begin") > reach), 1).otherwise(0)
    named = matches.join(ids.select(F.col("h").alias("other"), F.col("first").alias("other_id")), "other", "left")
    passages = (
        named.withColumn("opened", opened).withColumn("passage", F.sum("opened").over(by_text))
        .groupBy("h", "passage").agg(
            F.min("begin").alias("begin"), F.max("end").alias("end"),
            F.array_sort(F.collect_set("other_id")).alias("others"))  # at most four a kept suffix and one a window
        .drop("passage")
    )
    whole = (
        rows.select("id", "h").join(ids.filter("copies > 1"), "h").join(size.filter(F.col("n_words") >= LEAST), "h")
        .select("id", F.lit(0).cast("long").alias("begin"), F.col("n_words").alias("end"), F.array_compact(F.array(
            F.when(F.col("id").eqNullSafe(F.col("first")), F.col("last")).otherwise(F.col("first")))).alias("others"))
    )
    own = rows.select("id", "h").join(passages, "h").select("id", "begin", "end", "others")
    return own.union(whole).select(
        F.col("id").alias(id_col), "begin", "end", (F.col("end") - F.col("begin")).alias("n_words"), "others")
