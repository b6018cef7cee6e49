"""N-gram Jaccard self-join: rare-first prefixes, length, positional and suffix filters.

The set of a text is that of its distinct word n-grams. Two texts link when the Jaccard similarity of
their sets is at least ``num / den``. Texts with equal sets form a class and are never expanded into
pairs; all further work is between classes.

1. One pass over the texts gives each row's set size and class, and a sketch of how many texts hold an
   n-gram (fixed 2**20 counters, exact sums over all rows).
2. A second pass orders every set by (counter, hash), rarest first, and keeps the prefix that two similar
   sets must share. Only n-grams in the prefixes of two or more classes go on.
3. Stars: within an n-gram's list, ordered by set size, each class is paired with the first four and the
   previous one. A list of f classes gives at most 5f pairs, so near copies by the thousand stay linear.
   Twice more this is done with the classes of most links first, and with pairs in different components only: a
   text far from the rest of its group, if it links with any, most likely links with those. Lists of over ``LIST``
   classes are dealt in pieces, so that no list is one task.
4. Crossings: members of one list that the verified stars did not connect are paired, if size and place
   allow it. One of two such members is outside the list's largest component, so only the members outside it
   meet the list. No link between different components can be missed, because every similar pair shares a
   prefix n-gram and was either paired or is already connected.
5. Suffix filter: a class keeps how many of its n-grams fall into each of 64 parts of the hash space (mod
   256). An n-gram can only match in its own part, so the differences of the counts add up to a lower
   bound of the symmetric difference. So do the parities of the counts in 2048 finer parts: each that differs needs a
   difference of its own. Both are part of the join's condition, so failing pairs are not made.
6. What is left is verified once by the exact intersection of both sets.

The links that come out connect exactly what all links connect. Sets are read from the texts once for each class that
reaches verification.

7. ``n_links`` counts all links. They lie within the components. A component whose pairs are not all verified links is cut
   into blocks by the hash of the class, and each two blocks meet in one cell, where a product of 0/1 matrices over the
   n-grams of both counts the links. What leaves a cell is one count a class, no pairs. Nothing of this runs if
   ``n_links`` is not asked for.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsfacts.llm.components import components
from newsfacts.llm.store import small_batches, stored
from newsfacts.llm.text import shingle_sets, texts
from newsfacts.session import ship

BITS = 20  # of the sketch: 4 MB at any size of the corpus
BLOCK = 4096  # counters in a row of the sketch
FINE = 32  # words of 64 bits with the parities of 2048 parts, at the head of ``parts``; 64 counts of a byte follow
COARSE = [f"p{i}" for i in range(8)]  # the same parities folded to 512 parts
PARTS = [*COARSE, "parts"]
PARTS_TYPE = ", ".join([f"{p} long" for p in COARSE] + ["parts array<long>"])
#: Orders of a list in which stars are paired: by size, then twice by the links found so far.
STAR_ORDERS = (("n", "cls"), ("degree desc", "xxhash64(cls, 1)", "cls"), ("degree desc", "xxhash64(cls, 2)", "cls"))
HUBS = 4  # classes at the head of a list that all others are paired with
LIST = 100_000  # classes of a list in one piece; at least HUBS + 2
CELL = 4096  # classes of a component in one block, about
CELL_GRAMS = 1 << 21  # n-grams in one block, about
TILE = 512  # classes in one matrix
COLUMNS = 4096  # n-grams in one matrix


@dataclass(frozen=True)
class Similarity:
    """Word n-grams of ``words`` words; linked when ``den * intersection >= num * union``."""

    words: int = 5
    num: int = 8
    den: int = 10

    def probe(self, n):
        """Length of the prefix that must meet any similar set."""
        return n - -(-self.num * n // self.den) + 1

    def index(self, n):
        """Length of the prefix that must meet any similar set of at least the same size."""
        return n - -(-2 * self.num * n // (self.num + self.den)) + 1

    def overlap(self, a, b):
        """Least intersection of two similar sets."""
        return -(-self.num * (a + b) // (self.num + self.den))


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) if not isinstance(c, pa.Array) else c
                                       for c in columns.values()], names=list(columns))


def _class(s: np.ndarray) -> int:
    """Class of a set: 64 bits over all its hashes."""
    return int(np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), np.int64)[0])


def _measure(sim: Similarity):
    """Rows (id, key, n, cls, parts) and, at the end of the task, its counters (block, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BITS, np.int64)
        for b in batches:
            n, cls, held, parts = [], [], [], []
            for s in shingle_sets(texts(b.column(2)), sim.words):
                n.append(len(s))
                cls.append(_class(s) if len(s) else None)
                held.append(s)
                odd = np.bincount((s >> np.uint64(6)) & np.uint64(64 * FINE - 1), minlength=64 * FINE) & 1
                parts.append(np.concatenate([
                    np.packbits(odd.astype(np.uint8)), np.bincount(s & np.uint64(63), minlength=64).astype(np.uint8)
                ]).view(np.int64))
                if len(held) == 256:
                    counts += np.bincount(np.concatenate(held) >> np.uint64(64 - BITS), minlength=1 << BITS)
                    held = []
            if held:
                counts += np.bincount(np.concatenate(held) >> np.uint64(64 - BITS), minlength=1 << BITS)
            none = pa.nulls(len(n))
            table = np.array(parts, np.int64).reshape(-1, FINE + 8)
            coarse = np.bitwise_xor.reduce(table[:, :FINE].reshape(len(table), -1, len(COARSE)), axis=1)
            offsets = pa.array(np.arange(len(table) + 1) * (FINE + 8), pa.int32())
            yield _batch(id=b.column(0), key=b.column(1), n=pa.array(n, pa.int64()),
                         cls=pa.array(cls, pa.int64()), **{p: coarse[:, i].copy() for i, p in enumerate(COARSE)},
                         parts=pa.ListArray.from_arrays(offsets, pa.array(table.ravel())), block=none.cast(pa.int32()), counts=none.cast(pa.binary()))
        used = [i for i in range(0, 1 << BITS, BLOCK) if counts[i:i + BLOCK].any()]
        none = pa.nulls(len(used), pa.int64())
        yield _batch(id=none, key=none, n=none, cls=none, **{p: none for p in COARSE},
                     parts=pa.nulls(len(used), pa.list_(pa.int64())), block=pa.array([i // BLOCK for i in used], pa.int32()),
                     counts=pa.array([counts[i:i + BLOCK].tobytes() for i in used], pa.binary()))

    return run


def _sum_blocks(group):
    import pandas as pd

    total = np.zeros(BLOCK, np.int64)
    for c in group["counts"]:
        total += np.frombuffer(c, np.int64)
    return pd.DataFrame({"part": [0], "block": [group["block"].iloc[0]], "counts": [total.tobytes()]})


def _sketch(blocks: DataFrame) -> np.ndarray:
    """Sum of the tasks' counters: in two steps, so that no group grows with the number of tasks alone."""
    schema = "part int, block int, counts binary"
    partial = (
        blocks.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(256)))
        .groupBy("part", "block").applyInPandas(_sum_blocks, schema)
        .groupBy("block").applyInPandas(_sum_blocks, schema)
    )
    out = np.zeros(1 << BITS, np.int64)
    for row in partial.collect():  # 2**20 counters in all
        out[row["block"] * BLOCK:(row["block"] + 1) * BLOCK] = np.frombuffer(row["counts"], np.int64)
    return np.minimum(out, 2**31 - 1).astype(np.uint32)


def _rarest_first(s: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """The set in the global order: by counter, then by hash."""
    key = (sketch[s >> np.uint64(64 - BITS)].astype(np.uint64) << np.uint64(32)) | (s & np.uint64(0xFFFFFFFF))
    return s[np.argsort(key, kind="stable")]


def _prefixes(sim: Similarity, sketch):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = sketch.value, set()
        for b in batches:
            gram, cls, size, pos = [], [], [], []
            for s in shingle_sets(texts(b.column(0)), sim.words):
                if not len(s) or (c := _class(s)) in seen:
                    continue
                if len(seen) < 1_000_000:  # copies met in other tasks, or later, are removed in Spark
                    seen.add(c)
                p = sim.probe(len(s))
                gram.append(_rarest_first(s, counts)[:p])
                cls.append(np.full(p, c, np.int64))
                size.append(np.full(p, len(s), np.int32))
                pos.append(np.arange(p, dtype=np.int32))
            if gram:
                yield _batch(gram=np.concatenate(gram).view(np.int64), cls=np.concatenate(cls),
                             n=np.concatenate(size), pos=np.concatenate(pos))

    return run


def _may_link(sim: Similarity, na, pa_, nb, pb):
    """Length and positional filter for a shared n-gram; a is the smaller set."""
    rest = np.minimum(na - pa_, nb - pb)
    return (sim.den * na >= sim.num * nb) & (pa_ < sim.index(na)) & (rest >= sim.overlap(na, nb))


def _stars(sim: Similarity):
    """Pairs of members of one list in different components: each with the first ``HUBS`` and with the previous one.

    Rows (gram, cls, n, pos, root, piece) come sorted by list and piece.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = np.zeros((6, 0), np.int64)  # head and last row of the list that goes on
        for b in batches:
            rows = np.vstack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns])
            if not rows.shape[1]:
                continue
            new = carried.shape[1]
            rows = np.hstack([carried, rows])
            gram, cls, n, pos, root, piece = rows
            here = np.arange(len(gram))
            opens = np.r_[True, (gram[1:] != gram[:-1]) | (piece[1:] != piece[:-1])]
            first = np.maximum.accumulate(np.where(opens, here, 0))
            i = here[new:]
            partners = [np.where(first[i] + k < i, first[i] + k, -1) for k in range(HUBS)]
            partners.append(np.where(first[i] + HUBS < i, i - 1, -1))
            x, y = np.concatenate(partners), np.tile(i, HUBS + 1)
            x, y = x[x >= 0], y[x >= 0]
            less = (n[x] < n[y]) | ((n[x] == n[y]) & (cls[x] < cls[y]))
            x, y = np.where(less, x, y), np.where(less, y, x)
            keep = (root[x] != root[y]) & _may_link(sim, n[x], pos[x], n[y], pos[y])
            x, y = x[keep], y[keep]
            yield _batch(a=np.minimum(cls[x], cls[y]), b=np.maximum(cls[x], cls[y]))
            last = len(gram) - 1
            head = np.arange(first[last], min(first[last] + HUBS, len(gram)))
            carried = rows[:, head if head[-1] == last else np.r_[head, last]]

    return run


def _sets(sim: Similarity):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cls, sets, size = [], [], 0
            for s in shingle_sets(texts(b.column(0)), sim.words):
                cls.append(_class(s) if len(s) else None)
                sets.append(s.tobytes())
                size += s.nbytes
                if size > 1 << 22:
                    yield _batch(cls=pa.array(cls, pa.int64()), set=pa.array(sets, pa.binary()))
                    cls, sets, size = [], [], 0
            yield _batch(cls=pa.array(cls, pa.int64()), set=pa.array(sets, pa.binary()))

    return run


def _suffix_filter(sim: Similarity, x: str, y: str) -> str:
    """Condition that the parities and counts of n-grams by part leave room for the overlap; columns are x_.., y_.."""

    def up(over: str, by: int) -> str:  # over / by, rounded up
        return f"(({over}) + {by - 1}) div {by}"

    total = f"{x}n + {y}n"
    room = f"{total} - 2 * ({up(f'{sim.num} * ({total})', sim.num + sim.den)})"
    coarse = " + ".join(f"bit_count({x}{p} ^ {y}{p})" for p in COARSE)
    fine = f"aggregate(sequence(0, {FINE - 1}), 0, (s, i) -> s + bit_count({x}parts[i] ^ {y}parts[i]))"

    def count(side: str) -> str:
        return f"cast(shiftrightunsigned({side}parts[{FINE} + cast(i div 8 as int)], i % 8 * 8) & 255 as int)"

    d = f"abs({count(x)} - {count(y)})"
    counts = f"aggregate(sequence(0, 63), 0, (s, i) -> s + least({d}, 256 - {d}))"
    return " and ".join(f"({over}) <= {room}" for over in (coarse, fine, counts))


def _verify(sim: Similarity):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                need = sim.overlap(len(s), len(t))
                both = np.concatenate([s, t])
                both.sort()
                if np.count_nonzero(both[1:] == both[:-1]) >= need:
                    left.append(a)
                    right.append(b)
            yield _batch(a=pa.array(left, pa.int64()), b=pa.array(right, pa.int64()))

    return run


def _links_between(sim: Similarity, s: list, t: list) -> np.ndarray:
    """Matrix of 0 and 1: which sets of ``s`` link with which of ``t``."""
    a, b = np.array([len(x) for x in s]), np.array([len(x) for x in t])
    links = sim.den * np.minimum.outer(a, b) >= sim.num * np.maximum.outer(a, b)
    if not links.any():
        return links
    x, y = np.concatenate(s), np.concatenate(t)
    shared = np.intersect1d(x, y)

    def places(grams, sizes):
        at = np.minimum(np.searchsorted(shared, grams), max(len(shared) - 1, 0))
        held = shared[at] == grams if len(shared) else np.zeros(len(grams), bool)
        order = np.argsort(at[held], kind="stable")
        return np.repeat(np.arange(len(sizes)), sizes)[held][order], at[held][order]

    (xr, xc), (yr, yc) = places(x, a), places(y, b)
    both = np.zeros((len(s), len(t)), np.int64)
    for low in range(0, len(shared), COLUMNS):
        sides = []
        for r, c, n in ((xr, xc, len(s)), (yr, yc, len(t))):
            i, j = np.searchsorted(c, [low, low + COLUMNS])
            m = np.zeros((n, min(COLUMNS, len(shared) - low)), np.float32)
            m[r[i:j], c[i:j] - low] = 1
            sides.append(m)
        both += (sides[0] @ sides[1].T).astype(np.int64)
    return links & (both >= sim.overlap(a[:, None], b[None, :]))


def _cell_links(sim: Similarity, cls: np.ndarray, block: np.ndarray, sets: list) -> np.ndarray:
    """How many links each class of a cell has: with the other block, or within the only one."""
    sizes = np.array([len(s) for s in sets])
    order = np.lexsort((sizes, block))
    cut = np.flatnonzero(np.r_[True, block[order][1:] != block[order][:-1]])
    tiles = [(k, rows) for k, side in enumerate(np.split(order, cut[1:]))
             for rows in np.split(side, range(TILE, len(side), TILE))]
    counts = np.zeros(len(cls), np.int64)
    for i, (k, x) in enumerate(tiles):
        for side, y in tiles[i:]:
            low, high = sorted([(sizes[x[0]], sizes[x[-1]]), (sizes[y[0]], sizes[y[-1]])])
            if (len(cut) > 1 and k == side) or sim.den * low[1] < sim.num * high[0]:
                continue
            links = _links_between(sim, [sets[r] for r in x], [sets[r] for r in y])
            counts[x] += links.sum(axis=1)
            if x is y:
                counts[x] -= 1  # itself
            else:
                counts[y] += links.sum(axis=0)
    return counts


def _count_cells(sim: Similarity):
    """Rows (cls, links) of the cells; rows (root, low, high, block, cls, set) come sorted by cell."""

    def counted(cell: list) -> pa.RecordBatch:
        low, high, block, cls = cell[0][1], cell[0][2], *(np.array([r[i] for r in cell], np.int64) for i in (3, 4))
        if low != high and len(np.unique(block)) == 1:  # no class has the other block's hash
            links = np.zeros(len(cls), np.int64)
        else:
            links = _cell_links(sim, cls, block, [np.frombuffer(r[5], np.uint64) for r in cell])
        return _batch(cls=cls, links=links)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell: list = []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if cell and row[:3] != cell[0][:3]:
                    yield counted(cell)
                    cell = []
                cell.append(row)
        if cell:
            yield counted(cell)

    return run


def _all_links(links: DataFrame, roots: DataFrame, classes: DataFrame, sets: DataFrame, sim: Similarity) -> DataFrame:
    """(cls, n_links) for the classes of the verified ``links``, with all links that lie within their components."""
    members = classes.join(roots, classes["cls"] == roots["node"]).select("cls", "n", "root")
    ends = links.select(F.col("a").alias("cls")).union(links.select("b")).groupBy("cls").agg(
        F.count(F.lit(1)).alias("links"))
    members = members.join(ends, "cls")
    sizes = members.groupBy("root").agg(
        F.count(F.lit(1)).alias("f"), F.sum("n").alias("grams"), F.sum("links").alias("ends")).select(
        "root", (F.col("ends") < F.col("f") * (F.col("f") - 1)).alias("open"),
        F.least("f", F.greatest(F.ceil(F.col("f") / CELL), F.ceil(F.col("grams") / CELL_GRAMS))).alias("blocks"))
    members = members.join(sizes, "root")
    block = F.pmod(F.xxhash64("cls", F.lit(4)), F.col("blocks"))
    cells = (
        members.filter("open").withColumn("block", block).join(sets, "cls")
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("root", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
                "block", "cls", "set")
        .repartition("root", "low", "high").sortWithinPartitions("root", "low", "high")
        .mapInArrow(_count_cells(sim), "cls long, links long")
    )
    return members.filter("not open").select("cls", "links").union(cells).groupBy("cls").agg(
        F.sum("links").alias("n_links"))


def jaccard_join(docs: DataFrame, sim: Similarity = Similarity(), id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(id, n_shingles, class_id, component_id, n_links), one row per row of ``docs``.

    ``component_id`` is the smallest id that links reach, the row's own included; ``n_links`` the number
    of other classes that the row's class links with. A null or blank
    text has no shingles, no class and no links, and its component is its own id. Null ids take part and
    never become a component's id (null if all are null). Repeated rows give repeated rows. Extra columns
    are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text_col)).alias("key"),
        F.col(text_col).alias("text"),
    )
    with small_batches(spark):
        measured = stored(rows.mapInArrow(
            _measure(sim), f"id long, key long, n long, cls long, {PARTS_TYPE},"
                           " block int, counts binary"), "jaccard-rows")
    sketch = spark.sparkContext.broadcast(_sketch(measured.filter("block is not null")))
    measured = measured.filter("block is null").drop("block", "counts")

    with small_batches(spark):
        grams = stored(rows.select("text").mapInArrow(
            _prefixes(sim, sketch), "gram long, cls long, n int, pos int"), "jaccard-grams")
    shared = grams.groupBy("gram").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).filter("low < high")
    prefixes = stored(
        grams.join(shared.select("gram"), "gram", "left_semi").dropDuplicates(["gram", "cls"]), "jaccard-prefixes")
    crowded = stored(
        prefixes.groupBy("gram").agg(F.count(F.lit(1)).alias("f")).filter(F.col("f") > LIST)
        .select("gram", F.ceil(F.col("f") / LIST).alias("pieces")), "jaccard-crowded")
    prefixes = prefixes.join(crowded, "gram", "left").withColumn(
        "piece", F.coalesce(F.pmod(F.xxhash64("cls", F.lit(3)), F.col("pieces")), F.lit(0))).drop("pieces")

    pair = "a long, b long"
    classes = stored(
        measured.filter("cls is not null").groupBy("cls").agg(
            F.min("id").alias("least"), F.min("key").alias("key"), F.min("n").alias("n"),
            *[F.min(p).alias(p) for p in PARTS]), "jaccard-classes")

    def side(name: str) -> DataFrame:
        return classes.select(F.col("cls").alias(name[0]), *[F.col(c).alias(name + c) for c in ("n", *PARTS)])

    def filtered(pairs: DataFrame) -> DataFrame:
        a, b = side("a_"), side("b_")
        held = pairs.join(a, "a")
        return held.join(b, (held["b"] == b["b"]) & F.expr(_suffix_filter(sim, "a_", "b_"))).select(
            held["a"], held["b"])

    have: list[DataFrame] = []  # stored sets by class
    tried: list[DataFrame] = []  # stored pairs

    def held_sets() -> DataFrame:
        return functools.reduce(DataFrame.union, have).dropDuplicates(["cls"]) if len(have) > 1 else have[0]

    def verified(pairs: DataFrame) -> DataFrame:
        for before in tried:
            pairs = pairs.join(before, ["a", "b"], "left_anti")
        pairs = stored(filtered(pairs), "jaccard-pairs")
        tried.append(pairs)
        missing = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
        for sets in have:
            missing = missing.join(sets.select("cls"), "cls", "left_anti")
        keys = stored(classes.join(missing, "cls", "left_semi").select("key").distinct(), "jaccard-keys")
        if keys.head(1):  # few keys are sent to the texts, else all texts are sent to the keys
            with small_batches(spark):
                have.append(stored(
                    rows.join(keys, "key", "left_semi").select("text")
                    .mapInArrow(_sets(sim), "cls long, set binary").filter("cls is not null").dropDuplicates(["cls"]),
                    "jaccard-sets"))
        if not have:
            return pairs
        sets = held_sets()
        with small_batches(spark):
            return stored(
                pairs.join(sets.select(F.col("cls").alias("a"), F.col("set").alias("s")), "a")
                .join(sets.select(F.col("cls").alias("b"), F.col("set").alias("t")), "b")
                .select("a", "b", "s", "t").mapInArrow(_verify(sim), pair), "jaccard-links")

    def rooted(roots: DataFrame | None) -> DataFrame:
        if roots is None:
            return prefixes.withColumn("root", F.col("cls"))
        return prefixes.join(roots, prefixes["cls"] == roots["node"], "left").drop("node").withColumn(
            "root", F.coalesce("root", "cls"))

    def linked() -> DataFrame:
        return links.select(F.col("a").alias("node")).union(links.select("b")).groupBy("node").agg(
            F.count(F.lit(1)).alias("degree"))

    links = roots = None
    for order in STAR_ORDERS:
        lists = rooted(roots)
        if links is not None:
            lists = lists.join(linked(), lists["cls"] == F.col("node"), "left").na.fill(0, ["degree"])
        lists = lists.repartition("gram", "piece").sortWithinPartitions(
            "gram", "piece", *[F.expr(o.removesuffix(" desc")).desc() if o.endswith(" desc") else F.expr(o)
                               for o in order])
        pairs = lists.select("gram", "cls", "n", "pos", "root", "piece").mapInArrow(_stars(sim), pair).distinct()
        found = verified(pairs)
        links = found if links is None else links.union(found)
        roots = components(links, "jaccard-components")

    crossing = _crossings(rooted(roots), classes, sim)
    if crossing.head(1):
        links = links.union(verified(crossing))
        roots = components(links, "jaccard-components")

    known = (
        classes.join(roots, classes["cls"] == roots["node"], "left").drop("node")
        .withColumn("root", F.coalesce("root", "cls"))
        .select("cls", "least", "root")
    )
    whole = known.groupBy("root").agg(F.min("least").alias("component_id"))
    known = stored(known.join(whole, "root").select("cls", "component_id"), "jaccard-known")
    out = measured.join(known, "cls", "left")
    if have:
        out = out.join(_all_links(links, roots, classes, held_sets(), sim), "cls", "left")
    else:
        out = out.withColumn("n_links", F.lit(0).cast("long"))
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("cls").alias("class_id"),
        F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def _crossings(marked: DataFrame, classes: DataFrame, sim: Similarity) -> DataFrame:
    """Pairs of one list that are in different components and pass the length, positional and suffix filter.

    Members outside the list's largest component meet all others; of two such members the one with the smaller class is
    the left one. In lists of up to ``HUBS + 2`` members the stars have paired all.
    """
    several = marked.groupBy("gram", "root").agg(F.count(F.lit(1)).alias("f")).groupBy("gram").agg(
        F.sum("f").alias("f"), F.count(F.lit(1)).alias("parts"), F.max_by("root", F.struct("f", "root")).alias("main")
    ).filter(F.col("f") > HUBS + 2).filter("parts > 1").select("gram", "main")
    many = stored(marked.drop("n", "piece").join(several, "gram").join(
        classes.select("cls", "n", *PARTS), "cls"), "jaccard-crossing")
    columns = ("cls", "n", "pos", "root", *PARTS)
    x = many.filter("root <> main").select("gram", "main", *[F.col(c).alias("x_" + c) for c in columns])
    y = many.select("gram", *[F.col(c).alias("y_" + c) for c in columns])

    def up(over: str, by: int) -> str:  # over / by, rounded up
        return f"(({over}) + {by - 1}) div {by}"

    low, high = "least(x_n, y_n)", "greatest(x_n, y_n)"
    low_pos = "if(x_n < y_n or x_n = y_n and x_cls < y_cls, x_pos, y_pos)"  # place in the smaller set
    ok = (
        f"x_root <> y_root and (y_root = main or x_cls < y_cls) and {sim.den} * {low} >= {sim.num} * {high}"
        f" and {low_pos} < {low} - {up(f'{2 * sim.num} * {low}', sim.num + sim.den)} + 1"
        f" and least(x_n - x_pos, y_n - y_pos) >= {up(f'{sim.num} * (x_n + y_n)', sim.num + sim.den)}"
        f" and {_suffix_filter(sim, 'x_', 'y_')}"
    )
    pairs = x.alias("x").join(y.alias("y"), (F.col("x.gram") == F.col("y.gram")) & F.expr(ok))
    return stored(pairs.select(F.least("x_cls", "y_cls").alias("a"), F.greatest("x_cls", "y_cls").alias("b"))
                  .distinct(), "jaccard-crossing-pairs")
