"""Compression of vectors to codes of 16 bytes, with exact nearest entries by slices and bit masks.

A vector is cut into equal parts, and a part is replaced by the number of its codebook's nearest entry. Codebooks
have up to 64 entries, so a set of entries is one uint64. In each dimension the entries' coordinates are sorted, and
every prefix of the order carries the mask of its entries. The distance to a near entry is an initial radius; in
each dimension two searches give the slice of entries within it, as the difference of two prefix masks, and the
masks of all dimensions are intersected. The nearest entry is always left, and only those left are measured.

Codebooks are learnt from all vectors: each task sums its parts by entry, Spark adds the sums, and codebooks alone
(64 entries of whole numbers) pass through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsfacts.llm.store import stored
from newsfacts.session import ship

HIGHEST = 1 << 24  # of a component as a whole number; beyond it is cut to it, so that squares fit


@dataclass(frozen=True)
class Codebooks:
    """``entries[part]``: rows of whole numbers, as many as there are entries."""

    entries: list[np.ndarray]
    width: int  # components of a vector

    def whole_numbers(self) -> str:
        """All components in decimal, by part, entry and position, joined by commas."""
        return ",".join(str(x) for book in self.entries for x in book.ravel().tolist())


class Slices:
    """The entries of one codebook, sorted by each coordinate, with the masks of the prefixes."""

    def __init__(self, entries: np.ndarray):
        if len(entries) > 64:
            raise ValueError("a mask holds 64 entries")
        self.entries = entries
        self.order = np.argsort(entries, axis=0, kind="stable").T
        self.coordinates = np.take_along_axis(entries.T, self.order, axis=1)
        bits = np.uint64(1) << self.order.astype(np.uint64)
        self.prefix = np.zeros((entries.shape[1], len(entries) + 1), np.uint64)
        self.prefix[:, 1:] = np.bitwise_or.accumulate(bits, axis=1)

    def _distance(self, x: np.ndarray, entry) -> np.ndarray:
        return ((x - self.entries[entry]) ** 2).sum(axis=1)

    def candidates(self, x: np.ndarray) -> np.ndarray:
        """For each row a mask of entries that holds the nearest ones."""
        radius = None
        for order, line, column in zip(self.order, self.coordinates, x.T):
            near = self._distance(x, order[np.minimum(np.searchsorted(line, column), len(line) - 1)])
            radius = near if radius is None else np.minimum(radius, near)
        reach = np.sqrt(radius.astype(float)).astype(np.int64) + 1  # no less than the root of the square
        mask = np.full(len(x), ~np.uint64(0))
        for prefix, line, column in zip(self.prefix, self.coordinates, x.T):
            low, high = np.searchsorted(line, column - reach), np.searchsorted(line, column + reach, "right")
            mask &= prefix[high] ^ prefix[low]
        return mask

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest entry (the lowest of equally near ones) and squared distance to it."""
        mask = self.candidates(x)
        entry, least = np.zeros(len(x), np.int64), np.full(len(x), np.iinfo(np.int64).max)
        for e in range(len(self.entries)):
            rows = np.flatnonzero(mask >> np.uint64(e) & np.uint64(1))
            d = self._distance(x[rows], e)
            closer = d < least[rows]
            entry[rows[closer]], least[rows[closer]] = e, d[closer]
        return entry, least


def whole(column: pa.Array, scale: int, parts: int) -> np.ndarray:
    """Vectors as whole numbers floor(scale * x), widened by zeros to a multiple of ``parts``."""
    n = len(column)
    x = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(n, -1)
    x = np.clip(np.floor(x * scale), -HIGHEST, HIGHEST).astype(np.int64)
    return np.pad(x, ((0, 0), (0, -x.shape[1] % parts)))


def _sums(books: Codebooks, scale: int):
    """(slot, place, total, n): sums of the parts of each entry of this task, a row for each component."""
    parts = len(books.entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = [Slices(e) for e in books.entries]
        m, d = books.entries[0].shape
        total, count = np.zeros((parts, m, d), np.int64), np.zeros((parts, m), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = whole(batch.column(0), scale, parts)
            for p in range(parts):
                part = x[:, p * d:(p + 1) * d]
                entry, _ = slices[p].nearest(part)
                order = np.argsort(entry, kind="stable")
                first = np.flatnonzero(np.r_[True, np.diff(entry[order]) != 0])
                used = entry[order][first]
                total[p, used] += np.add.reduceat(part[order], first, axis=0)
                count[p] += np.bincount(entry, minlength=m)
        slot = np.flatnonzero(count.ravel())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(slot, d)), pa.array(np.tile(np.arange(d), len(slot))),
             pa.array(total.reshape(-1, d)[slot].ravel()), pa.array(np.repeat(count.ravel()[slot], d))],
            names=["slot", "place", "total", "n"])

    return run


def _codes(books: Codebooks, scale: int):
    parts = len(books.entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = [Slices(e) for e in books.entries]
        d = books.entries[0].shape[1]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = whole(batch.column(0), scale, parts)
            code, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p in range(parts):
                code[:, p], least = slices[p].nearest(x[:, p * d:(p + 1) * d])
                error += least
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array([c.tobytes() for c in code], pa.binary()), pa.array(error)],
                names=["id", "label", "code", "error"])

    return run


def _kept(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """Rows whose vectors have components, all of them finite numbers."""
    numbers = F.col("vector")
    return vectors.select(
        F.col(vector_col).cast("array<double>").alias("vector"), F.col(id_col).alias("id"),
        F.col(label_col).alias("label"),
    ).filter(numbers.isNotNull() & (F.size(numbers) > 0) & F.forall(
        numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))


def learn(kept: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> Codebooks | None:
    """Codebooks of the rows (vector, id): the first vectors by id, then moved to the mean of their parts ``rounds`` times.

    Rows of equal id are ordered by their vectors; null ids come last. None if there are no rows.
    """
    def first(rows: DataFrame) -> list:
        return rows.select("vector", "id").orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()

    seeds = first(kept)
    if not seeds:
        return None
    width = len(seeds[0]["vector"])
    if any(len(s["vector"]) != width for s in seeds):
        seeds = first(kept.filter(F.size("vector") == width))
    x = whole(pa.array([s["vector"] for s in seeds], pa.list_(pa.float64())), scale, parts)
    books = Codebooks([np.ascontiguousarray(c) for c in np.split(x, parts, axis=1)], width)
    rows = kept.filter(F.size("vector") == width).select("vector")
    for _ in range(rounds):
        moved = [e.copy() for e in books.entries]
        found = rows.mapInArrow(_sums(books, scale), "slot long, place long, total long, n long").groupBy(
            "slot", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
        for slot, place, total, n in found.collect():  # one row a component of a codebook
            moved[slot // len(x)][slot % len(x), place] = int(total) // n
        books = Codebooks(moved, width)
    return books


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256,
             id_col: str = "vec_id", vector_col: str = "embedding",
             label_col: str = "label") -> tuple[DataFrame, Codebooks | None]:
    """(id, label, code, error, label_error) of the kept vectors, and the codebooks.

    ``code`` holds a byte a part, ``error`` the sum of the squared distances between the parts and their entries in units of
    1 / scale, ``label_error`` its sum over the rows of equal label, null labels together. Dropped are vectors
    that are null or empty, hold null or non-finite components, or are not as long as the first one by id. A length that
    ``parts`` does not divide is widened by zeros; components beyond 2**24 / scale count as that. With fewer vectors
    than ``entries`` the codebooks have as many entries as vectors. Repeated rows give repeated rows; null ids
    stay null and are seeds only if ids are short. An empty table gives no rows and no codebooks.
    """
    spark = vectors.sparkSession
    ship(spark)
    kept = _kept(vectors, id_col, vector_col, label_col)
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    books = learn(kept, parts, entries, rounds, scale)
    schema = f"id {kinds['id']}, label {kinds['label']}, code binary, error long"
    if books is None:
        return spark.createDataFrame([], schema + ", label_error long").withColumnsRenamed(
            {"id": id_col, "label": label_col}), None
    coded = stored(kept.filter(F.size("vector") == books.width).mapInArrow(_codes(books, scale), schema), "vector-codes")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    sums = stored(sums, "vector-labels")
    rows = sums.agg(F.sum("n")).first()[0]
    # A label of more than a thousandth of the rows would be one task of a shuffle join; there are at most 1000 such.
    busy = F.broadcast(sums.filter(F.col("n") * 1000 > rows).select(F.col("label").alias("l"), "label_error"))
    rest = sums.filter(F.col("n") * 1000 <= rows).select(F.col("label").alias("l"), "label_error")
    same = F.col("label").eqNullSafe(F.col("l"))
    out = coded.join(busy, same).drop("l")
    if rest.head(1):
        out = out.unionByName(coded.join(busy, same, "left_anti").join(rest, same).drop("l"))
    return out.withColumnsRenamed({"id": id_col, "label": label_col}), books
