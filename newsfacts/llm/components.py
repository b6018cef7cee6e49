"""Connected components by alternating star contractions, after each task has joined its own links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsfacts.llm.store import stored
from newsfacts.session import ship


ROWS = 100_000  # links in a partition, at least
PIECE = 400_000  # links that a task joins at once; so few need no rounds


def _hung(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links, and the smallest node that links reach from each."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[:len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while (far := root[a] != root[b]).any():
        a, b = a[far], b[far]
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        np.minimum.at(root, high, low)
        while not np.array_equal(up := root[root], root):
            root = up
    return nodes, nodes[root]


def _forest(piece: int):
    """Links (a, b), a < b, of each node with the smallest that the task's links reach, by pieces of ``piece`` links."""

    def joined(held: list) -> pa.RecordBatch:
        nodes, root = _hung(*(np.concatenate(side) for side in zip(*held)))
        far = nodes != root
        return pa.RecordBatch.from_arrays([pa.array(root[far]), pa.array(nodes[far])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for low in range(0, batch.num_rows, piece):
                part = batch.slice(low, piece)
                if held and size + part.num_rows > piece:
                    yield joined(held)
                    held, size = [], 0
                held.append([c.to_numpy() for c in part.columns])
                size += part.num_rows
        if held:
            yield joined(held)

    return run


def _local(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").mapInArrow(_forest(PIECE), "a long, b long")


def _stars(edges: DataFrame, large: bool, parts: int) -> DataFrame:
    """Hang the neighbours of each node on the smallest of them.

    ``edges`` has each link once as (a, b) with a < b. A large star moves the neighbours above the node,
    a small star those below. Minima are partial aggregates and the join leaves busy nodes to AQE. Each step
    leaves at most ``parts`` partitions, so that few links are not dealt over many files.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))) if large else (
        edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("low")).coalesce(parts)
    least = least.withColumn("low", F.least("a", "low"))
    moved = both.join(least, "a")
    if large:
        moved = moved.filter(F.col("b") > F.col("a")).select(F.col("low").alias("a"), "b")
    else:
        moved = moved.select(F.col("low").alias("a"), "b").union(
            least.select(F.col("low").alias("a"), F.col("a").alias("b")))
    return moved.filter(F.col("a") != F.col("b")).coalesce(parts).distinct().coalesce(parts)


def _state(edges: DataFrame) -> tuple:
    """Number of links and a checksum of them."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of the links (a, b); root is the smallest node that links reach.

    Links are stored once, and those of a task replaced by as many as it has nodes or fewer. Up to ``PIECE`` links are
    one task's, which is the whole job; more go on in rounds until they do not change or are so few. Each round is stored
    in the shared folder. Rounds grow with the logarithm of the longest chain. The driver sees one count and one checksum
    per round. No links give no rows.
    """
    ship(edges.sparkSession)
    edges = stored(
        edges.filter(F.col("a") != F.col("b"))
        .select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b")), name)
    n = edges.count()
    if n > PIECE:
        edges, seen = stored(_local(edges.coalesce(1 + n // ROWS)).distinct(), name), None
        while (state := _state(edges)) != seen and state[0] > PIECE:
            seen, parts = state, 1 + state[0] // ROWS
            edges = stored(_stars(_stars(edges.coalesce(parts), True, parts), False, parts), name)
        n = state[0]
    if n <= PIECE:
        edges = stored(_local(edges.coalesce(1)), name)
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(
        edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
