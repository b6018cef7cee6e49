"""Byte-level BPE of a corpus by one global shuffle of its distinct words.

1. Texts are cut into pre-tokens by the vocabulary's pattern. Each task deals its texts into blocks of bounded
   size and numbers the distinct words of a block. A text becomes word numbers in the order of their positions; a
   block's words become entries (block, number, word). So a word costs one entry a block, not one an occurrence, and
   the most frequent word no more than any other.
2. The words of all blocks meet in one shuffle, dealt into ranges by their hash: each distinct word of the corpus is
   encoded once, by the task of its range, and its ids go back to all its (block, number). Words travel packed, a row
   for each block and range.
3. The ids go to their block's texts, which are stored in buckets and stay where they are, and are put in the places of
   the numbers.

Decoding joins ids with the table of token bytes, which is as long as the vocabulary and goes to every task.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsfacts.llm.store import bucketed, stored
from newsfacts.llm.text import texts
from newsfacts.session import ship

PIECE = 1 << 14  # words numbered at a time
BLOCK = 1 << 22  # words in a block
WORDS = 1 << 19  # distinct words in a block
BYTES = 1 << 25  # of distinct words in a block
LONG = 1 << 20  # characters; the words of a longer text are never all in memory


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file: a line each, base64 and number."""
    with open(path, "rb") as lines:
        return {base64.b64decode(t): int(n) for t, n in map(bytes.split, lines)}


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: of all neighbouring parts the pair of the lowest rank merges, the leftmost first."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    none = len(ranks) << 8
    if n < 64:
        parts = [word[i:i + 1] for i in range(n)]
        pairs = [ranks.get(word[i:i + 2], none) for i in range(n - 1)]
        while pairs and (rank := min(pairs)) != none:
            i = pairs.index(rank)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        return [ranks[p] for p in parts]
    after, before, alive = [*range(1, n + 1), n], [*range(-1, n)], [True] * n
    heap = [(ranks[word[i:i + 2]], i, i + 2) for i in range(n - 1) if word[i:i + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        middle = after[i] if alive[i] else n
        if middle >= n or after[middle] != end:
            continue  # one of the two has merged since
        alive[middle] = False
        after[i] = end
        if end < n:
            before[end] = i
        for a, b in ((before[i], end), (i, after[end] if end < n else end)):
            if a >= 0 and b > after[a] and (rank := ranks.get(word[a:b])) is not None:
                heapq.heappush(heap, (rank, a, b))
    return [ranks[word[i:after[i]]] for i in range(n) if alive[i]]


_TABLE = "row long, id long, block long, size int, numbers binary, part int, lengths binary, n_bytes int, bytes binary"


def pack(numbers: np.ndarray) -> bytes:
    """Numbers by planes of bytes, so that the empty high ones cost nothing, compressed."""
    return pa.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)


def unpack(packed: bytes, size: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, 4 * size, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def pack_values(values: list[bytes]) -> tuple[bytes, int, bytes]:
    """Lengths, size and compressed bytes of values end to end."""
    blob = b"".join(values)
    return pack(np.array([len(v) for v in values])), len(blob), pa.compress(blob, "zstd", asbytes=True)


def unpack_values(lengths: bytes, n_bytes: int, packed: bytes, size: int) -> list[bytes]:
    ends = np.cumsum(unpack(lengths, size)).tolist()
    blob = pa.decompress(packed, n_bytes, "zstd", asbytes=True)
    return [blob[lo:hi] for lo, hi in zip([0, *ends], ends)]


def _numbered(pattern: str, distinct: int, ranges: int):
    """A row (row, id, size, numbers) a text, and rows (part, size, numbers, values) for the words of their blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        compiled = regex.compile(pattern)
        row = block = TaskContext.get().partitionId() << 32
        rows, numbers, words, size = [], {}, 0, 0

        def flush():
            words = [w.encode() for w in numbers]
            part = np.array([crc32(w) for w in words], np.int64) % ranges
            order = np.argsort(part, kind="stable")
            entries = []
            for at in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if words else ():
                entries.append((len(at), pack(np.diff(at, prepend=0)), int(part[at[0]]),
                                *pack_values([words[i] for i in at.tolist()])))
            table = [(row, key, block, size, code) + (None,) * 4 for row, key, size, code in rows]
            table += [(None, None, block, *entry) for entry in entries]
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.int32(),
                     pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*table), types)],
                                              names=[c.split()[0] for c in _TABLE.split(", ")])

        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                text = value.decode("utf-8", "replace")
                if rows and (words > BLOCK or len(numbers) > distinct or size > BYTES
                             or len(text) > LONG and words + len(text) > BLOCK):
                    yield flush()
                    rows, numbers, words, size = [], {}, 0, 0
                    block += 1
                found = (m[0] for m in compiled.finditer(text)) if len(text) > LONG else iter(compiled.findall(text))
                codes, before = [], len(numbers)
                while part := list(islice(found, PIECE)):
                    codes.append(np.array([numbers.setdefault(w, len(numbers)) for w in part], np.uint32))
                code = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
                size += sum(len(w) for w in islice(reversed(numbers), len(numbers) - before))
                rows.append((row, key, len(code), pack(code)))
                words, row = words + len(code), row + 1
        if rows:
            yield flush()

    return run


_ENTRY = ["block", "size", "numbers", "lengths", "n_bytes", "bytes"]


def _encoded(ranks):
    """Entries sorted by part, with the ids of their words in place of the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known = None, {}
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["part"] != now:
                    now, known = row["part"], {}
                words = unpack_values(row["lengths"], row["n_bytes"], row["bytes"], row["size"])
                for word in words:
                    if word not in known:
                        known[word] = np.array(encode_word(word, ranks.value), "<u4").tobytes()
                out.append((row["block"], row["size"], row["numbers"], *pack_values([known[w] for w in words])))
            types = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=_ENTRY)

    return run


def _placed(rows: pa.Table, entries: pa.Table) -> pa.Table:
    """A block's texts as the ids of their words in the order of positions."""
    ids = [b""] * sum(entries.column("size").to_pylist())
    for row in entries.to_pylist():
        values = unpack_values(row["lengths"], row["n_bytes"], row["bytes"], row["size"])
        for number, value in zip(np.cumsum(unpack(row["numbers"], row["size"])).tolist(), values):
            ids[number] = value
    out = [b"".join([ids[i] for i in unpack(numbers, size).tolist()])
           for numbers, size in zip(rows.column("numbers").to_pylist(), rows.column("size").to_pylist())]
    return pa.table({"row": rows.column("row"), "id": rows.column("id"), "ids": pa.array(out, pa.binary())})


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id",
           text_col: str = "text", distinct: int = WORDS) -> DataFrame:
    """(row, id, n_tokens, ids): one row per row of ``docs``, ``row`` being a number of its own.

    ``ids`` are little-endian unsigned 32-bit integers in one binary value. Null and empty texts have none. Texts of
    any length are taken whole, each by one task, in memory that grows with its own length only. Repeated rows and equal
    ids stay rows of their own, null ids stay null. An empty table gives no rows. Extra columns are not read.
    ``ranks`` goes to all executors; its size is the vocabulary's. All 256 single bytes must be in it. A block numbers
    at most ``distinct`` words and those of one text.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ranges = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = bucketed(rows.mapInArrow(_numbered(pattern, distinct, ranges), _TABLE), "bpe-words", "block", "zstd")
    words = table.filter("part is not null").select("part", *_ENTRY).repartition("part").sortWithinPartitions("part")
    entries = stored(words.mapInArrow(
        _encoded(spark.sparkContext.broadcast(ranks)),
        "block long, size int, numbers binary, lengths binary, n_bytes int, bytes binary"), "bpe-entries")
    of_block = table.filter("row is not null").select("row", "id", "size", "numbers", "block").groupBy("block")
    whole = of_block.cogroup(entries.withColumnRenamed("block", "of").groupBy("of")).applyInArrow(
        _placed, "row long, id long, ids binary")
    return whole.select(
        "row", F.col("id").alias(id_col), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


def _bytes(tokens):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = tokens.value
        for batch in batches:
            for i in range(0, batch.num_rows, 64):  # little at a time, as texts may be long
                part = batch.slice(i, 64)
                out = [b"".join([table.get(n, b"") for n in np.frombuffer(ids or b"", "<u4").tolist()])
                       for ids in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(out, pa.binary())],
                                                 names=[*part.schema.names[1:], "bytes"])

    return run


def decode(encoded: DataFrame, ranks: dict[bytes, int], keep: list[str], ids_col: str = "ids") -> DataFrame:
    """Columns ``keep`` of ``encoded`` and ``bytes``, what the ids stand for, one row per row.

    ``ids_col`` holds little-endian unsigned 32-bit integers; null or none give no bytes, nor does an id that is not in
    ``ranks``. No rows move: the table of token bytes, of the vocabulary's size, goes to all executors.
    """
    spark = encoded.sparkSession
    ship(spark)
    tokens = spark.sparkContext.broadcast({n: t for t, n in ranks.items()})
    rows = encoded.select(F.col(ids_col).alias("_ids"), *keep)
    schema = ", ".join(["`" + f.name.replace("`", "``") + "` " + f.dataType.simpleString()
                        for f in encoded.select(*keep).schema.fields] + ["bytes binary"])
    return rows.mapInArrow(_bytes(tokens), schema)
