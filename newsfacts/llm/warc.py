"""WARC archives with an external index that is merged into capture histories.

Writing: each page becomes one record. Of pages with equal payloads the one with the smallest id is the
response, the others are revisits of it. Records are UTF-8 text, so Spark's text writer
puts them, one after the other, into WARC files in any file system it knows, each compressed as a whole by
gzip. Offsets and lengths in the index count bytes of the uncompressed file.

Reading: an archive file is parsed by its records' lengths. Its records' index entries are sorted by URL key
and time: a run. Range partitions of (URL key, time, id) cut all runs alike, and each task merges its
slices of the runs with a tree of losers. The result is globally ordered, partition after partition.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsfacts.llm.store import stored
from newsfacts.session import new_path, ship

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
FILE_BYTES = 16 << 20  # of payload in an archive file, about
ENTRY = ("page_id long, url_key string, captured string, url string, file string, offset long, length long, "
         "record_type string, payload_bytes long, payload_digest string, refers_to long")
_TYPES = {"long": pa.int64(), "string": pa.string()}
_NAMES = [c.split()[0] for c in ENTRY.split(", ")]
_SCHEMA = pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in ENTRY.split(", ")])


def base32_sha1(payload: Column) -> Column:
    """SHA-1 of UTF-8 bytes in upper-case base32: four times ten hexadecimal digits give eight characters."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", _BASE32)


def url_key(url: Column) -> Column:
    """Sort key of a URL: host labels reversed and joined by commas, then ``)`` and the rest; lower case.

    Scheme, user, port, a leading ``www`` and the fragment do not count. A null URL has the key ``-``.
    """
    low = F.lower(F.trim(url))
    bare = F.regexp_replace(F.regexp_replace(low, r"#.*$", ""), r"^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_extract(bare, r"^(?:[^/?@]*@)?([^/?:]*)", 1), r"^www\d*\.", "")
    rest = F.regexp_replace(bare, r"^(?:[^/?@]*@)?[^/?:]*(?::\d+)?", "")
    path = F.when(rest == "", "/").otherwise(rest)
    return F.coalesce(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), path), F.lit("-"))


def _with_responses(pages: DataFrame, least: int) -> DataFrame:
    """Digest, size and the response that each page revisits, if any."""
    rows = pages.withColumns({
        "payload_bytes": F.octet_length("payload").cast("long"),
        "payload_digest": base32_sha1(F.encode("payload", "UTF-8"))})
    narrow = rows.select("page_id", "payload_bytes", "payload_digest")
    first = (
        narrow.filter(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes")
        .agg(F.min("page_id").alias("response"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    )
    return rows.join(first, ["payload_digest", "payload_bytes"], "left").withColumn(
        "refers_to", F.when(F.col("response") < F.col("page_id"), F.col("response"))).drop("response")


def write_archives(pages: DataFrame, path: str, captured: Column, least: int = 0, id_col: str = "page_id",
                   url_col: str = "url", payload_col: str = "html") -> None:
    """One record per page in WARC files under ``path``.

    A null payload is empty. ``captured`` is the time of a page. Equal payloads of at least ``least`` bytes
    are stored once, smaller ones always. Pages with a null id are responses without ``X-Page-Id``; rows that
    repeat an id are equal in rank and all of them responses, unless a smaller id has their payload. A
    null URL is written as ``urn:unknown``. Line breaks in URLs become spaces.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
        F.coalesce(F.col(payload_col), F.lit("")).alias("payload"), captured.alias("captured"))
    rows = _with_responses(rows, least)
    date = F.date_format("captured", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    target = F.coalesce(F.regexp_replace("url", r"[\r\n]+", " "), F.lit("urn:unknown"))
    revisit = F.col("refers_to").isNotNull()
    identity = F.md5(F.concat_ws(" ", F.col("page_id").cast("string"), date, target, "payload_digest"))
    http = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("payload")))
    head = F.concat_ws(
        "\r\n", F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:uuid:"), F.regexp_replace(
            identity, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), target), F.concat(F.lit("WARC-Date: "), date),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.concat(F.lit("X-Refers-To-Page: "), F.col("refers_to").cast("string")),
        F.concat(F.lit("X-Page-Id: "), F.col("page_id").cast("string")),
        F.concat(F.lit("X-Payload-Length: "), F.col("payload_bytes").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    # The writer ends each record with a line feed, so the record itself ends just before that.
    record = F.concat(head, F.lit("\r\n\r\n"), block, F.lit("\r\n\r"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("payload")).alias("b")).first()
    most = max(1, size["n"] * FILE_BYTES // max(1, size["b"] or 0))
    rows.select(record.alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", most).option(
        "compression", "gzip").text(path)


def parse_records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], memoryview]]:
    """(offset, length, header fields, block) of each record."""
    at, view = 0, memoryview(data)
    while at < len(data):
        head_end = data.index(b"\r\n\r\n", at)
        lines = data[at:head_end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        begin, size = head_end + 4, int(fields["Content-Length"])
        if data[begin + size:begin + size + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} has a wrong length")
        yield at, begin + size + 4 - at, fields, view[begin:begin + size]
        at = begin + size + 4


def unpacked(data: bytes) -> bytes:
    """An archive file's records; a file that is not compressed is taken as it is."""
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            run = []
            for offset, length, fields, block in parse_records(unpacked(data.as_py())):
                payload = block[bytes(block).index(b"\r\n\r\n") + 4:]
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if fields["WARC-Type"] == "response":
                    found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    if found != digest or len(payload) != int(fields["X-Payload-Length"]):
                        raise ValueError(f"{file}: payload at byte {offset} is not what its record says")
                page, refers = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page")
                run.append((page and int(page), None, fields["WARC-Date"], fields["WARC-Target-URI"], file, offset,
                            length, fields["WARC-Type"], int(fields["X-Payload-Length"]), digest,
                            refers and int(refers)))
            if run:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*run), _SCHEMA.types)], schema=_SCHEMA)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Index entries of all records under ``path``; a file is read by one task and checked against its digests."""
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    entries = files.mapInArrow(_entries, ENTRY)
    known = F.when(F.col("url") != "urn:unknown", F.col("url"))
    return entries.withColumn("url_key", url_key(known)).withColumn("url", known)


class LoserTree:
    """Merges sorted lists: each inner node keeps the loser of its match, the winner moves up."""

    def __init__(self, runs: list[list]):
        self.runs, self.k = runs, len(runs)
        self.at = [0] * self.k
        self.tree = [-1] * max(1, self.k)
        for i in range(self.k):
            self._play(i)

    def _key(self, i: int):
        """A list that is used up loses against all others."""
        return (1,) if self.at[i] >= len(self.runs[i]) else (0, self.runs[i][self.at[i]])

    def _play(self, i: int) -> None:
        node = (i + self.k) // 2
        while node > 0:
            other = self.tree[node]
            if other < 0:  # first to arrive waits for its opponent
                self.tree[node] = i
                return
            if self._key(other) < self._key(i):
                self.tree[node], i = i, other
            node //= 2
        self.tree[0] = i

    def __iter__(self):
        while self.k and self.at[self.tree[0]] < len(self.runs[self.tree[0]]):
            i = self.tree[0]
            yield self.runs[i][self.at[i]]
            self.at[i] += 1
            self._play(i)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge a partition's slices of the runs. Rows come by file, and in order within a file."""
    table = pa.Table.from_batches(batches)
    if not table.num_rows:
        return
    keys = [table[c].to_pylist() for c in ("file", "url_key", "captured", "page_id", "offset")]
    runs, last = [], None
    for row, (file, key, time, page, offset) in enumerate(zip(*keys)):
        if file != last:
            runs.append([])
            last = file
        runs[-1].append((key, time, page is None, page or 0, file, offset, row))
    order = pa.array([entry[-1] for entry in LoserTree(runs)], pa.int64())
    yield from table.take(order).combine_chunks().to_batches(max_chunksize=10_000)


def capture_histories(entries: DataFrame, run_rows: int = 100_000) -> DataFrame:
    """All entries in the order of (url_key, captured, page_id), nulls last, across partitions.

    ``capture`` numbers the captures of a URL key from 1. Each archive file is a locally sorted run. A busy
    URL key spreads over several ranges, as ids are part of the order; a merging task holds the index entries
    of one range, about ``run_rows``. An empty index gives no rows.
    """
    n = max(1, entries.count() // run_rows)
    runs = entries.sortWithinPartitions("file", "url_key", "captured", F.col("page_id").asc_nulls_last(), "offset")
    sliced = runs.repartitionByRange(
        n, "url_key", "captured", F.col("page_id").asc_nulls_last(), "file", "offset"
    ).sortWithinPartitions("file", "url_key", "captured", F.col("page_id").asc_nulls_last(), "offset")
    merged = stored(sliced.mapInArrow(_merge, ENTRY).withColumn("part", F.spark_partition_id()), "warc-index")
    # Numbering goes by counts per key and range, so no window holds more than a range.
    counts = merged.groupBy("url_key", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("url_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("url_key", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("url_key", "part").orderBy(
        "captured", F.col("page_id").asc_nulls_last(), "file", "offset")
    return (
        merged.withColumn("capture", F.row_number().over(within))
        .join(firsts, ["url_key", "part"]).withColumn("capture", (F.col("capture") + F.col("before")).cast("long"))
        .select(*_NAMES, "capture")
    )


def archive_and_index(pages: DataFrame, captured: Column, least: int = 0, id_col: str = "page_id",
                      url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write all pages to archives in the shared folder, read them back and return their capture histories.

    Cases as for ``write_archives``. An empty table gives no rows. Extra columns are not read.
    """
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path, captured, least, id_col, url_col, payload_col)
    return capture_histories(read_index(pages.sparkSession, path))
