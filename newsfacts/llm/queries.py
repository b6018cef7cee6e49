"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsfacts.llm import byte_bpe, toxicity
from newsfacts.llm.decontaminate import contamination
from newsfacts.llm.fingerprint import fingerprints
from newsfacts.llm.lines import line_dedup
from newsfacts.llm.lm import score_texts
from newsfacts.llm.mixing import draws
from newsfacts.llm.ngram_join import Similarity, jaccard_join
from newsfacts.llm.runs import periodic_runs
from newsfacts.llm.sharding import shard
from newsfacts.llm.suffixes import repeated_passages
from newsfacts.llm.vector_codes import compress
from newsfacts.llm.warc import archive_and_index

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_ngram_jaccard_join", r"""
WITH RECURSIVE
words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE
    WHEN len(w) = 0 THEN []
    WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2]))
  END AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM items a JOIN items b ON a.g = b.g AND a.doc_id < b.doc_id
    AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
links AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
reach AS (
  SELECT x AS node, x AS seen FROM links
  UNION
  SELECT reach.node, links.y FROM reach JOIN links ON reach.seen = links.x)
SELECT sets.doc_id, len(s)::BIGINT AS n_shingles, coalesce(least(sets.doc_id, low), sets.doc_id) AS component_id
FROM sets LEFT JOIN (SELECT node, min(seen) AS low FROM reach GROUP BY node) ON node = sets.doc_id
""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = jaccard_join(_table(spark, sf_dir, "documents"), Similarity(words=3, num=9, den=10))
    return joined.select("doc_id", F.col("n_shingles").cast("long"), "component_id")


@query("op8_benchmark_decontamination", r"""
WITH
item_words AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size,
    unnest(list_transform(range(1, greatest(len(w) - 8, 2)), lambda i: array_to_string(w[i:i+9], ' '))) AS g
  FROM item_words WHERE len(w) > 0),
doc_words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
places AS (
  SELECT doc_id, size, i, array_to_string(w[i:i+size-1], ' ') AS g
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
        FROM doc_words, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)),
found AS (SELECT doc_id, item_id, i, size FROM places JOIN windows USING (size, g)),
hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    listed = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("op6_jump_sharding")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(_table(spark, sf_dir, "documents"), 8).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@query("op4_line_dedup", r"""
WITH
lines AS (
  SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
kept AS (
  SELECT doc_id, l, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k
  FROM (SELECT doc_id, unnest(l) AS l, unnest(range(0, len(l))) AS i FROM lines)
  WHERE regexp_matches(l, '[^\t\n\v\f\r ]')),
windows AS (
  SELECT doc_id, i AS a, lead(i, 2) OVER w AS z,
    l || chr(10) || lead(l) OVER w || chr(10) || lead(l, 2) OVER w AS g
  FROM kept WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
marked AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, a) AS seen FROM windows WHERE g IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, unnest(range(a, z + 1)) AS i FROM marked WHERE seen > 1)
SELECT doc_id, n_lines::BIGINT AS n_lines, (n_lines - count(i))::BIGINT AS n_removed,
  coalesce(string_agg(x, chr(10) ORDER BY i), '') AS text
FROM (
  SELECT o.doc_id, o.n_lines, k.i, k.l AS x
  FROM (SELECT doc_id, len(l) AS n_lines FROM lines) o
  LEFT JOIN (
    SELECT doc_id, unnest(l) AS l, unnest(range(0, len(l))) AS i FROM lines) k ON k.doc_id = o.doc_id
    AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = k.doc_id AND g.i = k.i))
GROUP BY doc_id, n_lines
""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(_table(spark, sf_dir, "documents"))


@query("op10_mixture", r"""
WITH
docs AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5('1:' || doc_id::VARCHAR) AS k FROM documents),
limits AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
    [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source)),
levels AS (
  SELECT *, cap / w AS r, row_number() OVER o AS n,
    (1.5::DOUBLE * (SELECT sum(source_size)::BIGINT FROM limits)
      - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
      / (sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM limits WINDOW o AS (ORDER BY cap / w, source NULLS LAST)),
free AS (SELECT min(n) AS n FROM levels WHERE r > level),
targets AS (
  SELECT l.source, l.source_size,
    CASE WHEN l.n >= free.n THEN (SELECT level FROM levels x WHERE x.n = free.n) * l.w ELSE cap END AS target
  FROM levels l, free),
passes AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM targets),
placed AS (
  SELECT doc_id, source, size, sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, text
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT - size AS start FROM docs)
SELECT doc_id, size, source_size, target,
  size * (whole + CASE WHEN start < target - whole * source_size
    AND start + size / 2.0::DOUBLE <= target - whole * source_size THEN 1 ELSE 0 END) AS taken
FROM placed JOIN passes ON placed.source IS NOT DISTINCT FROM passes.source
""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draws(_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.size("shards") * F.col("size")).alias("taken"))


def remainder(id_col: str, n: int):
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")), F.lit(n))


@query("op7_lm_scoring")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(_table(spark, sf_dir, "documents"), remainder("doc_id", 7) == 2)


@query("op9_document_fingerprints")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(_table(spark, sf_dir, "documents"))


@query("op2_warc_index", r"""
WITH pages_ AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
digits AS (
  SELECT page_id, payload, array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + ((('0x' || substr(hex, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))::INTEGER) & 31)::INTEGER, 1)), '')
    AS digest
  FROM pages_),
firsts AS (SELECT payload, min(page_id) AS first FROM digits GROUP BY payload)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM digits JOIN firsts USING (payload)
""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The table has no times: a page's time is its id in seconds from a fixed day.
    captured = F.timestamp_seconds(F.lit(1577836800) + F.coalesce("page_id", F.lit(0)))
    return archive_and_index(_table(spark, sf_dir, "pages"), captured).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    weights = toxicity.train(docs, _table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score(docs, weights, ["doc_id"]).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op3_suffix_array_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_table(spark, sf_dir, "documents"))


def _vector_sql(rounds: int) -> str:
    """Codebooks by rounds of assignment and floored means, in whole numbers."""
    nearest = """
assigned{r} AS (
  SELECT id, part, place, min(d * 64 + entry) AS best FROM (
    SELECT x.id, x.part, any_value(x.w) AS place, b.entry, sum((x.v - b.v) * (x.v - b.v))::BIGINT AS d
    FROM cells x JOIN book{r} b ON x.part = b.part AND x.w = b.w GROUP BY x.id, x.part, b.entry)
  GROUP BY id, part, place),
"""
    move = """
book{n} AS (
  SELECT b.part, b.entry, b.w, coalesce(m.v, b.v) AS v
  FROM book{r} b LEFT JOIN (
    SELECT x.part, a.best % 64 AS entry, x.w, floor(sum(x.v)::DOUBLE / count(*))::BIGINT AS v
    FROM cells x JOIN assigned{r} a USING (id, part) GROUP BY ALL) m
  ON m.part = b.part AND m.entry = b.entry AND m.w = b.w),
"""
    steps = "".join(nearest.format(r=r) + move.format(r=r, n=r + 1) for r in range(rounds)) + nearest.format(r=rounds)
    return f"""
WITH
kept AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS id, vec_id, label, embedding AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cells AS (
  SELECT id, i // (n // 16) AS part, i % (n // 16) AS w, floor(256 * e[i + 1]::DOUBLE)::BIGINT AS v
  FROM (SELECT id, e, len(e) AS n, unnest(range(0, len(e))) AS i FROM kept)),
book0 AS (SELECT part, id AS entry, w, v FROM cells WHERE id < 64),
{steps}
codes AS (
  SELECT id, string_agg(printf('%02x', best % 64), '' ORDER BY part) AS code, sum(best // 64)::BIGINT AS error
  FROM assigned{rounds} GROUP BY id),
books AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, w)) AS digest FROM book{rounds})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, digest AS codebooks_sha256
FROM codes JOIN kept USING (id), books
"""


@query("op11_vector_codes", _vector_sql(2))
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(_table(spark, sf_dir, "embeddings"))
    numbers = F.lit(books.whole_numbers() if books else "")
    return coded.select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error",
        F.sha2(numbers, 256).alias("codebooks_sha256"))


@query("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    words = F.filter(F.split(F.col("text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    # One document in ten is made periodic from a word on.
    turned = F.expr(
        "transform(w, (x, i) -> CASE WHEN i >= a THEN w[cast(a + (i - a) % p as int)] ELSE x END)")
    docs = (
        _table(spark, sf_dir, "documents").select("doc_id", "text", h.alias("h"))
        .withColumn("w", F.when(F.col("h") % 10 == 0, words))
        .withColumn("n", F.size("w")).withColumn("g", F.floor(F.col("h") / 10))
        .withColumn("a", F.when(F.col("n") > 0, F.expr("g % n")))
        .withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
        .withColumn("text", F.when(F.col("a").isNull(), F.col("text")).otherwise(F.array_join(turned, " ")))
    )
    # Exponents are compared exactly: length * other period against other length * period.
    best = F.expr(
        "array_sort(runs, (x, y) -> CASE WHEN x.length * y.period <> y.length * x.period"
        " THEN CASE WHEN x.length * y.period > y.length * x.period THEN -1 ELSE 1 END"
        " WHEN x.start <> y.start THEN CASE WHEN x.start < y.start THEN -1 ELSE 1 END"
        " WHEN x.period < y.period THEN -1 WHEN x.period > y.period THEN 1 ELSE 0 END)[0]")
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return periodic_runs(docs).withColumn("best", F.when(F.size("runs") > 0, best)).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))


@query("op13_byte_bpe")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    encoded = byte_bpe.encode(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN).withColumn(
        "ids_sha256", F.sha2("ids", 256))
    return byte_bpe.decode(encoded, ranks, ["doc_id", "n_tokens", "ids_sha256"]).select(
        "doc_id", "n_tokens", "ids_sha256", F.sha2("bytes", 256).alias("decoded_sha256"))
