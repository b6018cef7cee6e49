"""Jump consistent hashing of stable keys to shards, in DataFrame functions only.

A key jumps ahead from shard to shard: from shard b the next place it would move to, as shards are
appended, is floor((b + 1) / u) for the key's next pseudo-random u in (0, 1]. The last place below the
number of shards is its shard. No ring or table is kept, and one more shard takes 1 / (n + 1) of the keys
and moves no others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The generator is the 64-bit linear congruential one of the published algorithm.
_HIGH, _LOW = 0x27BB2EE6, 0x87B0B0FD
_MASK = 0xFFFFFFFF
JUMPS = 128  # far more than any key needs (about ln n + 1); a key that needs more stops the job
BLOCKS = 4096  # ranges of keys that slots are counted in


def _low32(a: Column, b: int) -> Column:
    """Low 32 bits of a 32-bit value times a 32-bit constant, without leaving 64 bits."""
    upper = F.shiftleft(F.shiftright(a, 16) * F.lit(b).bitwiseAND(0xFFFF), 16)
    return (a.bitwiseAND(0xFFFF) * b + upper).bitwiseAND(_MASK)


def _next(hi: Column, lo: Column) -> tuple[Column, Column]:
    """State times the multiplier plus one, modulo 2**64, as two halves."""
    t0 = lo.bitwiseAND(0xFFFF) * _LOW + 1
    t1 = F.shiftright(lo, 16) * _LOW + F.shiftright(t0, 16)
    low = F.shiftleft(t1.bitwiseAND(0xFFFF), 16).bitwiseOR(t0.bitwiseAND(0xFFFF))
    high = (F.shiftright(t1, 16) + _low32(lo, _HIGH) + _low32(hi, _LOW)).bitwiseAND(_MASK)
    return high, low


def jump_hash(key: Column, shards: int) -> Column:
    """Shard 0 to ``shards - 1`` of a key of any type.

    The state starts from the first 64 bits of the MD5 of the key as text; a null key counts as the text
    ``null``.
    """
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("null")))

    def half(at: int) -> Column:
        return F.conv(F.substring(digest, at, 8), 16, 10).cast("long")

    def step(s: Column, _: Column) -> Column:
        hi, lo = _next(s["hi"], s["lo"])
        jump = F.floor((s["j"] + 1).cast("double") * (float(1 << 31) / (F.shiftright(hi, 1) + 1).cast("double")))
        on = s["j"] < shards
        return F.struct(
            F.when(on, s["j"]).otherwise(s["b"]).alias("b"), F.when(on, jump).otherwise(s["j"]).alias("j"),
            F.when(on, hi).otherwise(s["hi"]).alias("hi"), F.when(on, lo).otherwise(s["lo"]).alias("lo"))

    steps = min(shards, JUMPS)
    start = F.struct(F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"),
                     half(1).alias("hi"), half(9).alias("lo"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)), start, step,
        lambda s: F.when(s["j"] >= shards, s["b"]).otherwise(
            F.raise_error(F.lit("a key needs more jumps than allowed")).cast("long"))).cast("int")


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with size, text_crc32, law, shard, slot and grown_shard (replacing columns of these names).

    The law is ``key``: the id and the number of shards decide. ``size`` is the text's UTF-8 bytes plus 1
    (null: 1), ``text_crc32`` the CRC of those bytes (null: 0), ``grown_shard`` the shard with one more.
    ``slot`` numbers each shard's rows from 0 without gaps, ordered by id within ranges of hashed ids; rows
    of equal ids by text, other ties are between equal rows. All null ids go to one shard. An empty
    table gives no rows.

    Slots need no global window: rows are counted in 4096 hashed ranges times shards, and the small table
    of those counts gives each range its first slot. Every window sees one range of one shard only.
    """
    rows = docs.drop(*[c for c in docs.columns if c.lower() in (
        "size", "text_crc32", "law", "shard", "slot", "grown_shard", "_block", "_first")])
    marked = rows.withColumns({
        "size": F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1,
        "text_crc32": F.coalesce(F.crc32(F.encode(F.col(text_col), "UTF-8")), F.lit(0)).cast("long"),
        "law": F.lit("key"),
        "shard": jump_hash(F.col(id_col), shards),
        "_block": F.pmod(F.xxhash64(F.col(id_col)), F.lit(BLOCKS)),
    })
    counts = (
        rows.select(jump_hash(F.col(id_col), shards).alias("shard"),
                    F.pmod(F.xxhash64(F.col(id_col)), F.lit(BLOCKS)).alias("_block"))
        .groupBy("shard", "_block").agg(F.count(F.lit(1)).alias("_n"))
    )
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("shard", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy("shard", "_block").orderBy(
        id_col, "text_crc32", "size", F.xxhash64(text_col))
    # At most BLOCKS rows per shard, whatever the size of the input.
    return (
        marked.withColumn("slot", F.row_number().over(within).cast("long") - 1)
        .join(F.broadcast(firsts), ["shard", "_block"])
        .withColumn("slot", F.col("slot") + F.col("_first"))
        .withColumn("grown_shard", jump_hash(F.col(id_col), shards + 1))
        .select(*rows.columns, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    )
