"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents are permuted by a seeded hash and cut into blocks of the permutation. A source
gives whole passes over its blocks and a part of one more, up to its target in words. How many drawn blocks
of each source go to each output shard is decided top-down: a node's blocks are split over its two halves
by one draw of a multivariate hypergeometric distribution, so that every shard gets its exact share of
blocks and a composition as if drawn without replacement. Shards then take disjoint runs of each source's
permuted blocks, and shuffle locally by a second hash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsfacts.llm.store import aside

WEIGHTS = (5, 2, 1)
BLOCKS = 4096  # per source: the first three hexadecimal digits of the permuting hash


def words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple = WEIGHTS) -> DataFrame:
    """(source, source_size, target) of a table (source, source_size) with one row per source.

    All targets together are ``share`` of all sizes, in proportion to the weights, which repeat in the order
    of the sources by code point with null last. A target stops at ``most`` times its source's size and
    the excess is shared anew. Solved at once: with sources sorted by limit over weight, those before
    the first that stays below its limit are at it, and the rest share what is left.

    The windows run over one row per source, not over documents.
    """
    cycle = F.array(*[F.lit(w) for w in weights])
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    limits = (
        sizes.withColumn("w", F.element_at(cycle, (rank % len(weights) + 1).cast("int")))
        .withColumn("cap", F.lit(most) * F.col("source_size"))
        .withColumn("r", F.col("cap") / F.col("w"))
    )
    everything = Window.partitionBy()
    order = Window.orderBy("r", F.col("source").asc_nulls_last())
    below = order.rowsBetween(Window.unboundedPreceding, -1)
    above = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (
        F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(below), F.lit(0.0))
    ) / F.sum("w").over(above)
    found = limits.withColumn("n", F.row_number().over(order)).withColumn("level", level).withColumn(
        "free", F.min(F.when(F.col("r") > F.col("level"), F.struct("n", "level"))).over(everything))
    return found.select(
        "source", "source_size",
        F.when(F.col("n") >= F.col("free.n"), F.col("free.level") * F.col("w")).otherwise(F.col("cap")).alias("target"))


def split_blocks(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """Blocks of each source (rows) for each shard (columns), by recursive halving."""
    out = np.zeros((len(counts), shards), np.int64)

    def split(have: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[:, lo] = have
            return
        mid = (lo + hi) // 2
        share = int(have.sum()) * (mid - lo) // (hi - lo)
        rng = np.random.default_rng([seed, lo, hi])
        left = rng.multivariate_hypergeometric(have, share, method="marginals")
        split(left, lo, mid)
        split(have - left, mid, hi)

    if len(counts):
        split(np.array(counts, np.int64), 0, shards)
    return out


def draws(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple = WEIGHTS, shards: int = 8,
          seed: int = 1, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``docs`` with size, source_size, target and ``shards``: the output shard of each copy that is taken.

    A document is taken as often as whole passes and the last part say, at most ``most`` times rounded up
    to its source's part. Its source's words come within half a document of the target. A null source is
    a source of its own; null and blank texts have no words and are taken along without changing
    the count; null ids are permuted as the text ``null``. Ties in the permutation go by id and
    text, so reruns agree. Repeated rows are drawn each on its own. An empty table gives no rows. Input columns
    named like the added ones are replaced.

    The driver sees one row per source (its number of drawn blocks) to split them; windows over documents
    see one block of one source.
    """
    spark = docs.sparkSession
    added = ("size", "source_size", "target", "shards")
    kept, back = aside(docs.drop(*[c for c in docs.columns if c.lower() in added]), [id_col, source_col, text_col])
    none = [F.col(source_col).isNull().alias("_none"), F.coalesce(F.col(source_col), F.lit("")).alias("_source")]
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    rows = kept.select("*", *none, words(F.col(text_col)).alias("size"), key.alias("_key")).withColumn(
        "_block", F.substring("_key", 1, 3))
    by = ["_none", "_source"]

    blocks = rows.groupBy(*by, "_block").agg(F.sum("size").alias("words"))
    sizes = blocks.groupBy(*by).agg(F.sum("words").alias("source_size")).select(
        F.when(~F.col("_none"), F.col("_source")).alias("source"), "source_size")
    wanted = targets(sizes, share, most, weights).select(
        F.col("source").isNull().alias("_none"), F.coalesce("source", F.lit("")).alias("_source"), "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).alias("full"),
    ).withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0))).join(wanted, by)

    passes = F.col("full") + F.when(F.col("before") < F.col("rest"), 1).otherwise(0)
    units = blocks.withColumn("n", passes).filter("n > 0").select(
        *by, "_block", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"))
    quotas = units.groupBy(*by).count().orderBy(*by).collect()
    tree = np.cumsum(split_blocks([q["count"] for q in quotas], shards, seed), axis=1)
    ends = spark.createDataFrame(
        [(q["_none"], q["_source"], [int(x) for x in t]) for q, t in zip(quotas, tree)],
        "_none boolean, _source string, ends array<long>")
    place = F.row_number().over(Window.partitionBy(*by).orderBy("copy", "_block"))
    dealt = (
        units.withColumn("place", place).join(ends, by)
        .withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("place"))))
        .groupBy(*by, "_block").agg(
            F.transform(F.sort_array(F.collect_list(F.struct("copy", "shard"))), lambda u: u["shard"]).alias("dealt"))
    )
    plan = blocks.select(*by, "_block", "before", "source_size", "target", "full", "rest").join(
        dealt, [*by, "_block"], "left")

    within = Window.partitionBy(*by, "_block").orderBy("_key", id_col, F.xxhash64(text_col))
    start = F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    last = (F.col("start") < F.col("rest")) & (F.col("start") + F.col("size") / F.lit(2.0) <= F.col("rest"))
    taken = F.col("full").cast("int") + F.when(last, 1).otherwise(0)
    return (
        rows.withColumn("start", start).join(plan, [*by, "_block"])
        .withColumn("start", F.col("start") + F.col("before"))
        .select(*kept.columns, "size", "source_size", "target",
                F.when(taken > 0, F.slice("dealt", F.lit(1), taken)).otherwise(
                    F.array().cast("array<int>")).alias("shards"))
        .withColumnsRenamed(back)
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: ``docs`` with one row per taken copy, ``copy`` from 1, ``mix_shard`` and ``mix_key``.

    Input columns of these names, or of those that ``draws`` adds, are replaced. Options and cases as for ``draws``. Ordering a shard's rows by ``mix_key`` is its local shuffle.
    """
    seed, id_col = options.get("seed", 1), options.get("id_col", "doc_id")
    added = ("size", "source_size", "target", "shards", "copy", "mix_shard", "mix_key")
    columns = [c for c in docs.columns if c.lower() not in added]
    return draws(docs, **options).select(*columns, F.posexplode("shards").alias("copy", "mix_shard")).withColumn(
        "copy", F.col("copy") + 1).withColumn(
        "mix_key", F.xxhash64(F.lit(seed), F.col(id_col), F.col("copy")))
