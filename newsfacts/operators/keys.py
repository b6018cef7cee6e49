"""Ranks and ids in a global order, without a window over the whole table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsfacts.session import written

SHARE = 4 << 20  # characters of text for a task


def shares(df: DataFrame, text: str, share: int = SHARE) -> int:
    """How many tasks of about ``share`` characters of the column ``text`` the rows make, one at least."""
    return max(1, math.ceil((df.agg(F.sum(F.length(text))).first()[0] or 0) / share))


def dealt(df: DataFrame, n: int) -> DataFrame:
    """The same rows dealt over ``n`` tasks; with one, as they are.

    A row group of a Parquet file is read by one task, however large it is, and what is worked out from its rows before
    the next shuffle stays in that task. Rows that are equal in all columns come to the same task.
    """
    return df.repartition(n, *df.columns) if n > 1 else df


def rank_by_weight(df: DataFrame, order: list[str], weight: Column, out: str, store=written) -> DataFrame:
    """``out`` = 1 + total weight of all rows that sort before this one.

    Rows are range-partitioned on ``order`` (unique per row) and stored, so that partition bounds
    cannot move between the two passes. Each partition keeps a running sum; the driver sees one
    total per partition, never rows.
    """
    stored = store(
        df.withColumn("_w", weight)
        .repartitionByRange(*order)
        .withColumn("_part", F.spark_partition_id()),
        "ranked",
    )
    totals = stored.groupBy("_part").agg(F.sum("_w").alias("total")).collect()
    starts, seen = [], 0
    for row in sorted(totals, key=lambda r: r["_part"]):
        starts.append((row["_part"], seen))
        seen += row["total"]
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    offsets = df.sparkSession.createDataFrame(starts, "_part int, _start long")
    running = F.sum("_w").over(within) - F.col("_w") + F.col("_start") + 1
    # One offset per partition, so the table that is broadcast is always small.
    return (
        stored.join(F.broadcast(offsets), "_part")
        .withColumn(out, running.cast("long"))
        .drop("_w", "_part", "_start")
    )


def number_rows(df: DataFrame, order: list[str], out: str, first: Column | int = 1, store=written) -> DataFrame:
    """Consecutive ids in the order of the unique key ``order``."""
    start = first if isinstance(first, Column) else F.lit(first)
    return rank_by_weight(df, order, F.lit(1), out, store).withColumn(
        out, (F.col(out) - 1 + start).cast("long")
    )


def scan_within_keys(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    number: str | None = None,
    lag: dict[str, str] | None = None,
    lead: dict[str, str] | None = None,
    last_known: dict[str, str] | None = None,
) -> DataFrame:
    """Window functions per key that hold up when one key owns a large share of the rows.

    ``number`` names a row number, ``lag``/``lead`` map a new column to the column of the previous
    or next row, ``last_known`` to the latest non-NULL value of an earlier row. Rows are
    range-partitioned on (key, order), so a busy key spreads over many tasks. What crosses a
    partition border is one small row per partition, carried over on the driver.
    """
    lag, lead, last_known = lag or {}, lead or {}, last_known or {}
    stored = written(
        df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "scanned"
    )
    by = F.struct(*order)
    per_key = stored.groupBy("_part", *keys).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.max_by(F.struct(c), by).alias(f"_lag_{o}") for o, c in lag.items()],
        *[F.min_by(F.struct(c), by).alias(f"_lead_{o}") for o, c in lead.items()],
        *[
            F.max_by(F.when(F.col(c).isNotNull(), F.struct(c)),
                     F.when(F.col(c).isNotNull(), by)).alias(f"_known_{o}")
            for o, c in last_known.items()
        ],
    )
    everything = F.struct(*[F.col(c) for c in per_key.columns])
    edges = (
        per_key.groupBy("_part")
        .agg(
            F.min_by(everything, F.struct(*keys)).alias("first"),
            F.max_by(everything, F.struct(*keys)).alias("last"),
        )
        .orderBy("_part")
        .collect()
    )
    forward = [f"_lag_{o}" for o in lag] + [f"_known_{o}" for o in last_known]
    backward = [f"_lead_{o}" for o in lead]
    carries: dict[tuple, dict] = {}

    def key_of(row) -> tuple:
        return tuple(row[k] for k in keys)

    state: tuple | None = None
    for edge in edges:
        first, last = edge["first"], edge["last"]
        if state and state[0] == key_of(first):
            carries[(edge["_part"], *state[0])] = {"_n": state[1], **state[2]}
        same = state and state[0] == key_of(last)
        seen = state[1] if same else 0
        values = dict(state[2]) if same else {}
        for name in forward:
            if last[name] is not None:
                values[name] = last[name]
        state = (key_of(last), seen + last["_n"], values)
    state = None
    for edge in reversed(edges):
        first, last = edge["first"], edge["last"]
        if state and state[0] == key_of(last):
            carries.setdefault((edge["_part"], *state[0]), {}).update(state[1])
        state = (key_of(first), {name: first[name] for name in backward})

    names = ["_part", *keys, "_n", *forward, *backward]
    fields = {f.name: f for f in per_key.schema.fields}
    rows = [(*k, *[v.get(n) for n in names[len(keys) + 1:]]) for k, v in carries.items()]
    schema = T.StructType([T.StructField(n, fields[n].dataType, True) for n in names])
    carried = df.sparkSession.createDataFrame(rows, schema)  # at most one row per partition
    joined = stored.join(F.broadcast(carried), ["_part", *keys], "left")

    window = Window.partitionBy("_part", *keys).orderBy(*order)
    ahead = window.rowsBetween(Window.unboundedPreceding, -1)
    out = [F.col(c) for c in df.columns]
    if number:
        out.append(
            (F.row_number().over(window) + F.coalesce("_n", F.lit(0))).cast("long").alias(number)
        )
    for name, c in lag.items():
        within = F.lag(F.struct(c)).over(window)
        out.append(F.coalesce(within, F.col(f"_lag_{name}")).getField(c).alias(name))
    for name, c in lead.items():
        within = F.lead(F.struct(c)).over(window)
        out.append(F.coalesce(within, F.col(f"_lead_{name}")).getField(c).alias(name))
    for name, c in last_known.items():
        within = F.last(F.when(F.col(c).isNotNull(), F.struct(c)), ignorenulls=True).over(ahead)
        out.append(F.coalesce(within, F.col(f"_known_{name}")).getField(c).alias(name))
    return joined.select(*out)
