"""Stored steps of a job, and the release of what earlier steps left behind."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from newsfacts.session import new_path


def stored(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write a step to the shared folder, compressed by ``codec`` if given, and read it back.

    Shuffle files of steps that are over are only needed again if a stored table is lost. Spark removes
    them when the driver's garbage is collected, which may be long after; so collect it here.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path, **({"compression": codec} if codec else {}))
    out = spark.read.parquet(path)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out


@contextmanager
def small_batches(spark: SparkSession, size: int = 1 << 22) -> Iterator[None]:
    """Python tasks that start meanwhile get their rows in batches of about ``size`` bytes; a size set by the submitter wins.

    The executor holds a batch in buffers that grow by doubling, the Python worker holds it with what is made of it.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key in spark.conf.getAll:
        yield
        return
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.unset(key)


def bucketed(df: DataFrame, name: str, column: str, codec: str) -> DataFrame:
    """Write a step in buckets of ``column``, so that grouping by it later moves no rows, and read it back.

    There are as many buckets as the session has shuffle partitions. The table lies in the shared folder and is known to
    the session's catalog.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), column).option("path", path).option(
        "compression", codec).format("parquet").saveAsTable(table)
    return spark.table(table)


def aside(df: DataFrame, read: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """Columns that an operator does not read, under names that none uses; and how to rename them back."""
    back = {f"aside {i}": c for i, c in enumerate(df.columns) if c not in read}
    return df.withColumnsRenamed({c: name for name, c in back.items()}), back
