"""Merging the tagged spans of all facts of an article."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tag_span_union(spans: DataFrame, key: str = "gkg_id", order: str = "seq") -> DataFrame:
    """(key, type, start, end, order) to disjoint spans: of equal starts the last by ``order`` wins,
    then spans that touch or overlap merge and their types join in order of start.

    Starts are offsets into one text, so after the first aggregation a key holds no more rows than
    its text has characters.
    """
    one = spans.groupBy(key, "start").agg(F.max_by(F.struct("type", "end"), order).alias("s")).select(
        key, "start", F.col("s.type").alias("type"), F.col("s.end").alias("end")
    )
    by_start = Window.partitionBy(key).orderBy("start")
    before = by_start.rowsBetween(Window.unboundedPreceding, -1)
    starts_new = F.coalesce((F.col("start") > F.max("end").over(before)).cast("int"), F.lit(1))
    islands = one.withColumn("_new", starts_new).withColumn("_island", F.sum("_new").over(by_start))
    types = F.array_sort(F.collect_list(F.struct("start", "type")))
    return islands.groupBy(key, "_island").agg(
        F.array_join(F.transform(types, lambda t: t["type"]), ", ").alias("type"),
        F.min("start").alias("start"),
        F.max("end").alias("end"),
    ).drop("_island")
