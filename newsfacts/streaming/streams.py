"""Streaming forms: articles that arrive as files, and running counts with a watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from newsfacts.session import new_path
from newsfacts.sources.manifests import children
from newsfacts.sources.writers import initiate


def read_table_stream(spark: SparkSession, folder: str, name: str = "*.parquet") -> DataFrame:
    """New Parquet files of a folder as a stream; the schema is that of the files already there."""
    schema = spark.read.option("pathGlobFilter", name).parquet(folder).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def utc_instant(df: DataFrame, time: str) -> DataFrame:
    """A wall-clock column as the instant that shows it in UTC, so that windows do not depend on
    the session's zone. Watermarks need an instant."""
    if not isinstance(df.schema[time].dataType, T.TimestampNTZType):
        return df
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(time))
    return df.withColumn(time, F.timestamp_micros(micros))


def _utc_day(instant) -> Column:
    return F.date_from_unix_date(F.floor(F.unix_seconds(instant) / 86400).cast("int"))


def daily_counts_stream(
    events: DataFrame, time: str, kind: str, delay: str = "1 day"
) -> DataFrame:
    """Rows per day and kind; a day is final once the watermark has passed its end.

    :func:`run_available` gives final days only, :func:`run_updating` those still open too.
    """
    return (
        utc_instant(events, time)
        .withWatermark(time, delay)
        .groupBy(F.window(time, "1 day"), F.col(kind))
        .agg(F.count(F.lit(1)).alias("count"))
        .select(_utc_day(F.col("window.start")).alias("day"), kind, "count")
    )


def weekly_counts_stream(
    events: DataFrame, time: str, kind: str, delay: str = "1 day"
) -> DataFrame:
    """Rows per week from Monday; windows count from a Thursday, hence the offset."""
    return (
        utc_instant(events, time)
        .withWatermark(time, delay)
        .groupBy(F.window(time, "1 week", "1 week", "4 days"), F.col(kind))
        .agg(F.count(F.lit(1)).alias("count"))
        .select(_utc_day(F.col("window.start")).alias("week"), kind, "count")
    )


def run_available(counts: DataFrame, name: str) -> DataFrame:
    """Process all input there is, then stop; returns what the sink holds."""
    spark = counts.sparkSession
    sink = new_path(spark, name)
    (
        counts.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", new_path(spark, f"{name}-state"))
        .trigger(availableNow=True)
        .start(sink)
        .awaitTermination()
    )
    return spark.read.schema(counts.schema).parquet(sink)


def run_updating(counts: DataFrame, name: str, keys: list[str], sink: str | None = None) -> DataFrame:
    """Process all input there is, then stop; returns the latest row of each key, windows still open included.

    A micro-batch stores the rows that it changed under its number and overwrites them on a retry, so a batch that
    is run twice counts once. Given the ``sink`` of an earlier run, this one goes on from its state.
    """
    spark = counts.sparkSession
    sink = sink or new_path(spark, name)

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/rows/batch={number}")

    (
        counts.writeStream.outputMode("update").foreachBatch(each)
        .option("checkpointLocation", f"{sink}/state")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return latest_rows(spark, sink, counts.schema, keys)


def latest_rows(spark: SparkSession, sink: str, schema: T.StructType, keys: list[str]) -> DataFrame:
    """The sink of :func:`run_updating` as a table: per key the row of its last batch."""
    if not children(spark, f"{sink}/rows"):
        return spark.createDataFrame([], schema)
    values = [c for c in schema.names if c not in keys]
    stored = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(
        f"{sink}/rows")
    latest = stored.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("last"))
    return latest.select(*keys, "last.*").select(*schema.names)


def initiate_stream(
    articles: DataFrame, analyses_path: str, state_path: str, now, interval: str | None = None
) -> StreamingQuery:
    """Each micro-batch of articles gets NEW analyses for those that have none.

    The batch number names the output folder and is overwritten on a retry, so a repeated batch
    leaves no second copy. With ``interval`` the query keeps polling; without, it drains and stops.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        stored = spark.read.parquet(analyses_path)
        earlier = stored.filter(F.col("batch") != number)
        new = initiate(batch.dropDuplicates(["id"]), earlier, now).select("gkg_id", "status", "updated")
        new.write.mode("overwrite").parquet(f"{analyses_path}/batch={number}")

    writer = articles.writeStream.foreachBatch(each).option("checkpointLocation", state_path)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()
