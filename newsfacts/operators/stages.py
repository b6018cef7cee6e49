"""Status-driven processing in whole batches.

A stage picks rows by a predicate on the analyses table, works on all of them in one job and writes
a new snapshot; parallelism comes from partitions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsfacts.operators.keys import scan_within_keys


@dataclass
class Stage:
    """``select`` is a predicate over analyses. ``function`` takes the selected rows and returns
    them with a nullable ``error`` and, if it likes, changed columns and ``processing_time``."""

    select: Column
    working: str
    success: str
    failure: str
    function: Callable[[DataFrame], DataFrame]


def claim_batch(analyses: DataFrame, select: Column, working: str, now: Column) -> DataFrame:
    """All eligible rows take the working status; the others stay as they are."""
    eligible = F.coalesce(select, F.lit(False))
    return analyses.withColumn("updated", F.when(eligible, now).otherwise(F.col("updated"))).withColumn(
        "status", F.when(eligible, working).otherwise(F.col("status"))
    )


def claimed(analyses: DataFrame, select: Column, n: int) -> DataFrame:
    """The ``n`` eligible rows that waited longest."""
    return analyses.filter(select).orderBy("updated", "gkg_id").limit(n)


def run_stage(analyses: DataFrame, stage: Stage, now: Column) -> tuple[DataFrame, DataFrame]:
    """(analyses, history): the next snapshot, and the two versions each processed row had before."""
    eligible = F.coalesce(stage.select, F.lit(False))
    waiting = analyses.filter(eligible)
    working = waiting.withColumn("status", F.lit(stage.working)).withColumn("updated", now)
    done = stage.function(working)
    if "processing_time" not in done.columns:
        done = done.withColumn("processing_time", F.lit(None).cast("double"))
    done = done.withColumn(
        "status", F.when(F.col("error").isNull(), stage.success).otherwise(stage.failure)
    ).withColumn("error_msg", F.col("error"))
    columns = list(dict.fromkeys([*analyses.columns, "error_msg", "processing_time"]))
    rest = analyses.filter(~eligible)
    snapshot = rest.unionByName(done.drop("error"), allowMissingColumns=True).select(*columns)
    history = waiting.unionByName(working, allowMissingColumns=True)
    return snapshot, history


def advance_status(
    current: DataFrame, changes: DataFrame, now: Column
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(current, history, rejected) after ``changes`` (gkg_id, expected, new_status, requested).

    A change applies only if the row still has the expected status; of several that could, the
    earliest wins and the others are rejected.
    """
    row = F.struct("requested", "expected", "new_status")
    competing = changes.join(
        current.select("gkg_id", F.col("status").alias("_now")), "gkg_id", "left"
    )
    fits = F.col("expected") == F.col("_now")
    winners = competing.filter(fits).groupBy("gkg_id").agg(F.min(row).alias("w")).select("gkg_id", "w.*")
    applied = current.join(
        winners.select("gkg_id", F.col("new_status").alias("_new")), "gkg_id", "left"
    )
    changed = F.col("_new").isNotNull()
    next_ = applied.withColumn("updated", F.when(changed, now).otherwise(F.col("updated"))).withColumn(
        "status", F.coalesce("_new", "status")
    ).drop("_new")
    history = applied.filter(changed).drop("_new")
    rejected = changes.join(
        winners, ["gkg_id", "expected", "new_status", "requested"], "left_anti"
    )
    return next_, history, rejected


def append_history(
    history: DataFrame, previous: DataFrame, analysis_facts: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(history, history_facts): previous versions appended, each with the facts it had.

    A version's id is a hash of article, status and time, so no counter has to be shared.
    """
    versions = previous.withColumn("history_id", F.xxhash64("gkg_id", "status", "updated"))
    bridge = versions.select(F.col("gkg_id").alias("analysis"), "history_id").join(
        analysis_facts, "analysis"
    ).select(F.col("history_id").alias("analysis_history"), "fact")
    return history.unionByName(versions, allowMissingColumns=True), bridge


def version_sequence(history: DataFrame) -> DataFrame:
    """Versions of each article in order, beside the status before and the time of the next."""
    return scan_within_keys(
        history, ["gkg_id"], ["updated", "history_id"], number="version",
        lag={"previous_status": "status"}, lead={"next_updated": "updated"},
    )


def latest_version(history: DataFrame) -> DataFrame:
    rest = [c for c in history.columns if c != "gkg_id"]
    newest = F.max_by(F.struct(*rest), F.struct("updated", "history_id"))
    return history.groupBy("gkg_id").agg(newest.alias("v")).select("gkg_id", "v.*")


def stage_timing(analyses: DataFrame) -> DataFrame:
    return analyses.groupBy("status").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("processing_time").alias("avg_time"),
        F.max("processing_time").alias("max_time"),
        F.count_if(F.col("error_msg").isNotNull()).alias("failures"),
    )


def capture_errors(function: Callable, value_type: str):
    """A row function as a Pandas UDF that returns (value, error) and never fails the job."""
    schema = T.StructType([
        T.StructField("value", T._parse_datatype_string(value_type)),
        T.StructField("error", T.StringType()),
    ])

    def batch(values: pd.Series) -> pd.DataFrame:
        out, errors = [], []
        for v in values:
            try:
                out.append(function(v))
                errors.append(None)
            except Exception as e:  # the message becomes the row's outcome
                out.append(None)
                errors.append(str(e))
        return pd.DataFrame({"value": pd.Series(out, dtype=object), "error": pd.Series(errors, dtype=object)})

    batch.__annotations__ = {"values": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(batch, schema)
