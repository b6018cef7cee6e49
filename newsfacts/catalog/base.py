"""Registration of queries, and the context they run in."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsfacts.catalog.prelude import PRELUDE
from newsfacts.operators.postings import TextIndex, write_index
from newsfacts.plans.marts import Marts, refresh_marts, write_content
from newsfacts.session import new_path
from newsfacts.sources.star import NewsTables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Context(NewsTables):
    """Tables plus the stored read model, built on first use in a session."""

    @cached_property
    def marts(self) -> Marts:
        return refresh_marts(self)

    @cached_property
    def stored_contents(self) -> DataFrame:
        return write_content(self.contents, new_path(self.spark, "contents"))

    @cached_property
    def text_index(self) -> TextIndex:
        return write_index(self.stored_contents, new_path(self.spark, "index"))


_CONTEXTS: dict[tuple[str, str], Context] = {}


def context(spark: SparkSession, sf_dir: str) -> Context:
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _CONTEXTS:
        _CONTEXTS[key] = Context(spark, sf_dir)
    return _CONTEXTS[key]


def portable(df: DataFrame) -> DataFrame:
    """Dates, timestamps and arrays as text, so that two engines compare equal by value."""
    out = []
    for f in df.schema.fields:
        col = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DateType):
            col = F.date_format(col, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            col = F.date_format(col, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, T.ArrayType) and not isinstance(
            f.dataType.elementType, (T.StructType, T.ArrayType)
        ):
            col = F.when(col.isNotNull(), F.array_join(col.cast("array<string>"), ",", "NULL"))
        out.append(col.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None, prelude: bool = True):
    """Register ``fn(context) -> DataFrame`` under ``name`` with its check, if SQL can express it."""

    def register(fn: Callable[[Context], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return portable(fn(context(spark, sf_dir)))

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = (PRELUDE + sql.strip()) if prelude else sql.strip()
        return fn

    return register
