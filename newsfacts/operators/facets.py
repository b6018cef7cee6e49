"""Counts over the fact read model (grain: fact x location x analysis)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FACETS = ["category", "unit", "source_common_name", "term", "iso3", "specific_reported_figure"]


def facet_counts(facts: DataFrame, facets: list[str] = FACETS) -> DataFrame:
    """Rows per value of each facet, NULL values included, as (count, value, filter_type).

    One scan: grouping sets, one per facet. ``grouping`` tells a NULL value from a column that
    the set does not group by.
    """
    columns = [F.col(c) for c in facets]
    counted = facts.groupingSets([[c] for c in columns], *columns).agg(
        F.count(F.lit(1)).alias("count"),
        *[F.grouping(c).alias(f"_{c}") for c in facets],
    )
    kind = F.coalesce(*[F.when(F.col(f"_{c}") == 0, F.lit(c)) for c in facets])
    value = F.coalesce(*[F.when(F.col(f"_{c}") == 0, F.col(c).cast("string")) for c in facets])
    return counted.select("count", value.alias("value"), kind.alias("filter_type"))


def facet_union(facts: DataFrame, facets: list[str] = FACETS) -> DataFrame:
    """The same rows, one aggregation per facet concatenated. Reads the facts once per facet."""
    parts = [
        facts.groupBy(F.col(c).cast("string").alias("value"))
        .agg(F.count(F.lit(1)).alias("count"))
        .select("count", "value", F.lit(c).alias("filter_type"))
        for c in facets
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union


def counts_by(facts: DataFrame, *columns: str, ordered: bool = True) -> DataFrame:
    counted = facts.groupBy(*columns).agg(F.count(F.lit(1)).alias("count"))
    return counted.orderBy(*columns) if ordered else counted


def timeline_counts(facts: DataFrame) -> DataFrame:
    return counts_by(facts, "gdelt_day", "category")


def histogram_counts(facts: DataFrame) -> DataFrame:
    return counts_by(facts, "unit", "specific_reported_figure")


def fact_count(facts: DataFrame) -> DataFrame:
    return facts.agg(F.count_distinct("fact").alias("n"))


def group_count(facts: DataFrame) -> DataFrame:
    """Distinct groups, NULL equal to NULL; a multi-column count_distinct would skip NULLs."""
    groups = facts.select("specific_reported_figure", "location_ids_num", "term", "unit").distinct()
    return groups.agg(F.count(F.lit(1)).alias("n"))


def status_counts(analyses: DataFrame) -> DataFrame:
    return analyses.groupBy("status").agg(F.count(F.lit(1)).alias("count"))


def category_counts(analyses: DataFrame) -> DataFrame:
    """Relevant articles by category plus one row for irrelevant ones; unknown relevance in neither."""
    bucket = F.when(F.col("relevance"), F.col("category")).otherwise(F.lit("Not Relevant"))
    return (
        analyses.filter(F.col("relevance").isNotNull())
        .groupBy(bucket.alias("category"))
        .agg(F.count(F.lit(1)).alias("count"))
    )


def wordcloud(
    facts: DataFrame,
    contents: DataFrame,
    sample: int = 1000,
    top: int = 100,
    seed: str = "",
) -> DataFrame:
    """Most frequent words over a repeatable random sample of the matching contents."""
    ids = random_sample(facts.select("content_id"), "content_id", sample, seed)
    words = contents.join(ids, contents["id"] == ids["content_id"], "left_semi").select(
        "id", F.explode("content_terms").alias("word")
    )
    # Count within each document first: what is shuffled is one row per (word, document).
    per_doc = words.groupBy("word", "id").agg(F.count(F.lit(1)).alias("n"))
    return (
        per_doc.groupBy("word")
        .agg(F.sum("n").alias("nentry"), F.count(F.lit(1)).alias("ndoc"))
        .orderBy(F.desc("nentry"), F.desc("ndoc"), "word")
        .limit(top)
    )


def random_sample(ids: DataFrame, column: str, n: int = 1000, seed: str = "") -> DataFrame:
    """First ``n`` distinct ids in a pseudo-random order that a seed repeats."""
    order = F.md5(F.concat(F.lit(seed), F.col(column).cast("string")))
    return ids.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(order, column).limit(n)


def facts_per_article(analyses: DataFrame, analysis_facts: DataFrame) -> DataFrame:
    counted = analysis_facts.groupBy(F.col("analysis").alias("gkg_id")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return analyses.select("gkg_id").join(counted, "gkg_id", "left").select(
        "gkg_id", F.coalesce("n", F.lit(0)).alias("n_facts")
    )
