"""Repair jobs over stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsfacts.functions import text as tx
from newsfacts.vocab import CLASSIFIED, EXTRACTED, UNKNOWN_ISO3


def canonical_ids(locations: DataFrame) -> DataFrame:
    """(id, canonical): the least id that carries the same name.

    Least ids come from an aggregate, not a window, so a name repeated very often is reduced
    before the shuffle.
    """
    least = locations.groupBy("location_name").agg(F.min("id").alias("canonical"))
    return locations.select("id", "location_name").join(least, "location_name").select("id", "canonical")


def canonical_locations(fact_locations: DataFrame, locations: DataFrame) -> DataFrame:
    """Fact-location pairs pointed at the canonical id of each place."""
    moved = canonical_ids(locations).filter("id <> canonical").withColumnRenamed("id", "location")
    return fact_locations.join(moved, "location", "left").select(
        "fact", F.coalesce("canonical", "location").alias("location")
    )


def unique_fact_locations(fact_locations: DataFrame) -> DataFrame:
    return fact_locations.dropDuplicates(["fact", "location"])


def repeated_pairs(fact_locations: DataFrame) -> DataFrame:
    """Pairs stored more than once, with the number of surplus rows."""
    return (
        fact_locations.groupBy("fact", "location")
        .agg((F.count(F.lit(1)) - 1).alias("surplus"))
        .filter("surplus > 0")
    )


def add_unknown_country(countries: DataFrame) -> DataFrame:
    extra = countries.sparkSession.createDataFrame(
        [(UNKNOWN_ISO3, "Unknown")], "iso3 string, preferred_term string"
    )
    return countries.select("iso3", "preferred_term").unionByName(extra).dropDuplicates(["iso3"])


def backfill_terms(contents: DataFrame) -> DataFrame:
    """Terms where they are missing and clean text is there."""
    fresh = F.when(
        F.col("content_clean").isNotNull(),
        tx.term_vector(tx.wordcloud_text(F.col("content_clean"))),
    )
    return contents.withColumn("content_terms", F.coalesce("content_terms", fresh))


def reset_extraction(
    analyses: DataFrame, analysis_facts: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Extracted articles go back to classified; their facts are dropped from the bridge."""
    back = F.when(F.col("status") == EXTRACTED, CLASSIFIED).otherwise(F.col("status"))
    cleared = analyses.filter(F.col("status") == EXTRACTED).select(F.col("gkg_id").alias("analysis"))
    return (
        analyses.withColumn("status", back),
        analysis_facts.join(cleared, "analysis", "left_anti"),
    )


def constraint_checks(
    fact_locations: DataFrame, locations: DataFrame, facts: DataFrame, countries: DataFrame
) -> DataFrame:
    """One row per violated rule and key: (rule, key, n)."""

    def rule(df: DataFrame, name: str, key: Column) -> DataFrame:
        return df.select(F.lit(name).alias("rule"), key.alias("key"), "n")

    one = F.count(F.lit(1)).alias("n")
    names = locations.groupBy("location_name").agg(one).filter("n > 1")
    pairs = fact_locations.groupBy("fact", "location").agg(one).filter("n > 1")
    no_place = fact_locations.join(
        locations.select(F.col("id").alias("location")), "location", "left_anti"
    ).groupBy("location").agg(one)
    no_fact = fact_locations.join(
        facts.select(F.col("id").alias("fact")), "fact", "left_anti"
    ).groupBy("fact").agg(one)
    no_country = locations.filter("country is not null").join(
        countries.select(F.col("iso3").alias("country")), "country", "left_anti"
    ).groupBy("country").agg(one)
    pair = F.concat_ws("/", F.col("fact").cast("string"), F.col("location").cast("string"))
    return (
        rule(names, "location name is unique", F.col("location_name"))
        .unionByName(rule(pairs, "fact and location are unique", pair))
        .unionByName(rule(no_place, "location exists", F.col("location").cast("string")))
        .unionByName(rule(no_fact, "fact exists", F.col("fact").cast("string")))
        .unionByName(rule(no_country, "country exists", F.col("country")))
    )
