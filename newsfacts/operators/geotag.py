"""Resolving places to countries, kinds and coordinates by joins with lookup tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsfacts.functions import geo
from newsfacts.operators.keys import number_rows
from newsfacts.vocab import (
    COUNTRY, MULTIPLE_RESULTS, NO_RESULTS, SINGLE_RESULT, SUBDIVISION, UNKNOWN_ISO3,
)


def country_lookup(places: DataFrame, country_terms: DataFrame) -> DataFrame:
    """(place_name) to (place_name, iso3) by exact name; terms carry a priority, the least wins.

    Terms are reduced to one row per name first, so the join never multiplies rows.
    """
    terms = country_terms.groupBy(F.col("term").alias("place_name")).agg(
        F.min_by("country", F.struct("priority", "country")).alias("iso3")
    )
    return places.join(terms, "place_name")


def subdivision_lookup(places: DataFrame, subdivisions: DataFrame) -> DataFrame:
    """(place_name) to (place_name, iso3), regardless of accents and case."""
    names = subdivisions.groupBy(geo.fold_name(F.col("name")).alias("_fold")).agg(
        F.min("iso3").alias("iso3")
    )
    folded = places.withColumn("_fold", geo.fold_name(F.col("place_name")))
    return folded.join(names, "_fold").drop("_fold")


def place_country(
    places: DataFrame, country_terms: DataFrame, subdivisions: DataFrame
) -> DataFrame:
    """Each place with kind and country: a country first, else a subdivision, else neither."""
    as_country = country_lookup(places.select("place_name").distinct(), country_terms).select(
        "place_name", F.col("iso3").alias("_c")
    )
    as_part = subdivision_lookup(places.select("place_name").distinct(), subdivisions).select(
        "place_name", F.col("iso3").alias("_s")
    )
    return (
        places.join(as_country, "place_name", "left")
        .join(as_part, "place_name", "left")
        .select(
            *places.columns,
            F.when(F.col("_c").isNotNull(), COUNTRY)
            .when(F.col("_s").isNotNull(), SUBDIVISION)
            .alias("type"),
            F.coalesce("_c", "_s").alias("country_code"),
        )
    )


def iso2_to_iso3(df: DataFrame, codes: DataFrame, iso2: str, out: str) -> DataFrame:
    """``codes`` holds (iso2, iso3); a code it does not know becomes the unknown country."""
    lookup = codes.select(F.upper("iso2").alias("_iso2"), F.col("iso3").alias("_iso3"))
    return (
        df.withColumn("_iso2", F.upper(iso2))
        .join(lookup, "_iso2", "left")
        .withColumn(out, F.coalesce("_iso3", F.lit(UNKNOWN_ISO3)))
        .drop("_iso2", "_iso3")
    )


def best_geocode(candidates: DataFrame) -> DataFrame:
    """Per place, the candidate of highest importance and how many there were.

    Ties go to the least coordinates, so the result does not depend on row order.
    """
    pick = F.struct("lat", "lon", "iso2", "place_extratag", "type", "class")
    rank = F.struct((-F.col("importance")).alias("i"), "lat", "lon")
    return candidates.groupBy("place_name").agg(
        F.min_by(pick, rank).alias("b"), F.count(F.lit(1)).alias("n_candidates")
    ).select("place_name", "b.*", "n_candidates")


def geocode_flag(n):
    return (
        F.when(F.coalesce(n, F.lit(0)) == 0, NO_RESULTS)
        .when(n == 1, SINGLE_RESULT)
        .otherwise(MULTIPLE_RESULTS)
    )


def geo_info(
    places: DataFrame,
    country_terms: DataFrame,
    subdivisions: DataFrame,
    candidates: DataFrame,
    codes: DataFrame,
) -> DataFrame:
    """Kind, country, coordinates and flag per distinct place name.

    Where the name alone gives a country, only candidates of that country count and the kind found
    by name stands; elsewhere the best candidate decides.
    """
    named = place_country(places.select("place_name").distinct(), country_terms, subdivisions)
    coded = iso2_to_iso3(candidates, codes, "iso2", "candidate_iso3")
    usable = coded.join(
        named.select("place_name", F.col("country_code").alias("_want")), "place_name"
    ).filter(F.col("_want").isNull() | (F.col("_want") == F.col("candidate_iso3")))
    best = iso2_to_iso3(
        best_geocode(usable.drop("_want", "candidate_iso3")), codes, "iso2", "best_iso3"
    ).withColumnRenamed("type", "candidate_type")
    found = named.join(best, "place_name", "left")
    by_name = F.col("country_code").isNotNull()
    by_candidate = F.col("n_candidates").isNotNull()
    kind = geo.place_type(
        geo.best_place(F.col("place_extratag"), F.col("candidate_type"), F.col("class"))
    )
    return found.select(
        "place_name",
        F.when(by_name, F.col("type")).when(by_candidate, kind).otherwise("").alias("type"),
        F.when(by_name, F.col("country_code"))
        .when(by_candidate, F.col("best_iso3"))
        .otherwise(UNKNOWN_ISO3)
        .alias("country_code"),
        F.when(by_candidate, F.concat_ws(",", "lat", "lon")).otherwise("").alias("coordinates"),
        geocode_flag(F.col("n_candidates")).alias("flag"),
    )


def geotag_locations(locations: DataFrame, info: DataFrame) -> DataFrame:
    """Locations without a country take kind, country and coordinates from ``info``; the others
    are untouched."""
    new = info.select(
        F.col("place_name").alias("location_name"), F.col("type").alias("_type"),
        F.col("country_code").alias("_country"), F.col("coordinates").alias("_latlong"),
    )
    untagged = F.coalesce(F.col("country") == "", F.lit(True)) & F.col("_country").isNotNull()
    return locations.join(new, "location_name", "left").select(
        "id",
        "location_name",
        F.when(untagged, F.col("_type")).otherwise(F.col("location_type")).alias("location_type"),
        F.when(untagged, F.col("_country")).otherwise(F.col("country")).alias("country"),
        F.when(untagged, F.col("_latlong")).otherwise(F.col("latlong")).alias("latlong"),
    )


def split_fact_by_country(
    facts: DataFrame, fact_locations: DataFrame, locations: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """One fact per country: the first country keeps the fact's id, each other one gets a copy.

    Returns the facts (with ``source_fact``) and the fact-location pairs. Facts without a place
    keep their country; a place without a country counts as in the unknown one.
    """
    country = F.coalesce("country", F.lit(UNKNOWN_ISO3))
    placed = fact_locations.join(
        locations.select(F.col("id").alias("location"), country.alias("_iso3")), "location"
    )
    groups = placed.select("fact", "_iso3").distinct()
    first = groups.groupBy("fact").agg(F.min("_iso3").alias("_first"))
    extra = groups.join(first, "fact").filter("_iso3 <> _first").select("fact", "_iso3")
    highest = F.coalesce(facts.select(F.max("id")).scalar(), F.lit(0))
    copies = number_rows(extra, ["fact", "_iso3"], "_new", highest + 1)
    owners = (
        groups.join(copies, ["fact", "_iso3"], "left")
        .select("fact", "_iso3", F.coalesce("_new", "fact").alias("_owner"))
    )
    split = (
        facts.withColumnRenamed("id", "source_fact")
        .join(owners.withColumnRenamed("fact", "source_fact"), "source_fact", "left")
        .withColumn("iso3", F.coalesce("_iso3", "iso3"))
        .withColumn("id", F.coalesce("_owner", "source_fact"))
        .drop("_iso3", "_owner")
    )
    pairs = placed.join(owners, ["fact", "_iso3"]).select(F.col("_owner").alias("fact"), "location")
    return split, pairs


def split_article_bridge(split: DataFrame, analysis_facts: DataFrame) -> DataFrame:
    """(analysis, fact) for the facts of :func:`split_fact_by_country`: a copy belongs to its source's articles."""
    owners = split.select(F.col("id").alias("_copy"), F.col("source_fact").alias("fact"))
    return analysis_facts.join(owners, "fact").select("analysis", F.col("_copy").alias("fact"))


def assign_fact_iso3(facts: DataFrame, fact_locations: DataFrame, locations: DataFrame) -> DataFrame:
    """The country of facts whose places all lie in one country."""
    countries = (
        fact_locations.join(
            locations.select(F.col("id").alias("location"), F.col("country").alias("_iso3")), "location"
        )
        .groupBy("fact")
        .agg(F.min("_iso3").alias("_low"), F.max("_iso3").alias("_high"))
        .filter("_low = _high")
        .select(F.col("fact").alias("id"), "_low")
    )
    return facts.join(countries, "id", "left").withColumn("iso3", F.coalesce("_low", "iso3")).drop("_low")
