"""Listings: paged facts, grouped facts, documents and their facts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsfacts.session import written

URL_LIST_COLUMNS = [
    "document_identifier", "fact", "gdelt_day", "iso3", "source_common_name",
    "specific_reported_figure", "term", "unit", "vague_reported_figure", "category", "gkg_id",
    "content_id",
]


def first_per_fact(facts: DataFrame, columns: list[str] = URL_LIST_COLUMNS) -> DataFrame:
    """The earliest row of each fact, by (day, article, place).

    An aggregate rather than a window: each task reduces its rows before the shuffle, so a fact
    with very many rows costs no more than any other.
    """
    first = F.min_by(F.struct(*columns), F.struct("gdelt_day", "gkg_id", "location"))
    return facts.groupBy("fact").agg(first.alias("r")).select("r.*")


def fact_review(facts: DataFrame, validation: DataFrame, values: DataFrame, key: str = "id") -> DataFrame:
    """Facts with their review status and its display colour, where there is one."""
    reviews = validation.select(
        F.col("fact_id").alias(key), F.col("status"), "missing", "wrong", "assigned_to"
    )
    colours = values.select(F.col("key_value").alias("status"), "display_color")
    return facts.join(reviews, key, "left").join(colours, "status", "left")


def url_list(
    filtered: DataFrame,
    fact_sets: DataFrame,
    analyses: DataFrame,
    contents: DataFrame,
    validation: DataFrame,
    values: DataFrame,
    limit: int = 32,
    offset: int = 0,
    details: DataFrame | None = None,
    refilter: Callable[[Callable[[DataFrame], DataFrame]], DataFrame] | None = None,
) -> DataFrame:
    """One page of facts with article, content and review columns.

    All columns of ``analyses`` (title, authors, ...) are listed, and with ``details`` (id, ...) those of the fact's
    own row, such as its excerpt and tags. A fact without a stored content is not listed, so keys are semi-joined
    first. The page is cut on bare fact ids, and stored: of every other table only the rows that it needs are read on,
    so none of them is shuffled, whatever its size. ``refilter`` makes ``filtered`` once more, given what reduces the
    facts to the page, so that a filter that joins is run on the page's facts alone.
    """
    stored = contents.select(F.col("id").alias("content_id"))
    facts = filtered.join(stored, "content_id", "left_semi").select("fact").distinct()
    ids = written(
        facts.join(fact_sets.select("fact"), "fact", "left_semi").orderBy("fact").offset(offset).limit(limit), "page-ids")

    def among(df: DataFrame, listed: DataFrame, by: str, key: str) -> DataFrame:
        # No more keys than the page has rows.
        return df.join(F.broadcast(listed.select(F.col(by).alias(key)).distinct()), key, "left_semi")

    def few(df: DataFrame) -> DataFrame:
        return among(df, ids, "fact", "fact")

    rows = (refilter(few) if refilter else few(filtered)).join(stored, "content_id", "left_semi")
    page = written(first_per_fact(rows), "page")
    listed = page
    if details is not None:
        listed = listed.join(among(details, ids, "fact", "id").withColumnRenamed("id", "fact"), "fact")
    texts = among(contents, page, "content_id", "id").select(F.col("id").alias("content_id"), "content_clean")
    listed = (
        listed.join(among(fact_sets, ids, "fact", "fact").select("fact", "location_ids", "location_names"), "fact")
        .join(among(analyses, page, "gkg_id", "gkg_id"), "gkg_id")
        .join(texts, "content_id")
    )
    return fact_review(listed, among(validation, ids, "fact", "fact_id"), values, key="fact").orderBy("fact")


def grouped_facts(
    filtered: DataFrame, fact_sets: DataFrame, limit: int | None = 32, offset: int = 0
) -> DataFrame:
    """Facts that report the same figure, term, unit and places, most frequent group first."""
    keys = ["specific_reported_figure", "term", "unit", "location_ids_num"]
    one_per_fact = filtered.groupBy("fact").agg(
        F.min_by(F.struct(*keys), F.struct("gdelt_day", "gkg_id", "location")).alias("r")
    ).select("fact", "r.*")
    groups = (
        one_per_fact.join(fact_sets.select("fact", "location_names"), "fact")
        .groupBy(*keys)
        .agg(F.min("location_names").alias("location_names"), F.count(F.lit(1)).alias("nfacts"))
    )
    if limit is None:
        return groups
    return groups.orderBy(
        F.desc("nfacts"), *[F.asc_nulls_last(k) for k in keys]
    ).offset(offset).limit(limit)


def get_document(gkg: DataFrame, analyses: DataFrame, contents: DataFrame) -> DataFrame:
    """Article with its title, day of publication, category and (where stored) clean text, one row per
    analysed article. ``analyses`` has gkg_id, title, publication_date, category and content_id."""
    return (
        gkg.select(
            F.col("id").alias("gkg_id"), F.col("date").alias("gkg_date"), "source_common_name",
            "document_identifier",
        )
        .join(
            analyses.select(
                "gkg_id", F.col("title").alias("document_title"),
                F.date_format("publication_date", "yyyy-MM-dd").alias("publication_date"), "category", "content_id"),
            "gkg_id",
        )
        .join(contents.select(F.col("id").alias("content_id"), "content_clean"), "content_id", "left")
        .drop("content_id")
    )


def fact_locations_nested(
    fact_locations: DataFrame, locations: DataFrame, countries: DataFrame
) -> DataFrame:
    """Per fact, its places as an array of structs ordered by name."""
    places = locations.select(
        F.col("id").alias("location"), "location_name", "location_type",
        F.col("country").alias("iso3"), "latlong",
    ).join(countries.select("iso3", F.col("preferred_term").alias("country_name")), "iso3")
    entry = F.struct("location_name", "location_type", "iso3", "country_name", "latlong")
    return (
        fact_locations.join(places, "location")
        .groupBy("fact")
        .agg(F.array_sort(F.collect_list(entry)).alias("locations"))
    )


def document_facts(
    facts: DataFrame,
    analysis_facts: DataFrame,
    fact_locations: DataFrame,
    locations: DataFrame,
    countries: DataFrame,
) -> DataFrame:
    """Facts per article, with all columns of ``facts`` (excerpt and tags included) and nested places; facts
    without a place in a known country are left out."""
    return (
        analysis_facts.select(F.col("analysis").alias("gkg_id"), F.col("fact").alias("id"))
        .join(facts.drop("gkg_id"), "id")
        .join(
            fact_locations_nested(fact_locations, locations, countries).withColumnRenamed("fact", "id"),
            "id",
        )
        .withColumnRenamed("id", "fact_id")
    )


def article_coords(
    analysis_facts: DataFrame, fact_locations: DataFrame, locations: DataFrame
) -> DataFrame:
    """Distinct (lat, lon) per article."""
    points = locations.filter(F.col("latlong").isNotNull()).select(
        F.col("id").alias("location"),
        F.split_part("latlong", F.lit(","), F.lit(1)).alias("lat"),
        F.split_part("latlong", F.lit(","), F.lit(2)).alias("lon"),
    )
    return (
        analysis_facts.join(fact_locations, "fact")
        .join(points, "location")
        .select(F.col("analysis").alias("gkg_id"), "lat", "lon")
        .distinct()
    )


def recent_articles(
    analyses: DataFrame, gkg: DataFrame, contents: DataFrame, n: int = 10
) -> DataFrame:
    """The latest articles for the front page; texts join after the cut."""
    latest = analyses.orderBy(F.desc("updated"), "gkg_id").limit(n)
    return (
        latest.join(gkg.select(F.col("id").alias("gkg_id"), "document_identifier"), "gkg_id", "left")
        .join(contents.select(F.col("id").alias("content_id"), "content"), "content_id", "left")
        .select(
            "gkg_id",
            F.coalesce(F.substring("document_identifier", 1, 40), F.lit("")).alias("url"),
            F.initcap("status").alias("status"),
            F.date_format("updated", "yyyy-MM-dd HH:mm").alias("updated"),
            F.coalesce(F.substring("content", 1, 100), F.lit("None")).alias("content"),
        )
    )


def oldest_first(analyses: DataFrame, status: str, n: int) -> DataFrame:
    return analyses.filter(F.col("status") == status).orderBy("updated", "gkg_id").limit(n)


def unanalysed_documents(gkg: DataFrame, analyses: DataFrame) -> DataFrame:
    return gkg.join(analyses.select(F.col("gkg_id").alias("id")), "id", "left_anti")


def new_document_batch(gkg: DataFrame, analyses: DataFrame, n: int = 1000) -> DataFrame:
    return unanalysed_documents(gkg, analyses).orderBy("date", "id").limit(n)
