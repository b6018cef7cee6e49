"""Readers of feeds, seed lists and training data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsfacts import vocab

GKG_FEED = (
    "url_id string, gkgrecordid string, date long, source_common_name string, "
    "document_identifier string, locations string, v2_counts string, v2_themes string"
)
SHORT_FEED = "url_id string, date long, document_identifier string"
COUNTRY_FILE = (
    "code_3 string, country_name string, official_name string, common_name string, latlong string"
)


def read_gkg(spark: SparkSession, path: str, schema: str = GKG_FEED) -> DataFrame:
    """Feed rows whose URL starts with ``http``; rows that do not parse are skipped.

    The date is read as text and tried, so which rows are skipped does not depend on the columns in use.
    """
    as_text = schema.replace("date long", "date string")
    feed = spark.read.schema(as_text).csv(path, mode="DROPMALFORMED", escape='"')
    number = F.expr("try_cast(trim(date) AS BIGINT)")
    return feed.filter(
        F.startswith(F.col("document_identifier"), F.lit("http")) & (F.col("date").isNull() | number.isNotNull())
    ).withColumn("date", number)


@dataclass
class CountryTables:
    countries: DataFrame
    country_terms: DataFrame
    locations: DataFrame


def load_countries(spark: SparkSession, path: str) -> CountryTables:
    """Countries, their terms with a lookup priority (name, common name, official name) and one
    ``country`` location each."""
    rows = spark.read.schema(COUNTRY_FILE).csv(path, header=True, escape='"')
    named = F.array(
        F.struct(F.col("country_name").alias("term"), F.lit(1).alias("priority")),
        F.struct(F.col("common_name").alias("term"), F.lit(2).alias("priority")),
        F.struct(F.col("official_name").alias("term"), F.lit(3).alias("priority")),
    )
    terms = (
        rows.select(F.col("code_3").alias("country"), F.inline(named))
        .filter(F.length("term") > 0)
        .groupBy("term", "country")
        .agg(F.min("priority").alias("priority"))
    )
    return CountryTables(
        countries=rows.select(
            F.col("code_3").alias("iso3"), F.col("country_name").alias("preferred_term")
        ),
        country_terms=terms,
        locations=rows.select(
            F.col("country_name").alias("location_name"),
            F.lit(vocab.COUNTRY).alias("location_type"),
            F.col("code_3").alias("country"),
            "latlong",
        ),
    )


def load_keywords(
    spark: SparkSession,
    existing: DataFrame | None = None,
    added: dict[str, list[str]] | None = None,
) -> DataFrame:
    """(description, keyword_type): the seed lists unless some are stored, plus later additions."""
    rows = [(w, k) for k, words in vocab.SEED_KEYWORDS.items() for w in words]
    seeds = spark.createDataFrame(rows, "description string, keyword_type string")
    stored = seeds
    if existing is not None:
        present = existing.select("description", "keyword_type")
        first = present.select(F.count(F.lit(1))).scalar()
        stored = present.unionByName(seeds.filter(first == 0))
    extra = [(w, k) for k, words in (added or {}).items() for w in words]
    if extra:
        stored = stored.unionByName(
            spark.createDataFrame(extra, "description string, keyword_type string")
        )
    return stored.dropDuplicates()


def read_stop_words(spark: SparkSession, path: str) -> DataFrame:
    """One word per line."""
    return spark.read.text(path).select(F.trim("value").alias("word")).filter("word <> ''")


def read_labeled_docs(spark: SparkSession, path: str) -> DataFrame:
    """Training rows (doc_id, text, is_displacement, category); texts may span lines."""
    return spark.read.schema(
        "doc_id long, text string, is_displacement int, category string"
    ).csv(path, header=True, multiLine=True, escape='"', ignoreLeadingWhiteSpace=False)


def labeled_docs(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return documents.join(labels, "doc_id")


def label_index(df: DataFrame, column: str, out: str) -> DataFrame:
    """Consecutive numbers for the distinct labels, in alphabetical order, from 0.

    Labels are a closed vocabulary, so the distinct values are few.
    """
    labels = df.select(column).distinct().agg(F.array_sort(F.collect_set(column))).scalar()
    return df.withColumn(out, (F.array_position(labels, F.col(column)) - 1).cast("int"))
