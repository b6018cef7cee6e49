"""All stages once, in order: initiate, scrape, classify, extract, geotag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsfacts import vocab
from newsfacts.operators.filters import retry_due
from newsfacts.operators.stages import Stage, run_stage
from newsfacts.sources.writers import initiate


def scraping_select(now: Column) -> Column:
    return (F.col("status") == vocab.NEW) | (
        (F.col("status") == vocab.SCRAPING_FAILED)
        & (F.col("retrieval_attempts") < 3)
        & retry_due(F.col("retrieval_date"), now)
    )


def scrape(contents: DataFrame, now: Column):
    """Finds an article's text by content id; it must be there and in English. ``contents`` holds
    (content_id, lang)."""

    def run(rows: DataFrame) -> DataFrame:
        return (
            rows.join(contents.select("content_id", F.col("lang").alias("_lang")), "content_id", "left")
            .withColumn("retrieval_attempts", F.col("retrieval_attempts") + 1)
            .withColumn("retrieval_date", now)
            .withColumn(
                "error",
                F.when(F.col("_lang").isNull(), "Retrieval Failed").when(
                    F.col("_lang") != "en", "Article not in English"
                ),
            )
            .drop("_lang")
        )

    return run


def classify(predictions: DataFrame):
    """Takes category and relevance from a table of predictions by content id."""

    def run(rows: DataFrame) -> DataFrame:
        joined = rows.drop("category", "relevance").join(predictions, "content_id", "left")
        return joined.withColumn("error", F.when(F.col("category").isNull(), "No prediction"))

    return run


def no_op(rows: DataFrame) -> DataFrame:
    return rows.withColumn("error", F.lit(None).cast("string"))


def geotag(bad_articles: DataFrame):
    """Fails the articles that have a place nothing could resolve."""

    def run(rows: DataFrame) -> DataFrame:
        marked = rows.join(bad_articles.select("gkg_id", F.lit(True).alias("_bad")), "gkg_id", "left")
        return marked.withColumn("error", F.when(F.col("_bad"), "Geotagging failed")).drop("_bad")

    return run


def run_all(
    gkg: DataFrame,
    analyses: DataFrame,
    contents: DataFrame,
    predictions: DataFrame,
    bad_articles: DataFrame,
    now: Column,
) -> DataFrame:
    """The analyses table after one run of every stage."""
    table = analyses.unionByName(initiate(gkg, analyses, now), allowMissingColumns=True)
    stages = [
        Stage(scraping_select(now), vocab.SCRAPING, vocab.SCRAPED, vocab.SCRAPING_FAILED, scrape(contents, now)),
        Stage(F.col("status") == vocab.SCRAPED, vocab.CLASSIFYING, vocab.CLASSIFIED,
              vocab.CLASSIFYING_FAILED, classify(predictions)),
        Stage(F.col("status") == vocab.CLASSIFIED, vocab.EXTRACTING, vocab.EXTRACTED,
              vocab.EXTRACTING_FAILED, no_op),
        Stage(F.col("status") == vocab.EXTRACTED, vocab.GEOTAGGING, vocab.GEOTAGGED,
              vocab.GEOTAGGING_FAILED, geotag(bad_articles)),
    ]
    for stage in stages:
        table, _history = run_stage(table, stage, now)
    return table
