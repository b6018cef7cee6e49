"""What a page of facts reads."""

import datetime as dt

import pytest
from helpers import rows
from pyspark.sql import functions as F

from newsfacts.operators import listing


@pytest.mark.parametrize("table", ["details", "analyses", "contents", "validation", "sets"])
def test_a_page_works_out_wide_rows_of_its_facts_only(spark, table):
    """The wide column of one table at a time breaks on every row that the page does not need."""
    n = 300
    facts = spark.range(n).select(
        F.col("id").alias("fact"), F.lit(dt.date(1998, 1, 1)).alias("gdelt_day"), F.col("id").alias("gkg_id"),
        F.lit(5).alias("location"), F.col("id").alias("content_id"), *[F.lit("x").alias(c) for c in (
            "document_identifier", "source_common_name", "unit", "term", "iso3", "category", "specific_reported_figure",
            "vague_reported_figure", "location_ids_num")])
    word = F.concat(F.lit("w"), F.col("id").cast("string"))
    tables = {
        "sets": spark.range(n).select(F.col("id").alias("fact"), F.array("id").alias("location_ids"),
                                      word.alias("location_names")),  # a text here, so that it can be counted
        "analyses": spark.range(n).select(F.col("id").alias("gkg_id"), word.alias("title")),
        "contents": spark.range(n).select("id", word.alias("content_clean")),
        "validation": spark.range(n).select(F.col("id").alias("fact_id"), F.lit("verified").alias("status"),
                                            word.alias("missing"), word.alias("wrong"), word.alias("assigned_to")),
        "details": spark.range(n).select("id", word.alias("excerpt")),
    }
    column = {"sets": "location_names", "analyses": "title", "contents": "content_clean", "validation": "missing",
              "details": "excerpt"}[table]
    needless = F.concat(F.col(column), F.lit("is no number")).cast("int").cast("string")
    tables[table] = tables[table].withColumn(
        column, F.when(F.col(column).isin("w10", "w11", "w12", "w13"), F.col(column)).otherwise(needless))
    values = spark.createDataFrame([("verified", "green")], "key_value string, display_color string")
    page = listing.url_list(facts, tables["sets"], tables["analyses"], tables["contents"], tables["validation"], values,
                            4, 10, tables["details"])
    assert rows(page, "fact", "title", "content_clean", "missing", "excerpt", "location_names", "display_color") == [
        (i, f"w{i}", f"w{i}", f"w{i}", f"w{i}", f"w{i}", "green") for i in range(10, 14)]
