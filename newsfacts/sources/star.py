"""Adapter: re-reads a TPC-H-like star schema plus text tables as news tables.

Every view is derived by Spark from the whole input tables; nothing is sampled. ``NewsTables``
hands out DataFrames; ``Marts`` (see ``plans.marts``) builds the read model on top of them.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsfacts.functions import text as tx
from newsfacts.operators.keys import dealt, shares

FACT_ID = "((l_orderkey*1000000 + l_partkey)*10000 + l_suppkey)*10 + l_linenumber"


class NewsTables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def gkg(self) -> DataFrame:
        host = F.concat(F.lit("src"), (F.col("o_custkey") % 20).cast("string"), F.lit(".example.com"))
        day = F.col("o_orderdate")
        key = F.col("o_orderkey")
        return (
            self.raw("orders")
            .filter((key % 17 != 16) | (key % 2 == 0))
            .select(
                key.alias("id"),
                F.concat(F.lit("rec-"), key.cast("string")).alias("gkgrecordid"),
                (
                    F.year(day).cast("long") * 10000000000
                    + F.month(day).cast("long") * 100000000
                    + F.dayofmonth(day).cast("long") * 1000000
                    + 174500
                ).alias("date"),
                host.alias("source_common_name"),
                F.concat(F.lit("http://www."), host, F.lit("/doc/"), key.cast("string")).alias(
                    "document_identifier"
                ),
            )
        )

    @cached_property
    def analyses(self) -> DataFrame:
        key = F.col("o_orderkey")
        n_contents = self.raw("documents").select(F.count(F.lit(1))).scalar()
        status = (
            F.when(key % 9 == 0, "new")
            .when(key % 9 == 1, "scraping failed")
            .when(key % 9 == 2, "scraped")
            .when(key % 9 == 3, "classified")
            .when(key % 9 == 4, "extracted")
            .when(key % 9 == 5, "extracting failed")
            .otherwise("geotagged")
        )
        priority = F.col("o_orderpriority")
        return (
            self.raw("orders")
            .filter(key % 17 != 16)
            .select(
                key.alias("gkg_id"),
                status.alias("status"),
                F.when(F.col("o_orderstatus") == "F", True)
                .when(F.col("o_orderstatus") == "O", False)
                .alias("relevance"),
                F.when(priority == "1-URGENT", "Conflict")
                .when(priority.isin("2-HIGH", "5-LOW"), "Disaster")
                .when(priority == "3-MEDIUM", "Other")
                .alias("category"),
                (key % 5).cast("int").alias("retrieval_attempts"),
                F.col("o_orderdate").alias("retrieval_date"),
                F.col("o_orderdate").alias("updated"),
                (key % n_contents).alias("content_id"),
            )
        )

    @cached_property
    def facts(self) -> DataFrame:
        supplier = self.raw("supplier").select("s_suppkey", "s_nationkey")
        scale = (
            F.when(F.col("l_linenumber").isin(1, 6), 1)
            .when(F.col("l_linenumber") == 2, 10)
            .when(F.col("l_linenumber") == 3, 100)
            .when(F.col("l_linenumber") == 4, 1000)
            .when(F.col("l_linenumber") == 5, 20000)
            .otherwise(3000000)
        )
        term = (
            F.when(F.col("_term") == 0, "Displaced")
            .when(F.col("_term") == 1, "Evacuated")
            .when(F.col("_term") == 2, "Forced to Flee")
            .when(F.col("_term") == 3, "Homeless")
            .when(F.col("_term") == 4, "Evicted")
            .otherwise("Destroyed Housing")
        )
        nation = F.concat(F.lit("N"), F.lpad(F.col("s_nationkey").cast("string"), 2, "0"))
        # Dealt by id as numbers: texts are made after the shuffle, and rows are sorted by id once.
        dealt_rows = (
            self.raw("lineitem")
            .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
            .select(
                F.expr(FACT_ID).alias("id"), F.col("l_orderkey").alias("gkg_id"), "l_linestatus",
                (F.col("l_partkey") % 6).alias("_term"), (F.col("l_suppkey") % 7 == 0).alias("_vague"),
                (F.col("l_quantity").cast("int") * scale).alias("_figure"), "s_nationkey",
            )
            .repartition("id")
        )
        return (
            dealt_rows.select(
                "id",
                "gkg_id",
                F.when(F.col("l_linestatus") == "O", "Person").otherwise("Household").alias("unit"),
                term.alias("term"),
                F.when(~F.col("_vague"), F.col("_figure")).alias("specific_reported_figure"),
                F.when(F.col("_vague"), "hundreds").alias("vague_reported_figure"),
                nation.alias("iso3"),
            )
            .groupBy("id")
            .agg(
                *[
                    F.min(c).alias(c)
                    for c in (
                        "gkg_id", "unit", "term", "specific_reported_figure",
                        "vague_reported_figure", "iso3",
                    )
                ]
            )
        )

    @cached_property
    def article_details(self) -> DataFrame:
        """Title, authors and publication of an article, as its page gave them."""
        key = F.col("o_orderkey")
        return self.raw("orders").select(
            key.alias("gkg_id"),
            F.concat(F.lit("Report "), F.col("o_orderpriority"), F.lit(" of "), F.col("o_custkey").cast("string")).alias(
                "title"),
            F.when(key % 11 != 0, F.concat(F.lit("Author "), (F.col("o_custkey") % 50).cast("string"))).alias("authors"),
            F.date_sub(F.col("o_orderdate").cast("date"), (key % 4).cast("int")).alias("publication_date"),
        )

    @cached_property
    def fact_details(self) -> DataFrame:
        """Excerpt and tagged spans of a fact."""
        start = (F.col("id") % 500).cast("int")

        def span(kind: str, at: int, length: int):
            return F.struct(F.lit(kind).alias("type"), (start + at).alias("start"), (start + at + length).alias("end"))

        place = F.when(F.col("id") % 2 == 0, F.array(span("loc", 20, 6))).otherwise(F.array().cast(
            "array<struct<type:string,start:int,end:int>>"))
        return self.facts.select(
            "id", start.alias("excerpt_start"), (start + 80).alias("excerpt_end"),
            F.concat(F.array(span("term", 5, 10)), place).alias("tag_spans"))

    @cached_property
    def analysis_facts(self) -> DataFrame:
        """Dealt by article, so that a join on it needs no second shuffle."""
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("analysis"), F.expr(FACT_ID).alias("fact")
        ).repartition("analysis").distinct()

    @cached_property
    def locations(self) -> DataFrame:
        key = F.col("s_suppkey")
        latlong = F.concat_ws(
            ",",
            ((key * 37) % 200 - 100).cast("string"),
            ((key * 53) % 360 - 180).cast("string"),
        )
        return self.raw("supplier").select(
            key.alias("id"),
            F.col("s_name").alias("location_name"),
            F.when(key % 3 == 0, "city").when(key % 3 == 1, "subdivision").otherwise("country").alias(
                "location_type"
            ),
            F.concat(F.lit("N"), F.lpad(F.col("s_nationkey").cast("string"), 2, "0")).alias("country"),
            F.when(key % 10 != 9, latlong).alias("latlong"),
        )

    @cached_property
    def countries(self) -> DataFrame:
        return self.raw("nation").select(
            F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("iso3"),
            F.col("n_name").alias("preferred_term"),
        )

    @cached_property
    def raw_fact_locations(self) -> DataFrame:
        """Fact-location pairs as stored, repeats included."""
        home = F.col("l_suppkey")
        places = F.when(F.col("l_partkey") % 3 == 0, F.array(home, home - home % 10)).otherwise(
            F.array(home)
        )
        return (
            self.raw("lineitem")
            .filter(F.col("l_partkey") % 11 != 0)
            .select(F.expr(FACT_ID).alias("fact"), F.explode(places).alias("location"))
        )

    @cached_property
    def fact_locations(self) -> DataFrame:
        """Dealt by fact, so that grouping or joining by it needs no second shuffle."""
        return self.raw_fact_locations.repartition("fact").distinct()

    @cached_property
    def article_sentences(self) -> DataFrame:
        """One templated sentence per line item; ``fact`` orders the sentences of an article."""
        supplier = self.raw("supplier").select("s_suppkey", "s_nationkey")
        nation = self.raw("nation").select("n_nationkey", "n_name")
        figure = F.when(F.col("l_suppkey") % 7 == 0, "Hundreds of").otherwise(
            F.col("l_quantity").cast("int").cast("string")
        )
        verb = (
            F.when(F.col("l_partkey") % 5 == 0, "displaced")
            .when(F.col("l_partkey") % 5 == 1, "evacuated")
            .when(F.col("l_partkey") % 5 == 2, "forced to flee")
            .when(F.col("l_partkey") % 5 == 3, "left homeless")
            .otherwise("evicted")
        )
        subject = F.when(F.col("l_linestatus") == "O", " people were ").otherwise(" families were ")
        place = F.when(F.col("l_linenumber") % 2 == 0, "").otherwise(
            F.concat(F.lit(" in "), F.col("n_name"))
        )
        return (
            self.raw("lineitem")
            .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
            .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
            .select(
                F.col("l_orderkey").alias("gkg_id"),
                F.expr(FACT_ID).alias("fact"),
                F.concat(figure, subject, verb, place, F.lit(".")).alias("sentence"),
            )
        )

    @cached_property
    def contents(self) -> DataFrame:
        """Dealt over tasks before the text is cleaned, whatever files it comes in."""
        clean = tx.cleanup_text(F.col("text"))
        documents = self.raw("documents").select("doc_id", "text")
        return dealt(documents, shares(documents, "text")).select(
            F.col("doc_id").alias("id"),
            F.col("text").alias("content"),
            clean.alias("content_clean"),
            F.lit("text").alias("content_type"),
        )

    @cached_property
    def validation(self) -> DataFrame:
        """Review status of every fifth fact."""
        return self.facts.filter(F.col("id") % 5 == 0).select(
            F.col("id").alias("fact_id"),
            F.when(F.col("id") % 4 == 0, "verified")
            .when(F.col("id") % 4 == 1, "rejected")
            .when(F.col("id") % 4 == 2, "in review")
            .otherwise("unknown to the dictionary")
            .alias("status"),
            F.when(F.col("id") % 3 == 0, "location").alias("missing"),
            F.when(F.col("id") % 7 == 0, "figure").alias("wrong"),
            F.concat(F.lit("analyst"), (F.col("id") % 9).cast("string")).alias("assigned_to"),
        )

    @cached_property
    def validation_values(self) -> DataFrame:
        rows = [
            (1, "verified", "green"), (2, "rejected", "red"),
            (3, "in review", "yellow"), (4, "assigned", "blue"),
        ]
        return self.spark.createDataFrame(
            rows, "key_id int, key_value string, display_color string"
        )
