"""Registered queries beside their SQL on the smallest tables, and properties of their plans."""

import pytest
from check_sql import compare, connect

from newsfacts.catalog.base import context
from newsfacts.catalog.registry import ORACLE, QUERIES
from newsfacts.operators import facets, listing
from newsfacts.operators.filters import FactFilter

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "timeline_counts", "facet_counts", "histogram_counts", "grouped_facts", "url_list", "wordcloud",
    "location_set_ids", "build_fact_api", "split_fact_by_country", "geo_info", "run_all_stages",
    "advance_status", "tag_span_union", "html_to_article", "submit_url", "filter_fulltext",
]


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, db, name):
    assert compare(db, ORACLE[name], QUERIES[name](spark, SF)) is None


def test_every_check_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_facets_scan_the_mart_once(spark):
    api = context(spark, SF).marts.fact_api
    assert plan(facets.facet_counts(FactFilter().apply(api))).count("FileScan") == 1


def test_filters_reach_the_scan(spark):
    api = context(spark, SF).marts.fact_api
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    flt = FactFilter(location_ids=[1, 2], categories=["Other"], fromdate="1997-01-15", todate="1997-02-15")
    text = plan(facets.timeline_counts(flt.apply(api)))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = text[text.index("PushedFilters"):]
    assert "In(location, [1,2])" in pushed and "category" in pushed and "gdelt_day" in pushed
    folders = text[text.index("PartitionFilters"):text.index("PushedFilters")]
    assert "month" in folders
    schema = text[text.index("ReadSchema"):].split(">")[0]
    assert "document_identifier" not in schema and "iso3" not in schema


def test_no_cartesian_products(spark):
    c = context(spark, SF)
    every = FactFilter().apply(c.marts.fact_api)
    for df in (
        listing.grouped_facts(every, c.marts.fact_api_locations),
        facets.wordcloud(every, c.stored_contents),
        FactFilter(ts="ing").apply(c.marts.fact_api, c.stored_contents),
        QUERIES["document_facts"](spark, SF),
        QUERIES["geo_info"](spark, SF),
    ):
        text = plan(df)
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
