"""Cases that were wrong before: places without a country, bad feed rows, text syntax, columns of filters."""

import pytest

from newsfacts.operators import filters, geotag
from newsfacts.operators.filters import filter_locations, parse_list, text_predicate
from newsfacts.sources.readers import SHORT_FEED, read_gkg


def test_place_without_a_country_is_in_the_unknown_one(spark):
    facts = spark.createDataFrame([(1, "FRA"), (2, "DEU")], "id long, iso3 string")
    links = spark.createDataFrame([(1, 10), (1, 11)], "fact long, location long")
    places = spark.createDataFrame([(10, "FRA"), (11, None)], "id long, country string")
    split, pairs = geotag.split_fact_by_country(facts, links, places)
    ids = sorted((r["id"], r["iso3"]) for r in split.collect())
    assert ids == [(1, "FRA"), (2, "DEU"), (3, "XXX")]
    assert sorted((r["fact"], r["location"]) for r in pairs.collect()) == [(1, 10), (3, 11)]
    bridge = spark.createDataFrame([(70, 1), (71, 1), (72, 2)], "analysis long, fact long")
    assert sorted((r["analysis"], r["fact"]) for r in geotag.split_article_bridge(split, bridge).collect()) == [
        (70, 1), (70, 3), (71, 1), (71, 3), (72, 2)]


def test_bad_feed_rows_are_skipped_whatever_is_read(spark, tmp_path):
    (tmp_path / "feed.csv").write_text("a,20170101120000,http://x.org/1\nb,never,http://x.org/2\n")
    feed = read_gkg(spark, str(tmp_path), SHORT_FEED)
    assert feed.count() == feed.select("date").count() == len(feed.select("document_identifier").collect()) == 1


def test_unsupported_text_syntax_is_refused(spark):
    for query in ("(alpha | beta", "alpha &", "& beta", "(alpha) <-> beta", "alpha)"):
        with pytest.raises(ValueError):
            text_predicate(query, None)


def test_location_filter_keeps_the_columns(spark):
    facts = spark.createDataFrame([(1, 5, "x")], "fact long, location long, unit string")
    for ids in ([5], list(range(filters.LITERAL_IDS + 1))):
        assert filter_locations(facts, ids).columns == facts.columns


def test_lists():
    assert [parse_list(t) for t in ("{A,B}", " {A} ", "A,B", "{}", "", None)] == [
        ["A", "B"], ["A"], ["A", "B"], None, None, None]
    for text in ("{A,B", "A}", "{{A}}"):
        with pytest.raises(ValueError):
            parse_list(text)
