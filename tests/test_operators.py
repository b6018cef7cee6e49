"""Operators on small literal rows: NULLs, ties, empty input and busy keys."""

import numpy as np
import pytest
from helpers import rows
from pyspark.sql import functions as F

from newsfacts.functions import geo
from newsfacts.functions import spans as sp
from newsfacts.functions import text as tx
from newsfacts.operators import facets, geotag, keys, models, repair, stages, words
from newsfacts.operators.filters import FactFilter, parse_filter_params, saved_filter_counts
from newsfacts.operators.neighbours import knn_join
from newsfacts.operators.spans import tag_span_union
from newsfacts.plans import marts

FACTS = "fact long, location long, category string, unit string, source_common_name string, term string, " \
        "iso3 string, specific_reported_figure int, location_ids_num long, gdelt_day date, content_id long"


@pytest.fixture(scope="module")
def facts(spark):
    data = [
        (1, 10, "Conflict", "Person", "a", "Displaced", "SYR", 5, 1, "2017-01-01", 1),
        (1, 11, "Conflict", "Person", "a", "Displaced", "SYR", 5, 1, "2017-01-01", 1),
        (2, 10, "Disaster", "Household", "b", "Evicted", None, None, 2, "2017-06-30", 2),
        (3, None, "Other", "Person", "b", "Evicted", "IRQ", 1000, 2, "2018-01-01", 2),
        (4, 12, "Conflict", "Person", None, "Fled", "IRQ", None, 2, "2018-05-01", 3),
    ]
    return spark.createDataFrame(data, FACTS.replace("date,", "string,")).withColumn(
        "gdelt_day", F.col("gdelt_day").cast("date"))


def ids(df):
    return sorted(r.fact for r in df.select("fact").collect())


def test_null_figures_are_left_out_by_default(facts):
    assert ids(FactFilter().apply(facts)) == [1, 1, 3]


@pytest.mark.parametrize("token", ["NULL", "null", None])
def test_null_figure_tokens_agree(facts, token):
    assert ids(FactFilter(specific_reported_figures=[token]).apply(facts)) == [2, 4]
    assert ids(FactFilter(specific_reported_figures=[token, "1", 10]).apply(facts)) == [1, 1, 2, 4]


def test_figures_are_compared_as_numbers(facts):
    assert ids(FactFilter(specific_reported_figures=["9", "1000"]).apply(facts)) == [3]


def test_dates_are_inclusive(facts):
    assert ids(FactFilter(fromdate="2017-01-01", todate="2018-01-01").apply(facts)) == [1, 1, 3]


def test_null_location_rows_come_once(facts):
    got = FactFilter(location_ids=["NULL", 10, "11"]).apply(facts)
    assert ids(got) == [1, 1, 3]
    many = FactFilter(location_ids=[None, *range(2000)]).apply(facts)
    assert ids(many) == [1, 1, 3]


def test_empty_parameter_means_no_filter():
    f = parse_filter_params({"categories": "{}", "units": "{Person,Household}", "location_ids_num": "3"})
    assert (f.categories, f.units, f.location_ids_num) == ([], ["Person", "Household"], 3)


def test_text_filter(spark, facts):
    texts = ["Jordan river in the valley", "the jordanian side", "Nothing, said Jordan"]
    contents = spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "id long, t string").select(
        "id", tx.token_text(F.col("t")).alias("token_text"))
    every = dict(specific_reported_figures=[None, 0, 10**6])

    def hits(q):
        return sorted({r.content_id for r in FactFilter(ts=q, **every).apply(facts, contents).collect()})

    assert hits("Jordan") == [1, 3] and hits("jordan & !said") == [1] and hits("said | jordanian") == [2, 3]
    assert hits("in <-> the <-> valley") == [1] and hits("river <-> valley") == [] and hits("the") == []


def test_facets_add_up_and_scan_once(facts):
    every = FactFilter(specific_reported_figures=[None, 0, 10**6]).apply(facts)
    counted = facets.facet_counts(every)
    assert rows(counted) == rows(facets.facet_union(every))
    sums = {r.filter_type: r.s for r in counted.groupBy("filter_type").agg(F.sum("count").alias("s")).collect()}
    assert set(sums) == set(facets.FACETS) and set(sums.values()) == {every.count()}
    (null,) = counted.filter("filter_type = 'iso3' and value is null").collect()
    assert null["count"] == 1


def test_saved_filters_equal_single_ones(facts):
    saved = {"a": FactFilter(), "b": FactFilter(location_ids=["NULL", 10], specific_reported_figures=[None, 1, 9])}
    got = {r.name: r.n for r in saved_filter_counts(facts, saved).collect()}
    assert got == {k: f.apply(facts).count() for k, f in saved.items()}


def test_groups_treat_null_as_a_value(facts):
    every = FactFilter(specific_reported_figures=[None, 0, 10**6]).apply(facts)
    assert facets.group_count(every).first().n == 4


def test_rank_has_ties_and_gaps(spark):
    sizes = spark.createDataFrame([([1], 2), ([1, 2], 1), ([2], 5), ([10], 1)], "location_ids array<long>, n long")
    ranked = keys.rank_by_weight(sizes, ["location_ids"], F.col("n"), "num")
    got = {tuple(r.location_ids): r.num for r in ranked.collect()}
    assert got == {(1,): 1, (1, 2): 3, (2,): 4, (10,): 9}


def test_rank_of_nothing(spark):
    empty = spark.createDataFrame([], "k long")
    assert keys.number_rows(empty, ["k"], "n").collect() == []


def test_scan_with_one_busy_key(spark):
    """One key holds most rows and crosses every partition border."""
    n = 5000
    data = spark.range(n).select(
        F.when(F.col("id") % 50 == 0, F.col("id")).otherwise(-1).alias("k"), F.col("id").alias("o"),
        F.when(F.col("id") % 700 == 3, F.col("id")).alias("v"))
    scanned = keys.scan_within_keys(
        data, ["k"], ["o"], number="nr", lag={"before": "o"}, lead={"after": "o"}, last_known={"known": "v"})
    busy = [r for r in scanned.filter("k = -1").orderBy("o").collect()]
    order = [i for i in range(n) if i % 50]
    assert [r.nr for r in busy] == list(range(1, len(order) + 1))
    assert [r.before for r in busy] == [None, *order[:-1]] and [r.after for r in busy] == [*order[1:], None]
    known, want = None, []
    for i in order:
        want.append(known)
        known = i if i % 700 == 3 else known
    assert [r.known for r in busy] == want
    assert scanned.filter("k >= 0 and (nr <> 1 or before is not null or after is not null)").count() == 0


def test_spans_merge_and_last_of_a_start_wins(spark):
    data = [(1, 1, "term", 0, 4), (1, 2, "loc", 4, 6), (1, 3, "quantity", 10, 12), (1, 4, "loc", 10, 11)]
    flat = spark.createDataFrame(data, "gkg_id long, seq long, type string, start int, end int")
    want = [(1, "loc", 10, 11), (1, "term, loc", 0, 6)]
    assert rows(tag_span_union(flat), "gkg_id", "type", "start", "end") == want
    packed = flat.orderBy("seq").groupBy("gkg_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "type", "start", "end"))),
                    lambda s: F.struct(s["type"], s["start"], s["end"])).cast(sp.SPANS).alias("s"))
    merged = packed.select(sp.merge_spans(F.col("s")).alias("m")).first().m
    assert sorted((1, *m) for m in merged) == want


def test_marked_text(spark):
    d = spark.createDataFrame([("100 people fled.", [("Quantity", 0, 3), ("term", 11, 15)]), ("none", [])],
                              f"t string, s {sp.SPANS}")
    got = [r[0] for r in d.select(sp.mark_tagged_text(F.col("t"), F.col("s"))).collect()]
    assert got == ['<mark data-entity="quantity">100</mark> people <mark data-entity="term">fled</mark>.', "none"]


def test_cleanup(spark):
    cases = {
        "Flooding has stranded many peole100 families": "Flooding has stranded many people. 100 families",
        "1 000 people": "1000 people", "healthIMPACT of": "health. IMPACT of", "RESPONSEteam": "RESPONSE. team",
        "a\t\n b c": "a b c", "café": "caf", "x\x1cy": "x y",
    }
    d = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: r.c for r in d.select("t", tx.cleanup_text(F.col("t")).alias("c")).collect()}
    # The misspelling is repaired after the letter and digit are split.
    cases["Flooding has stranded many peole100 families"] = "Flooding has stranded many people. 100 families"
    assert got == cases
    one = spark.createDataFrame([("someone said 20 years",)], "t string")
    assert one.select(tx.wordcloud_text(F.col("t"))).first()[0] == "some   s"


@pytest.mark.parametrize("url,want", [
    ("http://www.philstar.com/headlines", "philstar.com"), ("https://news.example.org/a", "news.example.org"),
    ("no slashes", None), ("http:///x", ""),
])
def test_source_name(spark, url, want):
    d = spark.createDataFrame([(url,)], "u string")
    assert d.select(tx.source_name_from_url(F.col("u"))).first()[0] == want


def test_places(spark):
    places = spark.createDataFrame([(p,) for p in ["India", "alaska", "São Paulo", "London", "xghij"]], "place_name string")
    terms = spark.createDataFrame([("India", "IND", 1), ("India", "ZZZ", 3)], "term string, country string, priority int")
    parts = spark.createDataFrame([("Alaska", "USA"), ("Sao Paulo", "BRA")], "name string, iso3 string")
    codes = spark.createDataFrame([("GB", "GBR"), ("IN", "IND"), ("US", "USA")], "iso2 string, iso3 string")
    cand = spark.createDataFrame(
        [("London", 0.9, "51.5", "-0.1", "gb", None, "city", "place"), ("London", 0.4, "1", "2", "ca", None, "city", "place"),
         ("India", 0.3, "5", "6", "in", None, "x", "y"), ("India", 0.8, "7", "8", "us", None, "x", "y")],
        "place_name string, importance double, lat string, lon string, iso2 string, place_extratag string, type string, class string")
    got = {r.place_name: tuple(r)[1:] for r in geotag.geo_info(places, terms, parts, cand, codes).collect()}
    assert got == {
        "India": ("country", "IND", "5,6", "single-result"),
        "alaska": ("subdivision", "USA", "", "no-results"),
        "São Paulo": ("subdivision", "BRA", "", "no-results"),
        "London": ("city", "GBR", "51.5,-0.1", "multiple-results"),
        "xghij": ("", "XXX", "", "no-results"),
    }
    assert geo.OSM_PLACES[0][1].count("locality") == 1


def test_fact_in_two_countries_becomes_two(spark):
    f = spark.createDataFrame([(7, "Person", None), (9, "Person", "FRA")], "id long, unit string, iso3 string")
    pairs = spark.createDataFrame([(7, 1), (7, 2), (7, 3)], "fact long, location long")
    loc = spark.createDataFrame([(1, "PAK"), (2, "IND"), (3, "IND")], "id long, country string")
    split, placed = geotag.split_fact_by_country(f, pairs, loc)
    assert rows(split, "id", "source_fact", "iso3") == [(10, 7, "PAK"), (7, 7, "IND"), (9, 9, "FRA")]
    assert rows(placed, "fact", "location") == [(10, 1), (7, 2), (7, 3)]


def test_stale_change_is_rejected(spark):
    now = F.lit("2020-01-01").cast("timestamp_ntz")
    current = spark.createDataFrame([(1, "new"), (2, "scraped")], "gkg_id long, status string").withColumn("updated", now)
    changes = spark.createDataFrame(
        [(1, "new", "scraping", 2), (1, "new", "editing", 1), (2, "new", "scraping", 1), (3, "new", "scraping", 1)],
        "gkg_id long, expected string, new_status string, requested long")
    table, history, rejected = stages.advance_status(current, changes, now)
    assert rows(table, "gkg_id", "status") == [(1, "editing"), (2, "scraped")]
    assert rows(history, "gkg_id", "status") == [(1, "new")]
    assert rows(rejected, "gkg_id", "new_status") == [(1, "scraping"), (2, "scraping"), (3, "scraping")]


def test_stage_outcomes_and_history(spark):
    now = F.lit("2020-01-01").cast("timestamp_ntz")
    table = spark.createDataFrame([(1, "new"), (2, "new"), (3, None)], "gkg_id long, status string").withColumn("updated", now)
    stage = stages.Stage(F.col("status") == "new", "scraping", "scraped", "scraping failed",
                         lambda d: d.withColumn("error", F.when(F.col("gkg_id") == 2, "boom")))
    after, history = stages.run_stage(table, stage, now)
    assert rows(after, "gkg_id", "status", "error_msg") == [
        (1, "scraped", None), (2, "scraping failed", "boom"), (3, None, None)]
    assert rows(history, "gkg_id", "status") == [(1, "new"), (1, "scraping"), (2, "new"), (2, "scraping")]


def test_repair(spark):
    loc = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, location_name string")
    pairs = spark.createDataFrame([(5, 1), (5, 2), (6, 3), (6, 99)], "fact long, location long")
    moved = repair.canonical_locations(pairs, loc)
    assert rows(repair.unique_fact_locations(moved)) == [(5, 1), (6, 3), (6, 99)]


def test_collocations_join_left_to_right(spark):
    d = spark.createDataFrame([(1, ["new", "york", "new", "york", "city"]), (2, ["a", "a", "a"]), (3, [])],
                              "k long, terms array<string>")
    accepted = spark.createDataFrame([("new", "york"), ("york", "city"), ("a", "a")], "a string, b string")
    assert rows(words.join_collocations(d, "k", "terms", accepted)) == [
        (1, ["new_york", "new_york", "city"]), (2, ["a_a", "a"]), (3, [])]


@pytest.mark.parametrize("block", [16, 2048])
def test_nearest_neighbours_are_exact(spark, block):
    """Against brute force, with copies that make one cell hold a third of all rows."""
    rng = np.random.default_rng(3)
    points = np.round(rng.normal(size=(240, 4)), 3)
    points[:80] = points[0]
    data = [(i, [float(x) for x in p], i % 3) for i, p in enumerate(points)]
    train = spark.createDataFrame(data, "train_id long, vector array<double>, label int")
    queries = train.select(F.col("train_id").alias("query_id"), "vector")
    got = {}
    for r in knn_join(queries, train, 4, pivots=6, block=block).collect():
        got.setdefault(r.query_id, []).append((r.distance, r.train_id))
    for q in range(len(points)):
        d = np.sqrt(((points - points[q]) ** 2).sum(axis=1))
        want = sorted((d[i], i) for i in range(len(points)) if i != q)[:4]
        assert [i for _, i in sorted(got[q])] == [i for _, i in want]


def test_lsi_spans_the_leading_directions(spark):
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(1)
    a = rng.normal(size=(60, 3)) @ rng.normal(size=(3, 12))
    d = spark.createDataFrame([(Vectors.dense(r.tolist()),) for r in a], ["v"])
    basis = models.fit_lsi(d, "v", 12, 3)
    assert np.allclose(a @ basis @ basis.T, a, atol=1e-6)


def test_map_week_starts_on_monday(spark):
    day = spark.sql("select 20170215174500L d").select(marts.gdelt_day(F.col("d")).alias("x"))
    assert str(day.first().x) == "2017-02-15"
    assert str(day.select(F.date_trunc("week", "x").cast("date")).first()[0]) == "2017-02-13"
