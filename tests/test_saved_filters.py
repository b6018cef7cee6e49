"""A table of saved filters against one run per filter."""

import datetime as dt
import random

import pytest
from helpers import rows

from newsfacts.catalog.base import context
from newsfacts.operators import saved_filters as sf
from newsfacts.operators.filters import parse_filter_params

TEXTS = [*sf.LISTS.values(), "specific_reported_figures", "fromdate", "todate"]
SCHEMA = "name string, " + ", ".join(f"{c} string" for c in TEXTS)


def saved(spark, requests):
    return spark.createDataFrame([(n, *[r.get(c) for c in TEXTS]) for n, r in requests], SCHEMA)


def single(facts, request):
    return rows(parse_filter_params(request).apply(facts))


def facts(spark):
    r = random.Random(5)
    day = dt.date(1998, 1, 20)
    return spark.createDataFrame([(
        i, r.choice([1, 2, 3, None]), i % 7, r.choice(["Conflict", "Disaster", None]), r.choice(["Person", "Household"]),
        r.choice(["Displaced", "Evicted"]), r.choice(["MLI", "TCD", None]), r.choice(["a", "b"]),
        r.choice([None, 1, 5, 5, 90]), day + dt.timedelta(days=r.randrange(60)), i) for i in range(400)],
        "fact long, location long, gkg_id long, category string, unit string, term string, iso3 string,"
        " source_common_name string, specific_reported_figure int, gdelt_day date, location_ids_num long")


def requests():
    r = random.Random(8)

    def some(values, form="{%s}"):
        return r.choice([None, "", "{}", form % ",".join(r.sample(values, r.randint(1, len(values))))])

    out = [("none", {})]
    for i in range(60):
        out.append((f"r{i}", {
            "categories": some(["Conflict", "Disaster", "Nothing"]), "units": some(["Person", "Household"], " %s "),
            "terms": some(["Displaced", "Evicted"]), "iso3s": some(["MLI", "TCD"]),
            "source_common_names": some(["a", "b", "c"]), "location_ids": some(["1", "2", "3", "NULL", "77"]),
            "specific_reported_figures": some(["1", "5", "60", "null"]),
            "fromdate": r.choice([None, "1998-02-01", "2001-01-01"]), "todate": r.choice([None, "1998-02-25"])}))
    return out


def test_a_table_of_filters_equals_single_runs(spark):
    table, asked = facts(spark), requests()
    got = rows(sf.match_filters(table, saved(spark, asked)))
    want = [row + (name,) for name, request in asked for row in single(table, request)]
    assert got == sorted(want, key=lambda t: tuple((v is None, str(v)) for v in t)) and len(want) > 500
    counts = {r["name"]: r["n"] for r in sf.match_counts(table, saved(spark, asked)).collect()}
    assert counts == {name: len(single(table, request)) for name, request in asked} and 0 in counts.values()


def test_refused_repeated_and_missing(spark):
    table = facts(spark)
    asked = [("bad", {"categories": "{a,{b}"}), ("figure", {"specific_reported_figures": "many"}),
             ("place", {"location_ids": "Mali"}), ("day", {"fromdate": "yesterday"}),
             ("twice", {"units": "Person"}), ("twice", {"units": "{Person}"}), (None, {"units": "Person,Person"})]
    n = len(single(table, {"units": "Person"}))
    assert rows(sf.match_counts(table, saved(spark, asked)), "name", "refused", "n") == rows(spark.createDataFrame(
        [("bad", True, 0), ("figure", True, 0), ("place", True, 0), ("day", True, 0), ("twice", False, 2 * n),
         (None, False, n)], "name string, refused boolean, n long"))
    for name in ("bad", "figure"):
        with pytest.raises(ValueError):
            single(table, dict(asked)[name])
    bare = spark.createDataFrame([("x", "Person")], "name string, units string")  # other columns are absent
    assert rows(sf.match_counts(table, bare), "n") == [(n,)]


def test_empty_tables(spark):
    table = facts(spark)
    assert rows(sf.match_filters(table, saved(spark, []))) == []
    assert rows(sf.match_counts(table.limit(0), saved(spark, requests()[:3])), "n") == [(0,)] * 3


def test_a_filter_is_looked_up_by_its_rarest_dimension(spark):
    table = facts(spark)
    asked = saved(spark, [("x", {"units": "Person", "location_ids": "{77}", "fromdate": "1998-01-01"}), ("all", {})])
    filters = sf.typed_filters(asked).withColumn("filter", sf.F.xxhash64("name")).drop("refused")
    assert rows(sf._drivers(table, filters), "name", "dimension", "value") == [("all", "any", ""), ("x", "location", "77")]


@pytest.mark.parametrize("bounds", [0, 64])
def test_broad_filters_meet_cells_instead_of_facts(spark, monkeypatch, bounds):
    """Counts of filters that ask the same, with facts by the thousand, join no more rows than there are cells."""
    monkeypatch.setattr(sf, "BOUNDS", bounds)
    table, joined = facts(spark), []
    many = table.crossJoin(spark.range(20).toDF("copy")).withColumn("fact", sf.F.col("fact") * 20 + sf.F.col("copy"))
    met = sf._met
    monkeypatch.setattr(sf, "_met", lambda rows, filters, salt: joined.append((rows.count(), filters.count())) or met(
        rows, filters, salt))
    asked = [(f"f{i}", {"categories": "Conflict,Disaster" if i % 2 else "Disaster,Conflict", "units": "Person",
                        "specific_reported_figures": "1,60"}) for i in range(40)]
    asked += [(f"p{i}", {"location_ids": "{1,NULL}", "fromdate": "1998-02-01"}) for i in range(5)]
    counts = {r["name"]: r["n"] for r in sf.match_counts(many.drop("copy"), saved(spark, asked)).collect()}
    assert counts == {name: 20 * len(single(table, request)) for name, request in asked} and min(counts.values()) > 0
    assert [f for _, f in joined] == [1, 1] and max(n for n, _ in joined) < 4 * table.count()


def test_stored_marts(spark):
    api = context(spark, "/root/testdata/sf0.001").marts.fact_api
    request = {"categories": "Conflict", "location_ids": "{3,7,10}", "todate": "1998-06-01"}
    counts = sf.match_counts(api, saved(spark, [("x", request), ("all", {})]))
    assert rows(counts, "name", "n") == [("all", len(single(api, {}))), ("x", len(single(api, request)))]


@pytest.mark.parametrize("values", [0, 1000])
def test_many_filters_are_not_sent_to_all_tasks(spark, monkeypatch, values):
    """Filters beyond a number meet the facts in a shuffle, and only values of many pairs are dealt to several tasks."""
    monkeypatch.setattr(sf, "DRIVERS_SENT", 0)
    monkeypatch.setattr(sf, "VALUES_SENT", values)
    monkeypatch.setattr(sf, "PAIRS", 500)
    given, asked = facts(spark), saved(spark, requests()[:16])
    met = sf.match_filters(given, asked)
    got, want = rows(met.select("filter_name", *given.columns)), []
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 1
    for name, request in requests()[:16]:
        want += [(name, *r) for r in single(given, request)]
    assert got == sorted(want, key=lambda t: tuple((v is None, str(v)) for v in t))
    counts = {r["name"]: r["n"] for r in sf.match_counts(given, asked).collect()}
    assert counts == {n: sum(w[0] == n for w in want) for n, _ in requests()[:16]}
