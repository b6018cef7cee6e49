"""The stored read model: versions, and refreshes of the months that changed."""

import datetime as dt
import os
from types import SimpleNamespace

import pytest
from helpers import rows

from newsfacts.plans import marts
from newsfacts.session import shared_dir
from newsfacts.sources.star import NewsTables

FACTS = [(1, "Person", 5), (2, "Person", 6), (3, "Household", None), (4, "Person", 7), (5, "Person", 8)]
BRIDGE = [(10, 1), (10, 2), (20, 2), (30, 3), (40, 4)]  # fact 5 has no article
GKG = [(10, 19980131174500), (20, 19980201174500), (30, 19980302174500), (40, 19980401174500)]
PLACES = [(1, 100), (2, 100), (2, 200), (3, 200), (4, 300), (5, 100), (5, None)]


def tables(spark, facts=FACTS, bridge=BRIDGE, gkg=GKG, places=PLACES):
    return SimpleNamespace(
        spark=spark,
        facts=spark.createDataFrame(
            [(i, u, "Displaced", n, None, "MLI") for i, u, n in facts], "id long, unit string, term string,"
            " specific_reported_figure int, vague_reported_figure string, iso3 string"),
        analysis_facts=spark.createDataFrame(bridge, "analysis long, fact long"),
        analyses=spark.createDataFrame(
            [(i, "Conflict", i, dt.datetime(2020, 1, 1)) for i, _ in gkg],
            "gkg_id long, category string, content_id long, updated timestamp_ntz"),
        gkg=spark.createDataFrame(
            [(i, d, f"http://a/{i}", "a") for i, d in gkg],
            "id long, date long, document_identifier string, source_common_name string"),
        fact_locations=spark.createDataFrame(places, "fact long, location long"),
        locations=spark.createDataFrame(
            [(100, "Mali", "1,2"), (200, "Chad", None), (300, "Peru", "3,4")],
            "id long, location_name string, latlong string"))


def state(m):
    """All marts with the members of a set in place of its id."""
    sets = {r["location_ids_num"]: tuple(r["location_ids"]) for r in m.fact_api_locations.collect()}
    api = sorted((r["fact"], r["gkg_id"], str(r["month"]), r["location"] or 0, sets[r["location_ids_num"]])
                 for r in m.fact_api.collect())
    return api, rows(m.fact_api_locations.drop("location_ids_num")), rows(m.map_week)


def folders(spark, m, mart="fact_api"):
    return {r[1]: r[2] for r in marts._manifest(spark, m.path, m.version) if r[0] == mart}


def changed(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "gkg_id long")


def test_one_month_changes_one_folder_and_readers_keep_their_version(spark, tmp_path):
    path = f"{tmp_path}/marts"
    first = marts.refresh_marts(tables(spark), path)
    before, ids = state(first), {r["fact"]: r["location_ids_num"] for r in first.fact_api_locations.collect()}
    assert len(before[0]) == 7 and len(before[1]) == 5
    new = tables(spark, places=PLACES + [(4, 100)])
    second = marts.refresh_changed(new, path, changed(spark, 40))
    assert second.version == first.version + 1
    assert state(second) == state(marts.refresh_marts(new, f"{tmp_path}/whole"))
    assert state(first) == before  # the frames opened before still show what they showed
    old, now = folders(spark, first), folders(spark, second)
    assert {m for m in now if now[m] != old[m]} == {"1998-04-01"}
    for mart in ("fact_api_locations", "map_week"):
        a, b = folders(spark, first, mart), folders(spark, second, mart)
        assert {m for m in b if b[m] != a[m]} == {"1998-04-01"}
    after = {r["fact"]: r["location_ids_num"] for r in second.fact_api_locations.collect()}
    assert {f: n for f, n in after.items() if f != 4} == {f: n for f, n in ids.items() if f != 4}
    assert after[4] > max(ids.values())


@pytest.mark.parametrize("new, ids", [
    (dict(places=[p for p in PLACES if p != (2, 200)]), [20]),  # a fact of two months
    (dict(bridge=[b for b in BRIDGE if b != (40, 4)]), [40]),  # a fact that lost its article
    (dict(bridge=BRIDGE + [(30, 5)]), [30]),  # a fact that got its first one
    (dict(gkg=[g for g in GKG if g[0] != 30] + [(30, 19980503174500)]), [30]),  # an article that moved
    (dict(gkg=[g for g in GKG if g[0] != 10], bridge=[b for b in BRIDGE if b[0] != 10]), [10]),  # one that went
    (dict(gkg=GKG + [(50, 19980402174500)], facts=FACTS + [(6, "Person", 1)], bridge=BRIDGE + [(50, 6)],
          places=PLACES + [(6, 300)]), [50]),  # one that came
])
def test_changes_give_what_a_whole_refresh_gives(spark, tmp_path, new, ids):
    path = f"{tmp_path}/marts"
    marts.refresh_marts(tables(spark), path)
    late = tables(spark, **new)
    assert state(marts.refresh_changed(late, path, changed(spark, *ids))) == state(
        marts.refresh_marts(late, f"{tmp_path}/whole"))


def test_no_change_no_version_and_broken_versions_are_not_seen(spark, tmp_path):
    path = f"{tmp_path}/marts"
    first = marts.refresh_changed(tables(spark), path, changed(spark))  # nothing stored: all months
    assert marts.refresh_changed(tables(spark), path, changed(spark)).version == first.version
    assert marts.refresh_changed(tables(spark), path, changed(spark, 999)).version == first.version
    (tmp_path / "marts/manifests/2").mkdir()
    assert marts.open_marts(spark, path).version == 1
    again = marts.refresh_changed(tables(spark), path, changed(spark, 10))
    assert again.version == 3 and state(again) == state(first)


def test_empty_tables(spark, tmp_path):
    none = marts.refresh_marts(tables(spark, [], [], [], []), f"{tmp_path}/marts")
    assert [len(x) for x in state(none)] == [0, 0, 0]
    filled = marts.refresh_changed(tables(spark), none.path, changed(spark, 10, 20, 30, 40))
    assert state(filled)[0] == state(marts.refresh_marts(tables(spark), f"{tmp_path}/whole"))[0]


def test_a_refresh_equals_its_parts_and_leaves_only_marts(spark, tmp_path):
    """Repeated places, articles and analyses, pairs without a place; what is stored on the way is deleted."""
    t = tables(spark, places=PLACES + [(1, None), (7, 200), (None, 100), (3, 999)], bridge=BRIDGE + [(20, 1), (99, 3)])
    t.locations = t.locations.union(t.locations.filter("id = 200").withColumn("location_name", marts.F.lit("Tchad")))
    t.gkg = t.gkg.union(t.gkg.filter("id = 30"))
    t.analyses = t.analyses.union(t.analyses.filter("gkg_id = 20").withColumn("category", marts.F.lit("Other"))).union(
        t.analyses.filter("gkg_id = 10").withColumn("category", marts.F.lit(None).cast("string")))
    folder = f"{shared_dir(spark)}/newsfacts"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    m = marts.refresh_marts(t, f"{tmp_path}/marts")
    assert not os.path.isdir(folder) or set(os.listdir(folder)) == before
    sets = marts.fact_api_locations(t.fact_locations, t.locations)
    assert rows(m.fact_api_locations) == rows(sets)
    api = marts.build_fact_api(t.facts, t.analysis_facts, t.analyses, t.gkg, t.fact_locations, sets)
    assert rows(m.fact_api, *api.columns) == rows(api) and api.count() > 10
    assert rows(m.map_week) == rows(marts.map_week(
        t.facts, t.fact_locations, t.locations, t.analysis_facts, t.analyses, t.gkg))


def test_few_places_or_many_give_the_same_sets(spark, tmp_path, monkeypatch):
    whole = state(marts.refresh_marts(tables(spark), f"{tmp_path}/a"))
    monkeypatch.setattr(marts, "PLACES_SENT", 0)
    assert state(marts.refresh_marts(tables(spark), f"{tmp_path}/b")) == whole


def test_changed_since(spark):
    got = marts.changed_since(tables(spark).analyses, marts.F.lit("2019-12-31").cast("timestamp_ntz"))
    assert rows(got) == [(10,), (20,), (30,), (40,)]


def test_pairs_are_shuffled_once(spark, tmp_path):
    """Distinct pairs lie by the key that the read model groups and joins them by."""
    lines = [(1, 3, 12, 1), (1, 3, 12, 1), (2, 4, 15, 1), (2, 11, 15, 2)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(
        f"{tmp_path}/lineitem.parquet")
    c = NewsTables(spark, str(tmp_path))
    assert c.fact_locations.count() == 3 and c.analysis_facts.count() == 3
    for pairs, key in ((c.fact_locations, "fact"), (c.analysis_facts, "analysis")):
        plan = pairs.groupBy(key).count()._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1
