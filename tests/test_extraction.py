"""Golden sentences and the pieces of extraction."""

import time

import pytest
from helpers import rows
from pyspark.sql import functions as F

from newsfacts import vocab
from newsfacts.functions import dates
from newsfacts.functions import lexicon as lx
from newsfacts.operators import extract as ex

PLACES = ["Bosnia", "London", "Middlesex", "Nigeria", "Guinea", "Guinea-Bissau"]
SENTENCES = {
    "houses": "Late on Monday a river burst its banks near the town and washed away more than 500 houses",
    "refugees": "Late on Monday armed men came to the camp and forced more than 20000 refugees to flee.",
    "evicted": "The landlord won in court, and 820 people were evicted across Bosnia before spring",
    "eviction": "Officials in Bosnia signed an eviction order against 640 people",
    "forced eviction": "Campaigners in Bosnia condemned the forced eviction of 275 people",
    "forcibly": "Soldiers in Bosnia forcibly evicted 910 people on Sunday night",
    "sacked": "A mining firm in Nigeria sacked 3300 people before the rains",
    "two places": "Late on Monday a river covered large parts of London and Middlesex and washed away more "
                  "than 500 houses",
    "far figure": "2000 mostly elderly and very poor rural farming villagers were displaced",
    "other clause": "In 2015, several very poor villagers were displaced",
    "other unit": "400 people saw that many houses were destroyed",
    "two units": "300 family homes were destroyed",
    "number only": "After the storm 300 were displaced.",
    "homeless": "Dozens of families were left homeless.",
    "lives": "The storm claimed 12 people and many lives.",
    "affected": "The earthquake affected 40 homes.",
    "affected, not relevant": "The decision affected 40 homes.",
    "none": "Nothing happened in Guinea-Bissau.",
}


@pytest.fixture(scope="module")
def facts(spark):
    names = list(SENTENCES)
    articles = spark.createDataFrame(
        [(i, SENTENCES[n]) for i, n in enumerate(names)], "gkg_id long, content_clean string"
    )
    gazetteer = spark.createDataFrame([(p,) for p in PLACES], "name string")
    found = ex.extract_facts(ex.split_sentences(articles, "gkg_id"), gazetteer)
    out = {n: [] for n in names}
    for r in found.collect():
        out[names[r["gkg_id"]]].append(r)
    return out


@pytest.mark.parametrize("name,unit,term,figure,places", [
    ("houses", "Household", "Displaced", 500, None),
    ("evicted", "Person", "Evicted", 820, ["Bosnia"]),
    ("eviction", "Person", "Evicted", 640, ["Bosnia"]),
    ("forced eviction", "Person", "Evicted", 275, ["Bosnia"]),
    ("forcibly", "Person", "Evicted", 910, ["Bosnia"]),
    ("sacked", "Person", "Sacked", 3300, ["Nigeria"]),
    ("two places", "Household", "Displaced", 500, ["London", "Middlesex"]),
    ("number only", "Person", "Displaced", 300, None),
    ("affected", "Household", "Displaced", 40, None),
    ("far figure", "Person", "Displaced", 2000, None),
    ("other clause", "Person", "Displaced", None, None),
])
def test_one_fact(facts, name, unit, term, figure, places):
    (fact,) = facts[name]
    assert (fact.unit, fact.term, fact.specific_reported_figure, fact.locations) == (unit, term, figure, places)


def test_figures_stay_with_their_unit(facts):
    (fact,) = facts["two units"]
    assert fact.specific_reported_figure == 300
    assert [f.specific_reported_figure for f in facts["other unit"] if f.unit == "Household"] == [None]


def test_refugee_unit_decides(facts):
    assert {f.term for f in facts["refugees"]} == {"Refugee"}


def test_vague_figure(facts):
    (fact,) = facts["homeless"]
    assert (fact.unit, fact.term, fact.specific_reported_figure, fact.vague_reported_figure) == (
        "Household", "Homeless", None, "Dozens")


def test_no_fact(facts):
    assert facts["none"] == [] and facts["affected, not relevant"] == []


def test_spans_point_into_the_text(facts):
    (fact,) = facts["two places"]
    text = SENTENCES["two places"]
    assert [(s.type, text[s.start:s.end]) for s in fact.tag_spans] == [
        ("term", "washed"), ("quantity", "500"), ("loc", "London"), ("loc", "Middlesex")]


def test_longest_place_wins(spark):
    d = spark.createDataFrame([(1, "Heavy rain in Guinea-Bissau and Guinea.")], "k int, sentence string")
    g = spark.createDataFrame([(p,) for p in PLACES], "name string")
    (row,) = ex.location_match(ex.tokenise(d), g, ["k"]).collect()
    assert row.locations == ["Guinea-Bissau", "Guinea"]


def test_place_names_of_any_length(spark):
    names = ["Congo", "Democratic Republic of the Congo", "Saint Vincent and the Grenadines", "Saint Vincent",
             "United Kingdom", "United Kingdom of Great Britain and Northern Ireland", "Ireland"]
    texts = ["Rain in Saint Vincent and the Grenadines, Saint Vincent and Congo.",
             "From Democratic Republic of the Congo to Ireland.",
             "United Kingdom of Great Britain and Northern Ireland; United Kingdom of Great Britain.",
             "nothing here", "", None]
    d = spark.createDataFrame(list(enumerate(texts)), "k int, sentence string")
    g = spark.createDataFrame([(n,) for n in [*names, "", None]], "name string")
    found = {r.k: r for r in ex.location_match(ex.tokenise(d), g, ["k"]).collect()}
    assert {k: r.locations for k, r in found.items()} == {
        0: [names[2], "Saint Vincent", "Congo"], 1: [names[1], "Ireland"], 2: [names[5], "United Kingdom"]}
    for k, r in found.items():
        assert [texts[k][s.start:s.end] for s in r.loc_spans] == r.locations
    none = spark.createDataFrame([], "name string")
    assert ex.location_match(ex.tokenise(d), none, ["k"]).count() == 0


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1000, 70000])
def test_running_sums(spark, n):
    d = spark.range(1).select(F.slice(F.transform(F.sequence(F.lit(1), F.lit(70000)), lambda x: x % 7), 1, n)
                              .cast("array<int>").alias("x"))
    total, want = 0, []
    for i in range(1, n + 1):
        total += i % 7
        want.append(total)
    assert d.select(ex.running_sums(F.col("x"))).first()[0] == want


def test_long_texts_take_linear_time(spark):
    """Four times the tokens, well below sixteen times the time."""
    g = spark.createDataFrame([("Bosnia",), ("New Town on Sea",)], "name string")

    def seconds(n):
        d = spark.createDataFrame([(1, "Bosnia New Town " * (n // 3))], "k int, sentence string")
        d = d.withColumn("sent_start", F.lit(0))
        began = time.monotonic()
        assert ex.tokens_with_offsets(d).count() == n // 3 * 3
        (row,) = ex.location_match(ex.tokenise(d), g, ["k"]).collect()
        assert len(row.locations) == n // 3
        return time.monotonic() - began

    seconds(300)
    short, long = seconds(20_000), seconds(80_000)
    print("seconds", short, long)
    assert long < 8 * short + 2


def test_place_of_an_earlier_sentence(spark):
    text = "A storm hit Bosnia. 20 people were evacuated. In London 30 people fled. 5 people fled."
    d = spark.createDataFrame([(1, text)], "gkg_id int, content_clean string")
    g = spark.createDataFrame([(p,) for p in PLACES], "name string")
    found = ex.extract_facts(ex.split_sentences(d, "gkg_id"), g)
    assert rows(found, "specific_reported_figure", "locations") == [
        (20, ["Bosnia"]), (30, ["London"]), (5, ["London"])]


def test_sentence_offsets(spark):
    text = "One. Two people! Three? no. \"Four\" five."
    d = spark.createDataFrame([(1, text)], "id int, content_clean string")
    parts = ex.split_sentences(d).orderBy("sent_no").collect()
    assert [text[p.sent_start:p.sent_start + len(p.sentence)] for p in parts] == [p.sentence for p in parts]
    assert len(parts) == 4


def test_multi_word_keywords_fall_apart():
    assert "relief" in lx.Lexicon().lemmas(vocab.PERSON_TERM)
    assert lx.Lexicon().joint_terms() == ["evacuate"]


@pytest.mark.parametrize("phrase,want", [
    ("yesterday", "2017-02-14"), ("today", "2017-02-15"), ("last week", "2017-02-08"),
    ("Monday", "2017-02-13"), ("Wednesday", "2017-02-08"), ("last Monday", "2017-02-13"),
    ("3 days ago", "2017-02-12"), ("two weeks ago", "2017-02-01"), ("March 3", "2016-03-03"),
    ("January 3", "2017-01-03"), ("14 February 2016", "2016-02-14"), ("gibberish", None),
])
def test_date_phrases(spark, phrase, want):
    d = spark.createDataFrame([(phrase,)], "p string")
    (row,) = d.select(dates.resolve_relative_date(
        F.col("p"), F.lit("2017-02-15").cast("date")).cast("string").alias("d")).collect()
    assert row.d == want


@pytest.mark.parametrize("token,like,value", [
    ("500", True, 500), ("2,500", True, 2500), ("twenty-one", True, 21), ("Fifty", True, 50),
    ("dozens", True, None), ("house", False, None), ("3/4", True, None),
])
def test_numbers(spark, token, like, value):
    d = spark.createDataFrame([(token,)], "t string")
    assert d.select(lx.number_like(F.col("t")), lx.number_value(F.col("t"))).first() == (like, value)


def test_dates_after_publication_keep_their_weekday(spark):
    days = spark.range(1, 41).select(F.col("id").alias("ahead"), F.to_date(F.lit("2017-03-15")).alias("pub")).select(
        "ahead", F.datediff(dates.roll_back(
            F.date_add("pub", F.col("ahead").cast("int")), F.col("pub"), F.lit("friday")), "pub").alias("got"))
    got = {r["ahead"]: r["got"] for r in days.collect()}
    assert all(v < 0 and (k - v) % 7 == 0 for k, v in got.items())
    assert [got[k] for k in (1, 3, 6, 7, 8, 10, 13, 14, 15, 21)] == [-6, -4, -1, -7, -13, -11, -8, -14, -20, -21]


def test_units_and_quantities_are_worked_out_once(spark):
    """A filter on a column that is worked out by lambdas would work it out again."""
    lexicon = lx.Lexicon()
    found = ex.reports(ex.with_lemmas(ex.tokenise(spark.createDataFrame(
        [(1, "Some 300 people were displaced", 0)], "id int, sentence string, sent_start int")), lexicon), lexicon)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("array_min") == 1
    assert [(r["unit"], r["specific_reported_figure"]) for r in found.collect()] == [("Person", 300)]


def test_only_articles_with_an_unsure_term_need_a_keyword(spark):
    """A term that counts only in relevant articles is kept by a keyword anywhere in the article."""
    rows_ = [(1, 0, "Floods affected 300 people", 0), (1, 1, "Some 20 people were displaced", 30),
             (2, 0, "Floods affected 40 people", 0), (2, 1, "All were refugees", 30), (3, 0, "Nothing", 0)]
    sentences = spark.createDataFrame(rows_, "gkg_id int, sent_no int, sentence string, sent_start int")
    lexicon = lx.Lexicon(vocab.SEED_KEYWORDS | {vocab.ARTICLE_KEYWORD: ["refugee"]})
    found = ex.extract_facts(sentences, spark.createDataFrame([("Mali",)], "name string"), lexicon)
    assert sorted((r["gkg_id"], r["sent_no"]) for r in found.collect()) == [(1, 1), (2, 0)]


@pytest.mark.parametrize("short", [0, 3, 1000])
def test_offsets_of_places_in_short_and_long_sentences(spark, monkeypatch, short):
    monkeypatch.setattr(ex, "SHORT", short)
    text = "In  Mali, near Lake Chad and (Mali) "
    places = ex.location_match(ex.tokenise(spark.createDataFrame([(1, text)], "id int, sentence string")),
                               spark.createDataFrame([("Mali",), ("Lake Chad",), ("Chad",)], "name string"), ["id"])
    found = places.first()
    assert found["locations"] == ["Mali", "Lake Chad", "Mali"]
    assert [text[s["start"]:s["end"]] for s in found["loc_spans"]] == found["locations"]
