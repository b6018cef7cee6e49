"""Language by full profiles, names as whole words, and the page of a listing."""

import collections
import datetime as dt
import math

from helpers import rows

from newsfacts.operators import listing, words

TEXTS = [
    (1, "en", "the children went to the harbour with the others"), (2, "en", "there were thirteen of them at the gate"),
    (3, "de", "der Hafen war geschlossen und der Weg versperrt"), (4, "de", "die Kinder gingen mit den anderen"),
    (5, None, "the gate of the harbour"), (6, None, "und die anderen Kinder"), (7, None, "ЖЩЪ ЖЩЪ"), (8, None, ""),
    (9, None, None), (10, None, "the gate of the harbour"), (11, "en", "the harbour")]


def test_language_is_the_likeliest(spark):
    docs = spark.createDataFrame(TEXTS, "id long, lang string, text string")
    got = dict(rows(words.detect_language(docs, "text", words.language_profiles(docs, "text", "lang")), "id", "detected"))

    def grams(text):
        return [text.lower()[i:i + 3] for i in range(len(text or "") - 2)]

    counts = collections.defaultdict(collections.Counter)
    for _, lang, text in TEXTS:
        if lang:
            counts[lang].update(grams(text))
    known = len(set().union(*counts.values()))
    want = {}
    for key, _, text in TEXTS:
        scores = {}
        for lang, own in counts.items():
            if any(g in own for g in grams(text)):
                mass = math.log(sum(own.values()) + known + 1)
                scores[lang] = sum(math.log(own[g] + 1) - mass for g in grams(text))
        want[key] = max(sorted(scores), key=scores.get) if scores else None
    assert got == want
    assert (got[5], got[6], got[7], got[8], got[9]) == ("en", "de", None, None, None)


def test_profiles_are_whole(spark):
    long = [(1, "x", "".join(chr(0x4E00 + i) for i in range(2000)))]
    docs = spark.createDataFrame(long, "id long, lang string, text string")
    assert words.language_profiles(docs, "text", "lang").count() == 1998


def test_trigrams_are_counted_within_the_text(spark):
    """One row for each trigram of a text, not for each of its characters; beyond 16 bits too."""
    texts = [("a", "na " * 5000), ("b", "\U0001F600 \n\tx\U0001F600"), ("c", "no"), ("d", None)]
    counts = words.trigram_counts(spark.createDataFrame(texts, "key string, text string"))
    got = rows(counts.select("key", words._gram_text(words.F.col("gram")), "n"))
    assert got == sorted([("a", "na ", 5000), ("a", "a n", 4999), ("a", " na", 4999), ("b", "\U0001F600 x", 1),
                          ("b", " x\U0001F600", 1)])
    assert rows(counts.select((words._gram_code(words._gram_text(words.F.col("gram"))) == words.F.col("gram")).alias(
        "same")).distinct()) == [(True,)]


def test_names_are_replaced_as_whole_words(spark):
    places = spark.createDataFrame([("Niger", "country"), ("Nigeria", "country"), ("Port Hale", "city")],
                                   "name string, kind string")
    said = [(1, "Nigerian families left Niger."), (2, "In Port Hale 300 fled to Nigeria, not to Port Halesworth.")]
    got = words.generalise_entities(spark.createDataFrame(said, "id long, sentence string"), places, ["id"])
    assert dict(rows(got, "id", "text")) == {
        1: "Nigerian families left Switzerland.",
        2: "In Geneva 1000 fled to Switzerland, not to Port Halesworth."}


def test_a_page_of_facts_lists_article_and_excerpt(spark):
    day = dt.date(1998, 1, 1)
    facts = spark.createDataFrame(
        [(f, day + dt.timedelta(days=g), g, loc, g) for f, g, loc in [(1, 1, 5), (2, 1, 5), (2, 2, 6), (3, 9, 5), (4, 2, 6)]],
        "fact long, gdelt_day date, gkg_id long, location long, content_id long").withColumns({
            c: words.F.lit("x") for c in ("document_identifier", "source_common_name", "unit", "term", "iso3", "category",
                                          "specific_reported_figure", "vague_reported_figure", "location_ids_num")})
    sets = spark.createDataFrame([(f, [5], ["Mali"]) for f in range(1, 5)],
                                 "fact long, location_ids array<long>, location_names array<string>")
    analyses = spark.createDataFrame([(1, "One", None), (2, "Two", "B")], "gkg_id long, title string, authors string")
    contents = spark.createDataFrame([(1, "a"), (2, "b")], "id long, content_clean string")  # none for article 9
    validation = spark.createDataFrame([(2, "verified", None, None, "me")],
                                       "fact_id long, status string, missing string, wrong string, assigned_to string")
    values = spark.createDataFrame([("verified", "green")], "key_value string, display_color string")
    details = spark.createDataFrame([(f, 10 * f, 10 * f + 5) for f in range(1, 5)],
                                    "id long, excerpt_start int, excerpt_end int")

    def page(limit, offset):
        listed = listing.url_list(facts, sets, analyses, contents, validation, values, limit, offset, details)
        return rows(listed, "fact", "title", "authors", "excerpt_start", "status")

    assert page(2, 0) == [(1, "One", None, 10, None), (2, "One", None, 20, "verified")]
    assert page(2, 2) == [(4, "Two", "B", 40, None)] and page(2, 4) == []


def test_few_collocations_are_sent_to_the_positions(spark):
    docs = spark.createDataFrame([(i, ["new", "york", f"w{i}", f"v{i}"]) for i in range(60)], "id int, terms array<string>")
    found = words.ngrams(docs, "id", "terms", threshold=0.5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and all("BroadcastHashJoin" in line for line in plan.split("\n") if "LeftSemi" in line)
    assert rows(found) == [(i, ["new_york", f"w{i}", f"v{i}"]) for i in sorted(range(60), key=str)]
