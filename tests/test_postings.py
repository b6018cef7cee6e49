"""Text queries: the grammar, the stored index against a scan and against a plain evaluation, and what is read."""

import random
import re

import pytest
from pyspark.sql import functions as F

from newsfacts.functions import text as tx
from newsfacts.operators.filters import FactFilter
from newsfacts.operators.postings import And, Not, Or, Phrase, Word, parse_text_query, search, text_predicate, write_index

VOCABULARY = ["flood", "floods", "river", "camp", "the", "of", "aid", "aided", "road", "7"]


def phrase(*words):
    return Phrase(tuple(Word(w.removesuffix("*"), w.endswith("*")) for w in words))


@pytest.mark.parametrize("query, tree", [
    ("Flood", phrase("flood")), ("flood & !camp | aid", Or((And((phrase("flood"), Not(phrase("camp")))), phrase("aid")))),
    ("flood & (camp | aid:*)", And((phrase("flood"), Or((phrase("camp"), phrase("aid*")))))),
    ("river <-> of <-> aid", phrase("river", "of", "aid")), ("Katrina-hit roads", phrase("katrina", "hit", "roads")),
    ("the", None), ("the & flood", phrase("flood")), ("!(the | of) & camp", phrase("camp")), ("", None), (" - ", None),
    ("!!camp", Not(Not(phrase("camp")))), ("of:*", phrase("of*")), ("a<b", phrase("a", "b")),
])
def test_grammar(query, tree):
    assert parse_text_query(query) == tree


def holds(node, words):
    if isinstance(node, Not):
        return not holds(node.child, words)
    if isinstance(node, (And, Or)):
        return (all if isinstance(node, And) else any)(holds(c, words) for c in node.children)
    fits = [lambda t, w=w: t.startswith(w.text) if w.prefix else t == w.text for w in node.words]
    return any(all(f(t) for f, t in zip(fits, words[i:])) for i in range(len(words) - len(fits) + 1))


def test_index_equals_scan_and_plain_evaluation(spark, tmp_path):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(VOCABULARY) for _ in range(rng.randrange(0, 14))) for _ in range(120)] + [None, "", "Aid, aid!"]
    contents = spark.createDataFrame(list(enumerate(texts)), "id long, t string").select(
        "id", tx.token_text(F.col("t")).alias("token_text"))
    index = write_index(contents, f"{tmp_path}/index")

    def made(depth):
        kind = rng.randrange(6 if depth else 3)
        if kind < 2:
            return rng.choice(VOCABULARY) + rng.choice(["", "", ":*"])
        if kind == 2:
            return " <-> ".join(rng.choice(VOCABULARY) + rng.choice(["", "", "", ":*"]) for _ in range(rng.randrange(2, 4)))
        if kind == 3:
            return f"!({made(depth - 1)})"
        return "(" + rng.choice([" & ", " | "]).join(made(depth - 1) for _ in range(2)) + ")"

    for _ in range(25):
        query = made(2)
        tree = parse_text_query(query)
        want = sorted(i for i, t in enumerate(texts) if tree is not None and t is not None and holds(
            tree, re.findall("[a-z0-9]+", t.lower())))
        assert sorted(r["id"] for r in search(index, query).collect()) == want, query
        assert sorted(r["id"] for r in contents.filter(text_predicate(query, F.col("token_text"))).collect()) == want, query


def test_index_reads_only_what_is_asked(spark, tmp_path):
    contents = spark.createDataFrame([(1, " flood of aid "), (2, " river ")], "id long, token_text string")
    index = write_index(contents, f"{tmp_path}/index")
    plan = search(index, "flood & !aid")._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert scans and all("PartitionFilters: [isnotnull(head" in s and "EqualTo(term," in s for s in scans)
    assert all("places" not in s.split("ReadSchema")[1] for s in scans)  # no phrase, no places
    assert search(index, "snow & flood").count() == 0
    empty = write_index(contents.limit(0), f"{tmp_path}/empty")
    assert search(empty, "flood | !aid").count() == 0


def test_filter_takes_an_index(spark, tmp_path):
    contents = spark.createDataFrame([(1, " flood of aid "), (2, " river ")], "id long, token_text string")
    facts = spark.createDataFrame(
        [(i, i % 3, 1) for i in range(9)], "fact long, content_id long, specific_reported_figure int")
    index = write_index(contents, f"{tmp_path}/index")
    for query in ("flood", "!flood", "riv:* | aid", "the"):
        flt = FactFilter(ts=query)
        got, want = (sorted(r["fact"] for r in flt.apply(facts, c).collect()) for c in (index, contents))
        assert got == want
