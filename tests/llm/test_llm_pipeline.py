"""The pipeline's stages, each against a plain version on its own input."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from newsfacts.llm import mixing, toxicity
from newsfacts.llm.queries import remainder

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.stored(stage(spark, docs, SF), "test-stage")
        out.append((docs, after))
        docs = after
    return out


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_toxic_documents_go(spark, steps):
    before, after = steps[0]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    weights = toxicity.train(before, labels, remainder("doc_id", 4) != 2)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(before, weights, ["doc_id"]).collect()}
    assert ids(after) == {d for d, s in scores.items() if s < 0.3}
    assert after.columns == before.columns


def test_one_of_each_group_stays(steps):
    before, after = steps[1]
    rows = [(r["doc_id"], words(r["text"])) for r in before.collect()]
    sets = {d: {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set() for d, w in rows}
    low = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if low[a] < low[b] and sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                    low[b], changed = low[a], True
    assert ids(after) == {d for d in sets if low[d] == d}


def test_contaminated_documents_go(spark, steps):
    before, after = steps[2]
    pattern = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = pattern.findall(r["text"].encode().lower())
        windows |= {tuple(w[i:i + 10]) for i in range(max(1, len(w) - 9))}
    kept = set()
    for r in before.collect():
        w = pattern.findall(r["text"].encode().lower())
        if not any(tuple(w[i:i + 10]) in windows for i in range(len(w) - 9)):
            kept.add(r["doc_id"])
    assert ids(after) == kept


def test_mix_and_shards(steps):
    before, after = steps[3]
    taken = {r["doc_id"]: len(r["shards"]) for r in mixing.draws(before).collect()}
    got = {r["doc_id"]: r["count"] for r in after.groupBy("doc_id").count().collect()}
    assert got == {d: n for d, n in taken.items() if n}
    final = steps[4][1]
    assert final.count() == after.count() and set(after.columns) < set(final.columns)


def test_stages_on_hard_rows(spark, hard):
    docs = hard.selectExpr("doc_id", "text", "'en' as lang", "source", "length(text) as n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, SF), "test-hard")
    assert docs.count() > 0


def test_stages_keep_columns_named_like_their_own(spark, steps):
    names = ["score", "_text", "_key", "component_id", "before", "copy", "id", "h", "start"]
    docs = steps[0][0].limit(60).withColumns({c: F.lit(c) for c in names})
    plain = steps[0][0].limit(60)
    for _, stage in corpus_pipeline.STAGES:
        docs, plain = (corpus_pipeline.stored(stage(spark, d, SF), "test-clash") for d in (docs, plain))
        assert sorted(map(str, docs.select(plain.columns).collect())) == sorted(map(str, plain.collect()))
        assert all(r[c] == c for r in docs.select(names).collect() for c in names)
