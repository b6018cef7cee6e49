"""A corpus from raw documents to shards: five stages, each stored before the next one reads it."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsfacts.llm import decontaminate, mixing, ngram_join, sharding, toxicity
from newsfacts.llm.queries import remainder
from newsfacts.llm.store import aside, stored

#: Columns of documents.
DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def _guarded(stage):
    """The stage with columns beyond those of documents under names that no operator uses, and named back after it.

    A column that the stage adds replaces one of its name.
    """

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        renamed, back = aside(docs, DOCUMENT)
        out = stage(spark, renamed, sf_dir)
        added = {c.lower() for c in out.columns} - set(back)
        gone = [name for name, c in back.items() if c.lower() in added]
        return out.drop(*gone).withColumnsRenamed({name: c for name, c in back.items() if name not in gone})

    return run_stage


def _keyed(docs: DataFrame) -> DataFrame:
    """``_key`` stands in for null ids: a large number made of the text, so that given ids come first."""
    made = F.shiftrightunsigned(F.xxhash64("text"), 2) + F.lit(1 << 61)
    return docs.withColumn("_key", F.coalesce(F.col("doc_id").cast("long"), made))


@_guarded
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below 0.3. Learns from labelled rows that op5 learns from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    weights = toxicity.train(docs, labels, remainder("doc_id", 4) != 2)
    return toxicity.score(docs, weights, docs.columns).filter("score < 0.3").select(docs.columns)


@_guarded
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 0.8 over five words, the document with the smallest id.

    Documents without words are linked with nothing and stay. Of rows that repeat an id, equal ones are
    one document.
    """
    keyed = _keyed(docs)
    joined = stored(
        ngram_join.jaccard_join(keyed, id_col="_key").select("_key", "class_id", "component_id"), "pipeline-groups")
    gone = joined.filter("_key <> component_id").select("_key").distinct()
    kept = keyed.join(gone, "_key", "left_anti")
    repeated = joined.filter("class_id is not null").groupBy("_key", "class_id").count().filter("count > 1")
    if repeated.head(1):
        again = kept.join(repeated.select("_key").distinct(), "_key", "left_semi")
        kept = kept.join(repeated.select("_key").distinct(), "_key", "left_anti").unionByName(
            again.dropDuplicates(["_key", "text"]))
    return kept.select(docs.columns)


@_guarded
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of ten words of a benchmark item (no whole item, if it has fewer)."""
    keyed = _keyed(docs)
    found = decontaminate.contamination(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="_key")
    hit = stored(found.filter("n_hit > 0").select("_key").distinct(), "pipeline-hits")
    return keyed.join(hit, "_key", "left_anti").select(docs.columns)


@_guarded
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources to their targets; a document that is taken twice comes twice."""
    return mixing.mix(docs).select(docs.columns)


@_guarded
def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with shard and slot; copies of a document share a shard."""
    return sharding.shard(docs, 8)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
    ("sharding", assign_shards),
]

#: A trained classifier is not expressible in SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
