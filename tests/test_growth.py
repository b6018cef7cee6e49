"""How the work of shared steps is dealt over tasks."""

from helpers import rows
from pyspark.sql import functions as F

from newsfacts.catalog import mining
from newsfacts.functions import text as tx
from newsfacts.operators.keys import dealt, shares
from newsfacts.sources.star import NewsTables


def parts(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_contents_of_one_row_group_are_cleaned_in_many_tasks(spark, tmp_path):
    texts = spark.range(40).select(F.col("id").alias("doc_id"), F.when(F.col("id") != 7, F.concat(
        F.lit("Rain  fell on 3 4 towns "), F.repeat(F.lit("again "), 40_000), F.col("id").cast("string"))).alias("text"))
    texts.union(texts.filter("doc_id = 3")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    contents = NewsTables(spark, str(tmp_path)).contents
    assert parts(contents) > 1
    clean = texts.union(texts.filter("doc_id = 3")).select("doc_id", tx.cleanup_text(F.col("text")).alias("c"))
    assert rows(contents, "id", "content_clean") == rows(clean)


def test_rows_are_dealt_by_the_size_of_their_text(spark):
    df = spark.createDataFrame([(i, "x" * 10) for i in range(100)] + [(None, None)], "id long, t string").coalesce(1)
    spread = dealt(df, shares(df, "t", 100))
    assert spread.rdd.getNumPartitions() == 10 and parts(spread) > 5
    assert rows(spread) == rows(df) and shares(df, "t") == 1 and shares(df.limit(0), "t") == 1
    assert dealt(df, 1).rdd.getNumPartitions() == 1


def test_models_read_terms_of_one_row_group_in_many_tasks(spark, tmp_path):
    texts = spark.range(20).select(F.col("id").alias("doc_id"), F.concat(F.lit("rain flood "), F.repeat(
        F.lit("river "), 200_000), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias(
            "source"))
    texts.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    terms = mining._dealt_pos(NewsTables(spark, str(tmp_path)))
    assert parts(terms) > 1
    assert rows(terms.select("doc_id", F.size("terms").alias("n"))) == [(i, 200_002) for i in sorted(range(20), key=str)]
