"""Running sums within a row."""

import itertools
import time

from pyspark.sql import functions as F

from newsfacts.operators.extract import RUN, running_sums


def test_running_sums_of_any_length(spark):
    given = [None, [], [7], [3, 4, 5], *[list(range(n)) for n in (RUN - 1, RUN, RUN + 1, 2 * RUN, 5 * RUN + 3)]]
    df = spark.createDataFrame(list(enumerate(given)), "i int, n array<int>")
    got = {r["i"]: r["s"] for r in df.select("i", running_sums(F.transform("n", lambda x: x)).alias("s")).collect()}
    assert got == {i: list(itertools.accumulate(n or [])) for i, n in enumerate(given)}


def test_numbers_are_worked_out_once(spark):
    """Numbers that are an expression were worked out anew for every run of them, which is quadratic."""
    def seconds(n):
        words = spark.range(1, numPartitions=1).select(F.split(F.repeat(F.concat(F.lit("a "), F.col("id").cast("string"), F.lit(
            " ")), n // 2), " ").alias("w"))
        began = time.monotonic()
        last = words.select(F.element_at(running_sums(F.transform("w", F.length)), -1).alias("s")).first()["s"]
        assert last == n
        return time.monotonic() - began

    seconds(1000)
    short, long = seconds(40_000), seconds(240_000)
    print("seconds", short, long)
    assert long < 9 * short + 2
