"""A table of saved filters matched against the facts in one job.

A filter is looked up by its most selective dimension only: the one whose wanted values occur in the fewest facts.
Facts join on that dimension's values, and the rest of the filter is tested on the joined row. So a filter that
names a common category and a rare place costs as many rows as the place has, however many filters there are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsfacts.operators.filters import parse_list_column
from newsfacts.session import written

# Fact column to filter column.
LISTS = {
    "category": "categories", "unit": "units", "term": "terms", "iso3": "iso3s",
    "source_common_name": "source_common_names", "location": "location_ids",
}
# Up to this many rows of filters (a filter and a value) are sent to all tasks; more of them meet the facts by a shuffle.
DRIVERS_SENT = 50_000
# Up to this many values are sent to all tasks, so that only facts of them are shuffled.
VALUES_SENT = 1 << 18
# In a shuffle, pairs of a fact and a filter of one value that one task tests; a value with more is dealt to several.
PAIRS = 1 << 22
# Values that are dealt to several tasks, those of most pairs.
DEALT = 10_000
_NO_PLACE = "NULL"
# Up to this many bounds of dates or figures, cells hold what lies between two bounds; beyond it, single values.
BOUNDS = 64


def _present(text: str) -> Column:
    return ~F.coalesce(F.trim(text), F.lit("")).isin("", "{}")


def typed_filters(saved: DataFrame) -> DataFrame:
    """``saved`` (name and texts as in a request) with dates, lists and a range of figures.

    Missing columns, NULLs, empty texts and ``{}`` mean no filter. A list that :func:`parse_list` would refuse, or a
    figure or place that is neither a number nor NULL, makes the filter ``refused``: it matches nothing.
    """
    asked = [*LISTS.values(), "specific_reported_figures", "fromdate", "todate"]
    texts = saved.select("name", *[
        (F.col(c).cast("string") if c in saved.columns else F.lit(None).cast("string")).alias(c) for c in asked])
    lists = [*LISTS.values(), "specific_reported_figures"]
    parsed = texts.select(
        "name", *[parse_list_column(F.col(c)).alias(c) for c in lists],
        *[F.try_to_date(c).alias(c) for c in ("fromdate", "todate")],
        reduce(Column.__or__, [
            *[_present(c) & parse_list_column(F.col(c)).isNull() for c in lists],
            *[_present(c) & F.try_to_date(c).isNull() for c in ("fromdate", "todate")]]).alias("refused"))

    def is_null(v):
        return v.isin("NULL", "null")

    def number(v):
        return v.try_cast("long")

    numeric = ("specific_reported_figures", "location_ids")
    bad = [F.coalesce(F.exists(c, lambda v: ~is_null(v) & number(v).isNull()), F.lit(False)) for c in numeric]
    figures = F.transform(F.filter("specific_reported_figures", lambda v: ~is_null(v)), number)
    return parsed.select(
        "name", "fromdate", "todate", (F.col("refused") | reduce(Column.__or__, bad)).alias("refused"),
        *[F.array_distinct(c).alias(c) for c in LISTS.values() if c != "location_ids"],
        F.array_distinct(F.transform("location_ids", lambda v: F.when(is_null(v), F.lit(_NO_PLACE)).otherwise(
            number(v).cast("string")))).alias("location_ids"),
        F.array_min(figures).alias("least"), F.array_max(figures).alias("greatest"),
        F.exists("specific_reported_figures", is_null).alias("null_figure"),
        F.col("specific_reported_figures").isNotNull().alias("any_figure"))


def _value(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(_NO_PLACE)) if column == "location" else F.col(column)


def _fact_keys(dimensions: list[str]) -> Column:
    """One (dimension, value) per dimension of a fact row."""
    def value(d):
        if d == "any":
            return F.lit("")
        return F.trunc("gdelt_day", "month").cast("string") if d == "month" else _value(d)
    return F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), value(d).alias("value")) for d in dimensions]))


def _drivers(facts: DataFrame, filters: DataFrame) -> DataFrame:
    """Each filter with the values of its most selective dimension, one row per value.

    A filter without lists and dates has the dimension ``any``.
    """
    span = facts.agg(F.min("gdelt_day").alias("a"), F.max("gdelt_day").alias("z")).first()
    first = F.greatest(F.col("fromdate"), F.lit(span["a"]).cast("date"))  # ignores NULLs
    last = F.least(F.col("todate"), F.lit(span["z"]).cast("date"))
    dated = F.col("fromdate").isNotNull() | F.col("todate").isNotNull()
    months = F.when(first <= last, F.transform(
        F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("interval 1 month")),
        lambda m: m.cast("string"))).otherwise(F.array().cast("array<string>"))
    keyed = filters.withColumn("dimensions", F.filter(F.array(
        *[F.struct(F.lit(d).alias("dimension"), F.col(c).alias("values")) for d, c in LISTS.items()],
        F.struct(F.lit("month").alias("dimension"), F.when(dated, months).alias("values"))),
        lambda d: d["values"].isNotNull()))
    wanted = keyed.select("filter", F.inline("dimensions")).select(
        "filter", "dimension", F.explode_outer("values").alias("value"))
    # Sizes only of dimensions that some filter asks for: the facts are counted by value within each task first.
    asked = [r["dimension"] for r in wanted.select("dimension").distinct().collect()]  # at most seven names
    sizes = facts.select(_fact_keys(sorted(asked) or ["any"])).select("col.*").groupBy("dimension", "value").agg(
        F.count(F.lit(1)).alias("n"))
    cost = wanted.join(sizes, ["dimension", "value"], "left").groupBy("filter", "dimension").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("cost"))
    best = cost.groupBy("filter").agg(F.min_by("dimension", F.struct("cost", "dimension")).alias("dimension"))
    chosen = keyed.join(best, "filter", "left").withColumn("dimension", F.coalesce("dimension", F.lit("any")))
    values = F.filter("dimensions", lambda d: d["dimension"] == F.col("dimension"))[0]["values"]
    # The joined values need no second test, so the list is not carried along.
    rest = [F.when(F.col("dimension") != d, F.col(c)).alias(c) for d, c in LISTS.items()]
    return chosen.withColumn("value", F.explode(F.when(
        F.col("dimension") == "any", F.array(F.lit(""))).otherwise(values))).select(
        *[c for c in filters.columns if c not in LISTS.values()], *rest, "dimension", "value")


def _holds(driver: str) -> Column:
    """Whether a row of facts meets the filter joined to it, a struct named ``driver``."""
    def f(c):
        return F.col(f"{driver}.{c}")
    tests = [f(c).isNull() | F.array_contains(f(c), _value(d)) for d, c in LISTS.items()]
    figure = F.col("specific_reported_figure")
    tests.append(f("fromdate").isNull() | (F.col("gdelt_day") >= f("fromdate")))
    tests.append(f("todate").isNull() | (F.col("gdelt_day") <= f("todate")))
    tests.append(F.when(~f("any_figure"), figure.isNotNull()).otherwise(
        F.coalesce(figure.between(f("least"), f("greatest")), F.lit(False)) | (f("null_figure") & figure.isNull())))
    return F.coalesce(reduce(Column.__and__, tests), F.lit(False))


def _dealt(left: DataFrame, right: DataFrame, drivers: DataFrame, salt: Column) -> tuple:
    """Both sides of a shuffled join with a number of the part of their value: facts are in one part, filters in all.

    Nearly all values are one part. Only a value of many facts and many filters, which would be one long task, has more.
    """
    by = ["dimension", "value"]
    sizes = left.select("_key.*").groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    pairs = F.col("m") * F.coalesce("n", F.lit(0))
    values = written(drivers.groupBy(*by).agg(F.count(F.lit(1)).alias("m")).join(sizes, by, "left").select(
        *by, pairs.alias("pairs"), F.greatest(F.ceil(pairs / PAIRS), F.lit(1)).cast("int").alias("_parts")), "values")
    few = values.count() <= VALUES_SENT
    most = values.filter("_parts > 1").orderBy(F.desc("pairs"), *by).limit(DEALT)

    def parted(df: DataFrame, key: str, values: DataFrame, how: str) -> DataFrame:
        known = values.select(F.col("dimension").alias("_d"), F.col("value").alias("_v"), "_parts")
        return df.join(F.broadcast(known), (F.col(f"{key}.dimension") == F.col("_d")) & (F.col(f"{key}.value") == F.col("_v")),
                       how).withColumn("_parts", F.coalesce("_parts", F.lit(1))).drop("_d", "_v")

    table = values if few else most
    left = parted(left, "_key", table, "inner" if few else "left").withColumn(
        "_part", F.pmod(salt, F.col("_parts")).cast("int")).drop("_parts")
    right = parted(right, "_filter", table, "left").withColumn(
        "_p", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return left, right


def _met(facts: DataFrame, filters: DataFrame, salt: Column) -> DataFrame | None:
    """Rows of ``facts``, each with the ``_filter`` that it meets, a struct; None if there is no filter to meet."""
    drivers = written(_drivers(facts, filters), "filter-drivers")  # a row per filter and value, read several times
    used = sorted(r["dimension"] for r in drivers.select("dimension").distinct().collect())  # at most eight names
    if not used:
        return None
    left = facts.select("*", _fact_keys(used).alias("_key"))
    right = drivers.select(F.struct("*").alias("_filter"))
    same = (F.col("_key.dimension") == F.col("_filter.dimension")) & (F.col("_key.value") == F.col("_filter.value"))
    if drivers.count() <= DRIVERS_SENT:
        joined = left.join(F.broadcast(right), same)
    else:
        left, right = _dealt(left, right, drivers, salt)
        joined = left.join(right.hint("merge"), same & (F.col("_part") == F.col("_p")))
    return joined.filter(_holds("_filter")).select(*[F.col(f"`{c}`") for c in facts.columns], "_filter")


def match_filters(facts: DataFrame, saved: DataFrame) -> DataFrame:
    """Rows of ``facts`` with the ``filter_name`` of each saved filter that they meet.

    ``saved`` has a ``name`` and the list and date texts of a request (see ``parse_filter_params``); text filters
    and set ids are not part of it. Each row of ``saved`` counts for itself, also under a repeated name. Fact columns
    come back as they are, and only those that are asked of the result or tested are moved. Refused filters match
    nothing.
    """
    filters = typed_filters(saved).filter(~F.col("refused")).drop("refused").withColumn(
        "filter", F.xxhash64(F.struct("*")))
    # Equal rows become one with a count, so that a filter has one key.
    filters = filters.groupBy(*filters.columns).agg(F.count(F.lit(1)).alias("times"))
    met = _met(facts, filters, F.xxhash64("fact", "location", "gkg_id"))
    if met is None:
        return facts.select("*", F.lit(None).cast("string").alias("filter_name")).limit(0)
    return met.withColumn("filter_name", F.explode(
        F.array_repeat("_filter.name", F.col("_filter.times").cast("int")))).drop("_filter")


def _between(column: str, lower: list, upper: list) -> Column:
    """Number of the stretch of values that no bound parts; with too many bounds, the value itself."""
    if len(lower) + len(upper) > BOUNDS:
        return F.col(column)
    steps = [(F.col(column) >= v).cast("int") for v in lower] + [(F.col(column) > v).cast("int") for v in upper]
    return F.when(F.col(column).isNotNull(), reduce(Column.__add__, steps, F.lit(0)))


def _cells(facts: DataFrame, filters: DataFrame) -> DataFrame:
    """Facts that no filter tells apart as one row with their number ``n``.

    Day and figure of a cell are the least of its facts: the bounds of all filters part them from others alike.
    """
    used = filters.agg(*[F.bool_or(F.col(c).isNotNull()).alias(d) for d, c in LISTS.items()]).first()

    def bounds(column: str) -> list:  # at most one more than those that are used
        return [r[0] for r in filters.select(column).filter(F.col(column).isNotNull()).distinct().limit(BOUNDS + 1).collect()]

    day = _between("gdelt_day", bounds("fromdate"), bounds("todate"))
    figure = _between("specific_reported_figure", bounds("least"), bounds("greatest"))
    keys = [(F.col(d) if used[d] else F.lit(None).cast("string")).alias(d) for d in LISTS]
    return facts.groupBy(*keys, day.alias("_day"), figure.alias("_figure")).agg(
        F.min("gdelt_day").alias("gdelt_day"), F.min("specific_reported_figure").alias("specific_reported_figure"),
        F.count(F.lit(1)).alias("n"))


def match_counts(facts: DataFrame, saved: DataFrame) -> DataFrame:
    """(name, refused, n): matching fact rows of every saved filter, 0 where there are none."""
    typed = typed_filters(saved)
    named = typed.groupBy("name").agg(F.bool_or("refused").alias("refused"))
    lists = list(LISTS.values())
    asked = typed.filter(~F.col("refused")).drop("refused").withColumns({c: F.array_sort(c) for c in lists})
    asked = written(asked.withColumn("filter", F.xxhash64(F.struct(*[c for c in asked.columns if c != "name"]))), "asked")
    filters = asked.drop("name").dropDuplicates(["filter"])
    cells = written(_cells(facts, filters), "cells")
    bare = cells.withColumn("location", F.lit(None).cast("string")).groupBy(*LISTS, "_day", "_figure").agg(
        *[F.min(c).alias(c) for c in ("gdelt_day", "specific_reported_figure")], F.sum("n").alias("n"))
    counted = []
    for rows, some in ((written(bare, "bare-cells"), F.col("location_ids").isNull()),
                       (cells, F.col("location_ids").isNotNull())):
        met = _met(rows, filters.filter(some), F.xxhash64(*LISTS, "_day", "_figure"))
        if met is not None:
            counted.append(met.groupBy(F.col("_filter.filter").alias("filter")).agg(F.sum("n").alias("n")))
    if not counted:
        return named.select("name", "refused", F.lit(0).cast("long").alias("n"))
    found = asked.select("name", "filter").join(reduce(DataFrame.union, counted), "filter").groupBy("name").agg(
        F.sum("n").alias("n"))
    return named.join(found, named["name"].eqNullSafe(found["name"]), "left").select(
        named["name"], "refused", F.coalesce("n", F.lit(0)).alias("n"))
