"""The denormalised read model: location sets, fact_api and the weekly map."""

from __future__ import annotations

import datetime as dt
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsfacts.functions import text as tx
from newsfacts.operators.keys import number_rows, rank_by_weight
from newsfacts.session import Scratch, new_path, tidy
from newsfacts.sources.manifests import children, versions


def gdelt_day(date: Column) -> Column:
    """First eight digits of a ``yyyyMMddHHmmss`` number as a date."""
    return F.to_date(F.substring(date.cast("string"), 1, 8), "yyyyMMdd")


def location_sets(fact_locations: DataFrame, locations: DataFrame) -> DataFrame:
    """Per fact, its location ids in order and the names aligned with them."""
    named = (
        fact_locations.filter(F.col("location").isNotNull())
        .join(locations.select(F.col("id").alias("location"), "location_name"), "location", "left")
    )
    pairs = F.array_sort(F.collect_list(F.struct("location", "location_name")))
    return named.groupBy("fact").agg(pairs.alias("p")).select(
        "fact",
        F.col("p.location").alias("location_ids"),
        F.col("p.location_name").alias("location_names"),
    )


def location_set_ids(sets: DataFrame) -> DataFrame:
    """One id per distinct set: 1 + the number of facts whose set sorts before it."""
    sizes = sets.groupBy("location_ids").agg(F.count(F.lit(1)).alias("n"))
    return rank_by_weight(sizes, ["location_ids"], F.col("n"), "location_ids_num").select(
        "location_ids", "location_ids_num"
    )


def location_set_hash(sets: DataFrame) -> DataFrame:
    """The same grain with an id that needs no order: a hash of the ids."""
    joined = F.concat_ws(",", F.col("location_ids").cast("array<string>"))
    return sets.select("location_ids").distinct().withColumn("location_set_md5", F.md5(joined))


def fact_api_locations(fact_locations: DataFrame, locations: DataFrame) -> DataFrame:
    sets = location_sets(fact_locations, locations)
    return sets.join(location_set_ids(sets), "location_ids", "left").select(
        "fact", "location_ids", "location_names", "location_ids_num"
    )


API = [
    "document_identifier", "source_common_name", "gdelt_day", "fact", "unit", "term",
    "specific_reported_figure", "vague_reported_figure", "iso3", "location", "gkg_id",
    "category", "content_id", "location_ids_num",
]


def build_fact_api(
    facts: DataFrame,
    analysis_facts: DataFrame,
    analyses: DataFrame,
    gkg: DataFrame,
    fact_locations: DataFrame,
    fact_sets: DataFrame,
) -> DataFrame:
    """Grain: fact x location x analysis. Facts without a place, or whose article has no category,
    are left out."""
    articles = (
        analyses.filter(F.col("category").isNotNull())
        .select("gkg_id", "category", "content_id")
        .join(
            gkg.select(F.col("id").alias("gkg_id"), "document_identifier", "source_common_name",
                       gdelt_day(F.col("date")).alias("gdelt_day")),
            "gkg_id",
        )
    )
    # Articles join the narrow bridge, before a fact has places and figures. All else joins on one key, so that
    # its inputs are shuffled by it once and the wide rows that come out are not shuffled again.
    reported = analysis_facts.select("fact", F.col("analysis").alias("gkg_id")).join(articles, "gkg_id")
    placed = (
        facts.select(
            F.col("id").alias("fact"), "unit", "term", "specific_reported_figure",
            "vague_reported_figure", "iso3",
        )
        .join(reported, "fact")
        .join(fact_sets.select("fact", "location_ids_num"), "fact")
        .join(fact_locations.select("fact", "location"), "fact")
    )
    return placed.select(*API)


def _fact_rows(facts: DataFrame, analysis_facts: DataFrame, analyses: DataFrame, gkg: DataFrame, inside: Column,
               fact_locations: DataFrame) -> DataFrame:
    """What both marts of facts are made of, each table shuffled by fact once: a row for each fact with a place and
    article of it, and one for such a fact without articles.

    ``places`` has the places in order, ``unplaced`` the number of pairs without one. ``month`` is the first month of
    all the fact's articles, ``first`` marks one row of each fact, ``shown`` the rows whose article is ``inside`` and
    has a category.
    """
    # Windows rather than aggregates of lists: the rows of a fact are sorted once, also for the joins.
    by_place = Window.partitionBy("fact").orderBy("location")
    all_places = by_place.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lists = fact_locations.select(
        "fact", F.collect_list("location").over(all_places).alias("places"),
        F.count_if(F.col("location").isNull()).over(all_places).cast("int").alias("unplaced"),
        F.row_number().over(by_place).alias("_row"),
    ).filter((F.col("_row") == 1) & (F.size("places") > 0)).drop("_row")
    shown = F.col("category").isNotNull() & F.coalesce(inside, F.lit(False))
    articles = gkg.join(
        analyses.filter(F.col("category").isNotNull()).select(F.col("gkg_id").alias("id"), "category", "content_id"),
        "id", "left",
    ).select(
        F.col("id").alias("gkg_id"), gdelt_day(F.col("date")).alias("gdelt_day"),
        *[F.when(shown, F.col(c)).alias(c) for c in (
            "document_identifier", "source_common_name", "category", "content_id")],
    )
    reported = analysis_facts.select("fact", F.col("analysis").alias("gkg_id")).join(articles, "gkg_id")
    known = facts.select(
        F.col("id").alias("fact"), "unit", "term", "specific_reported_figure", "vague_reported_figure", "iso3",
        F.lit(True).alias("_known"))
    rows = lists.join(reported, "fact", "left").join(known, "fact", "left")
    of_fact = Window.partitionBy("fact")
    return (
        rows.withColumn("_at", F.monotonically_increasing_id())
        .withColumn("first", F.col("_at") == F.min("_at").over(of_fact))
        .withColumn("month", F.trunc(F.min("gdelt_day").over(of_fact), "month"))
        .withColumn("shown", F.col("category").isNotNull() & F.col("_known").isNotNull())
        .drop("_at", "_known")
    )


def _named_sets(rows: DataFrame, locations: DataFrame) -> DataFrame:
    """(places, n, location_ids, location_names): every list of places once, with the number of facts that have it.

    Names are looked up once per list and not per fact.
    """
    each = rows.filter("first").groupBy("places").agg(F.count(F.lit(1)).alias("n")).select(
        "places", "n", F.explode("places").alias("location"))
    pairs = F.array_sort(F.collect_list(F.struct("location", "location_name")))
    named = each.join(locations.select(F.col("id").alias("location"), "location_name"), "location", "left")
    return named.groupBy("places", "n").agg(pairs.alias("p")).select(
        "places", "n", F.col("p.location").alias("location_ids"), F.col("p.location_name").alias("location_names"))


def map_week(
    facts: DataFrame,
    fact_locations: DataFrame,
    locations: DataFrame,
    analysis_facts: DataFrame,
    analyses: DataFrame,
    gkg: DataFrame,
) -> DataFrame:
    """Facts per week, place and category. Figures of 100 million and more, and NULL ones, are out.

    The counts are taken by (week, location id, category) first; coordinates join afterwards.
    """
    articles = analyses.filter(F.col("category").isNotNull()).select("gkg_id", "category").join(
        gkg.select(
            F.col("id").alias("gkg_id"),
            F.date_trunc("week", gdelt_day(F.col("date"))).cast("date").alias("gdelt_day"),
        ),
        "gkg_id",
    )
    counted = (
        facts.filter(F.col("specific_reported_figure") < 100000000)
        .select(F.col("id").alias("fact"))
        .join(analysis_facts.select("fact", F.col("analysis").alias("gkg_id")), "fact")
        .join(fact_locations, "fact")
        .join(articles, "gkg_id")
        .groupBy("gdelt_day", "location", "category")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    return counted.join(_coordinates(locations), "location").select(
        "gdelt_day", F.col("location").alias("location_id"), "latitude", "longitude", "category",
        "count",
    )


def write_content(contents: DataFrame, path: str) -> DataFrame:
    """Store contents with their terms, so that text is tokenised once and not per request."""
    cloud = tx.wordcloud_text(F.col("content_clean"))
    with tidy(contents.sparkSession):
        contents.select(
            "id",
            "content",
            "content_clean",
            "content_type",
            tx.term_vector(cloud).alias("content_terms"),
            tx.token_text(cloud).alias("token_text"),
        ).write.mode("overwrite").parquet(path)
    return contents.sparkSession.read.parquet(path)


@dataclass
class Marts:
    """One version of the stored read model. Later refreshes leave its files as they are."""

    fact_api: DataFrame
    fact_api_locations: DataFrame
    map_week: DataFrame
    path: str
    version: int


MONTHLY = ("fact_api", "fact_api_locations", "map_week")
_MANIFEST = "mart string, month string, value string"
# Sets with up to this many places in all are sent to the tasks that store them, about 100 bytes a place.
PLACES_SENT = 1 << 20


def _month() -> Column:
    return F.trunc(gdelt_day(F.col("date")), "month")


def _among(months: list[dt.date | None]) -> Column:
    """Whether the column ``month`` is one of ``months``; None stands for rows without a month."""
    dated = [m for m in months if m is not None]
    inside = F.coalesce(F.col("month").isin(dated), F.lit(False)) if dated else F.lit(False)
    return inside | F.col("month").isNull() if None in months else inside


def _read(spark: SparkSession, base: str, folders: list[str], schema: T.StructType) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], schema)
    found = spark.read.schema(schema).option("basePath", base).parquet(*[f"{base}/{f}" for f in folders])
    return found.select(*schema.names)


def _folder_month(folder: str) -> dt.date | None:
    value = folder.rsplit("month=", 1)[1]
    return None if value.startswith("__") else dt.date.fromisoformat(value)


class _Run:
    """The files of one refresh. No reader sees them before a manifest names them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.name = spark, path, f"run=r{uuid.uuid4().hex}"

    def write(self, df: DataFrame, mart: str, order: list[str], added=None) -> DataFrame:
        """Store by month; ranges over (month, order) keep a busy month or place from landing in one task.

        ``added`` adds to rows what need not be shuffled with them; it must leave them in their ranges.
        """
        ranged = df.repartitionByRange("month", *order).sortWithinPartitions("month", *order)
        ranged = added(ranged) if added else ranged
        with tidy(self.spark):
            ranged.write.partitionBy("month").parquet(f"{self.path}/{mart}/{self.name}")
        return _read(self.spark, f"{self.path}/{mart}", self.folders(mart), ranged.schema)

    def folders(self, mart: str) -> list[str]:
        names = children(self.spark, f"{self.path}/{mart}/{self.name}")
        return [f"{self.name}/{n}" for n in names if n.startswith("month=")]


def _manifest(spark: SparkSession, path: str, version: int) -> list[tuple[str, str | None, str]]:
    """What a version is made of: three rows per month and a few more."""
    rows = spark.read.schema(_MANIFEST).parquet(f"{path}/manifests/{version}").collect()
    return [tuple(r) for r in rows]


def _known_set_ids(sets: DataFrame, known: DataFrame, first: int, store) -> DataFrame:
    """Sets that were stored before keep their ids; new ones get the next, in the order of their members."""
    asked = sets.select("location_ids").distinct()
    old = known.select("location_ids", "location_ids_num").distinct()
    new = number_rows(
        asked.join(old, "location_ids", "left_anti"), ["location_ids"], "location_ids_num", first, store)
    return asked.join(old, "location_ids").unionByName(new.select("location_ids", "location_ids_num"))


def _refresh(tables, path: str, months: list[dt.date | None] | None) -> Marts:
    """Write the marts of ``months`` (None: of all) anew and switch to a version that names them."""
    with Scratch(tables.spark) as scratch:
        return _rewrite(tables, path, months, scratch)


def _rewrite(tables, path: str, months: list[dt.date | None] | None, scratch: Scratch) -> Marts:
    spark = tables.spark
    latest = max((n for n, whole in versions(spark, path).items() if whole), default=None)
    kept, first, known = [], 1, None
    articles = tables.gkg.withColumn("month", _month())
    bridge, places, facts = tables.analysis_facts, tables.fact_locations, tables.facts
    if months is not None:
        stored = _manifest(spark, path, latest)
        kept = [r for r in stored if r[0] in MONTHLY and _folder_month(r[2]) not in months]
        first = next(int(r[2]) for r in stored if r[0] == "next_set")
        known = _monthly(spark, path, stored, "fact_api_locations")
        inside = _among(months)
        if None not in months:
            bounds = [f"{m:%Y%m}" for m in (min(months), max(months))]
            inside &= F.col("date").between(int(bounds[0] + "01000000"), int(bounds[1] + "31235959"))
        touched = bridge.join(
            articles.filter(inside).select(F.col("id").alias("analysis")), "analysis", "left_semi").select("fact")
        if None in months:
            dated = bridge.join(articles.select(F.col("id").alias("analysis")), "analysis", "left_semi")
            touched = touched.union(places.select("fact").join(dated, "fact", "left_anti"))
        touched = scratch.written(touched.distinct(), "touched-facts")
        bridge, places = (t.join(touched, "fact", "left_semi") for t in (bridge, places))
        facts = facts.join(touched.select(F.col("fact").alias("id")), "id", "left_semi")
    else:
        inside = F.lit(True)

    run = _Run(spark, path)
    # A fact belongs to the first month of its articles. All its articles are looked at, so a fact that is
    # only touched lies in a folder that the manifest does not take. Stored, as all below is read from it: the sets,
    # and the rows of each mart twice, for the bounds of its ranges and to be dealt by them.
    rows = scratch.written(_fact_rows(facts, bridge, tables.analyses, articles, inside, places), "fact-rows")
    # Stored, so that its size is known: few sets are sent to all tasks, instead of all facts to their sets.
    named = scratch.written(_named_sets(rows, tables.locations), "place-sets")
    if known is None:
        ids = rank_by_weight(named, ["location_ids"], F.col("n"), "location_ids_num", scratch.written)
    else:
        ids = named.join(_known_set_ids(named, known, first, scratch.written), "location_ids")
    ids = scratch.written(ids.select("places", "location_ids", "location_names", "location_ids_num"), "set-ids")
    firsts = rows.filter("first").select("fact", "places", "month").join(ids.select("places", "location_ids_num"), "places")

    def with_places(df: DataFrame, members: DataFrame) -> DataFrame:
        return df.join(members, "location_ids_num").select(
            "fact", "location_ids", "location_names", "location_ids_num", "month")

    members, firsts = ids.drop("places"), firsts.drop("places")
    if (ids.agg(F.sum(F.size("places"))).first()[0] or 0) <= PLACES_SENT:
        sets = run.write(firsts, "fact_api_locations", ["fact"], lambda df: with_places(df, F.broadcast(members)))
    else:
        sets = run.write(with_places(firsts, members), "fact_api_locations", ["fact"])
    every = F.concat("places", F.array_repeat(F.lit(None), F.col("unplaced")))
    api = run.write(
        rows.filter("shown").join(ids.select("places", "location_ids_num"), "places")
        .withColumn("location", F.explode(every)).select(*API, F.trunc("gdelt_day", "month").alias("month")),
        "fact_api", ["location", "fact"])
    # A week may lie in two months: each month stores its part of the week, readers add them up.
    weeks = run.write(
        api.filter(F.col("specific_reported_figure") < 100000000)
        .groupBy(F.date_trunc("week", "gdelt_day").cast("date").alias("gdelt_day"), "location", "category", "month")
        .agg(F.count(F.lit(1)).alias("count")),
        "map_week", ["gdelt_day", "location"])
    _coordinates(tables.locations).write.parquet(f"{path}/places/{run.name}")

    last = sets.agg(F.max("location_ids_num")).first()[0] or 0
    fresh = [(mart, None, folder) for mart in MONTHLY for folder in run.folders(mart)]
    rows = kept + [r for r in fresh if months is None or _folder_month(r[2]) in months]
    rows = [(mart, str(_folder_month(folder)), folder) for mart, _, folder in rows]
    rows += [("schema", mart, df.schema.json()) for mart, df in zip(MONTHLY, (api, sets, weeks))]
    rows += [("next_set", None, str(max(first, last + 1))), ("places", None, run.name)]
    # Last of all, and never over an earlier manifest: of two refreshes at a time, one fails.
    version = max(versions(spark, path), default=0) + 1
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.parquet(f"{path}/manifests/{version}")
    return open_marts(spark, path)


def _coordinates(locations: DataFrame) -> DataFrame:
    return locations.select(
        F.col("id").alias("location"),
        F.split_part("latlong", F.lit(","), F.lit(1)).alias("latitude"),
        F.split_part("latlong", F.lit(","), F.lit(2)).alias("longitude"),
    )


def refresh_marts(tables, path: str | None = None) -> Marts:
    """Recompute and store all marts as a new version, and switch to it when it is whole.

    ``fact_api`` is partitioned by month, by which ``FactFilter`` prunes folders, and sorted by location
    within files, so location filters skip row groups. The week map is counted from the stored ``fact_api``.
    """
    return _refresh(tables, path or new_path(tables.spark, "marts"), None)


def refresh_changed(tables, path: str, changed: DataFrame) -> Marts:
    """A new version in which only the months that ``changed`` articles (gkg_id) reach are written anew.

    These are the months the articles are in now or were in before, and those of the other articles of their
    facts. All other months stay the files they are. Ids of location sets stay too, so new sets sort after old
    ones. Without changes, or without marts to start from, see :func:`refresh_marts`. Names and coordinates of
    places that changed by themselves take effect in rebuilt months (names) and everywhere (coordinates).
    """
    spark = tables.spark
    if not any(versions(spark, path).values()):
        return refresh_marts(tables, path)
    months = changed_months(tables, path, changed)
    return _refresh(tables, path, months) if months else open_marts(spark, path)


def changed_since(analyses: DataFrame, since: Column) -> DataFrame:
    """(gkg_id) of the articles updated after ``since``, for :func:`refresh_changed`."""
    return analyses.filter(F.col("updated") > since).select("gkg_id").distinct()


def changed_months(tables, path: str, changed: DataFrame) -> list[dt.date | None]:
    """Months of the stored or the new marts in which a row of one of these articles can be."""
    spark = tables.spark
    latest = max(n for n, whole in versions(spark, path).items() if whole)
    stored = _manifest(spark, path, latest)
    ids = changed.select("gkg_id").distinct()
    bridge = tables.analysis_facts.select("fact", F.col("analysis").alias("gkg_id"))
    articles = tables.gkg.select(F.col("id").alias("gkg_id"), _month().alias("month"))
    before = _monthly(spark, path, stored, "fact_api").join(ids, "gkg_id", "left_semi")
    facts = bridge.join(ids, "gkg_id", "left_semi").select("fact").union(before.select("fact")).distinct()
    found = (
        articles.join(ids, "gkg_id", "left_semi").select("month")
        .union(before.select("month"))
        .union(_monthly(spark, path, stored, "fact_api_locations").join(facts, "fact", "left_semi").select("month"))
        .union(facts.join(bridge, "fact", "left").join(articles, "gkg_id", "left").select("month"))
    )
    return [r["month"] for r in found.distinct().collect()]  # as many as the calendar has


def _monthly(spark: SparkSession, path: str, manifest: list, mart: str) -> DataFrame:
    schema = next(T.StructType.fromJson(json.loads(r[2])) for r in manifest if r[:2] == ("schema", mart))
    return _read(spark, f"{path}/{mart}", [r[2] for r in manifest if r[0] == mart], schema)


def open_marts(spark: SparkSession, path: str) -> Marts:
    """The newest whole version; what it reads is settled here, whatever refreshes follow."""
    version = max(n for n, whole in versions(spark, path).items() if whole)
    manifest = _manifest(spark, path, version)
    api, sets, weeks = (_monthly(spark, path, manifest, mart) for mart in MONTHLY)
    places = next(r[2] for r in manifest if r[0] == "places")
    counts = weeks.groupBy("gdelt_day", "location", "category").agg(F.sum("count").alias("count"))
    return Marts(
        fact_api=api,
        fact_api_locations=sets.drop("month"),
        map_week=counts.join(spark.read.parquet(f"{path}/places/{places}"), "location").select(
            "gdelt_day", F.col("location").alias("location_id"), "latitude", "longitude", "category", "count"),
        path=path,
        version=version,
    )
