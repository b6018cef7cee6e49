"""Read model, filters, counts and listings."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import functions as F

from newsfacts.catalog.base import query
from newsfacts.catalog.prelude import joined_sql
from newsfacts.operators import facets, filters, listing, saved_filters
from newsfacts.operators.filters import FactFilter
from newsfacts.plans import marts

YEAR = FactFilter(fromdate="1997-01-01", todate="1998-01-01")
YEAR_SQL = "gdelt_day >= DATE '1997-01-01' AND gdelt_day <= DATE '1998-01-01'"
PLACES = [3, 7, 10, 11, 20, 30, 41, 52, 60, 77]
PLACES_SQL = "location IN (3, 7, 10, 11, 20, 30, 41, 52, 60, 77)"


def _mart_columns(df):
    return df.select(
        "document_identifier", "source_common_name", "gdelt_day", "fact", "unit", "term",
        "specific_reported_figure", "vague_reported_figure", "iso3", "location", "gkg_id",
        "category", "content_id", "location_ids_num",
    )


# --- read model ---------------------------------------------------------------------------------

@query("location_sets", f"SELECT fact, {joined_sql('location_ids')} AS location_ids, "
       f"{joined_sql('location_names')} AS location_names FROM fx_sets")
def _(c):
    return marts.location_sets(c.fact_locations, c.locations)


@query("location_set_ids", f"SELECT {joined_sql('location_ids')} AS location_ids, location_ids_num "
       "FROM fx_set_ids")
def _(c):
    return marts.location_set_ids(marts.location_sets(c.fact_locations, c.locations))


@query("location_set_hash", f"SELECT DISTINCT {joined_sql('location_ids')} AS location_ids, "
       f"md5({joined_sql('location_ids')}) AS location_set_md5 FROM fx_sets")
def _(c):
    return marts.location_set_hash(marts.location_sets(c.fact_locations, c.locations))


@query("row_number_sets", f"""
SELECT {joined_sql('location_ids')} AS location_ids,
  row_number() OVER (ORDER BY location_ids) AS set_number FROM fx_set_ids""")
def _(c):
    from newsfacts.operators.keys import number_rows

    sets = marts.location_sets(c.fact_locations, c.locations).select("location_ids").distinct()
    return number_rows(sets, ["location_ids"], "set_number")


@query("first_per_location_set", f"""
SELECT {joined_sql('location_ids')} AS location_ids, min(fact) AS fact FROM fx_sets GROUP BY fx_sets.location_ids""")
def _(c):
    sets = marts.location_sets(c.fact_locations, c.locations)
    return sets.groupBy("location_ids").agg(F.min("fact").alias("fact"))


@query("location_names_left", """
SELECT fact, location, location_name FROM fx_fact_locations
LEFT JOIN (SELECT * FROM fx_locations WHERE location_type <> 'country') l ON location = l.id
WHERE location IS NOT NULL""")
def _(c):
    known = c.locations.filter(F.col("location_type") != "country")
    return c.fact_locations.filter(F.col("location").isNotNull()).join(
        known.select(F.col("id").alias("location"), "location_name"), "location", "left"
    ).select("fact", "location", "location_name")


@query("location_set_join", f"SELECT fact, {joined_sql('location_ids')} AS location_ids, "
       f"{joined_sql('location_names')} AS location_names, location_ids_num FROM fx_fact_sets")
def _(c):
    return marts.fact_api_locations(c.fact_locations, c.locations)


@query("build_fact_api", "SELECT document_identifier, source_common_name, "
       "CAST(gdelt_day AS VARCHAR) AS gdelt_day, fact, unit, term, specific_reported_figure, "
       "vague_reported_figure, iso3, location, gkg_id, category, content_id, location_ids_num "
       "FROM fx_fact_api")
def _(c):
    sets = marts.fact_api_locations(c.fact_locations, c.locations)
    return marts.build_fact_api(
        c.facts, c.analysis_facts, c.analyses, c.gkg, c.fact_locations, sets
    )


_MAP_SQL = """
SELECT date_trunc('week', CAST(strptime(substr(CAST(g.date AS VARCHAR),1,8),'%Y%m%d') AS DATE)) AS week,
  l.id AS location_id, split_part(latlong, ',', 1) AS latitude, split_part(latlong, ',', 2) AS longitude,
  category, count(*) AS n
FROM fx_facts f JOIN fx_fact_locations fl ON f.id = fl.fact JOIN fx_locations l ON fl.location = l.id
JOIN fx_analysis_facts af ON f.id = af.fact JOIN fx_analyses a ON af.analysis = a.gkg_id
JOIN fx_gkg g ON a.gkg_id = g.id
WHERE specific_reported_figure < 100000000 AND category IS NOT NULL GROUP BY ALL"""


@query("refresh_marts", f"""
SELECT 'fact_api' AS mart, count(*) AS n FROM fx_fact_api
UNION ALL SELECT 'fact_api_locations', count(*) FROM fx_fact_sets
UNION ALL SELECT 'map_week', count(*) FROM ({_MAP_SQL})""")
def _(c):
    return _mart_sizes(marts.refresh_marts(c))


def _mart_sizes(stored):
    names = {"fact_api": stored.fact_api, "fact_api_locations": stored.fact_api_locations,
             "map_week": stored.map_week}
    counted = [
        df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("mart"), "n")
        for name, df in names.items()
    ]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


def _refreshed_late(c):
    """Marts stored while one month's facts were missing, then refreshed by that month's articles."""
    month = F.substring(F.col("date").cast("string"), 1, 6) == "199703"
    late = c.gkg.filter(month).select(F.col("id").alias("gkg_id"))
    early = SimpleNamespace(
        spark=c.spark, gkg=c.gkg, analyses=c.analyses, facts=c.facts, locations=c.locations,
        fact_locations=c.fact_locations,
        analysis_facts=c.analysis_facts.join(late, F.col("analysis") == F.col("gkg_id"), "left_anti"))
    stored = marts.refresh_marts(early)
    return marts.refresh_changed(c, stored.path, late)


@query("refresh_changed", f"""
SELECT document_identifier, CAST(gdelt_day AS VARCHAR) AS gdelt_day, fact, unit, term, specific_reported_figure,
  iso3, location, gkg_id, category, content_id, {joined_sql('location_ids')} AS location_ids
FROM fx_fact_api JOIN (SELECT fact, location_ids FROM fx_fact_sets) USING (fact)""")
def _(c):
    """Ids of sets depend on the order of refreshes, so the members of the set stand for them."""
    stored = _refreshed_late(c)
    sets = stored.fact_api_locations.select("location_ids_num", "location_ids").distinct()
    return stored.fact_api.join(sets, "location_ids_num").select(
        "document_identifier", "gdelt_day", "fact", "unit", "term", "specific_reported_figure", "iso3", "location",
        "gkg_id", "category", "content_id", "location_ids")


@query("refresh_changed_map", f"""
SELECT strftime(week, '%Y-%m-%d') AS gdelt_day, location_id, latitude, longitude, category, n AS count
FROM ({_MAP_SQL})""")
def _(c):
    return _refreshed_late(c).map_week


@query("map_week", f"""
SELECT strftime(week, '%Y-%m-%d') AS gdelt_day, location_id, latitude, longitude, category, n AS count
FROM ({_MAP_SQL})""")
def _(c):
    return marts.map_week(
        c.facts, c.fact_locations, c.locations, c.analysis_facts, c.analyses, c.gkg
    )


@query("map_week_json", f"""
SELECT '{{"gdelt_day":"' || strftime(week, '%Y-%m-%d') || '","location_id":' || location_id
  || coalesce(',"latitude":"' || latitude || '","longitude":"' || longitude || '"', '')
  || ',"category":"' || category || '","count":' || n || '}}' AS entry
FROM ({_MAP_SQL})""")
def _(c):
    row = F.struct("gdelt_day", "location_id", "latitude", "longitude", "category", "count")
    return c.marts.map_week.select(F.to_json(row).alias("entry"))


# --- filters ------------------------------------------------------------------------------------

_FILTERED = ("SELECT CAST(gdelt_day AS VARCHAR) AS gdelt_day, fact, location, gkg_id, category, unit, "
             "term, iso3, specific_reported_figure FROM {} WHERE {}")


def _narrow(df):
    return df.select(
        "gdelt_day", "fact", "location", "gkg_id", "category", "unit", "term", "iso3",
        "specific_reported_figure",
    )


def _register_filter(name, flt, sql, source="fx_api"):
    @query(name, _FILTERED.format(source, sql))
    def _(c):
        return _narrow(flt.apply(c.marts.fact_api))


_register_filter(
    "add_filters",
    FactFilter(
        fromdate="1997-01-01", todate="1999-12-31", location_ids=PLACES,
        categories=["Conflict", "Disaster"], units=["Person"],
        terms=["Displaced", "Evacuated", "Evicted"], specific_reported_figures=[1, 5000],
    ),
    "gdelt_day BETWEEN DATE '1997-01-01' AND DATE '1999-12-31' AND " + PLACES_SQL +
    " AND category IN ('Conflict', 'Disaster') AND unit = 'Person'"
    " AND term IN ('Displaced', 'Evacuated', 'Evicted') AND specific_reported_figure BETWEEN 1 AND 5000",
)
_register_filter("filter_date_range", YEAR, YEAR_SQL)
_register_filter("filter_category", FactFilter(categories=["Conflict", "Other"]),
                 "category IN ('Conflict', 'Other')")
_register_filter("filter_unit", FactFilter(units=["Household"]), "unit = 'Household'")
_register_filter("filter_source", FactFilter(source_common_names=["src1.example.com", "src7.example.com"]),
                 "source_common_name IN ('src1.example.com', 'src7.example.com')")
_register_filter("filter_term", FactFilter(terms=["Homeless", "Evicted"]), "term IN ('Homeless', 'Evicted')")
_register_filter("filter_iso3", FactFilter(iso3s=["N03", "N11", "N24"]), "iso3 IN ('N03', 'N11', 'N24')")
_register_filter("filter_locations", FactFilter(location_ids=PLACES), PLACES_SQL)
_register_filter("filter_figures", FactFilter(specific_reported_figures=[1000, 10, 200]),
                 "specific_reported_figure BETWEEN 10 AND 1000")
_register_filter("filter_figures_null", FactFilter(specific_reported_figures=["NULL", 1, 50]),
                 "specific_reported_figure BETWEEN 1 AND 50 OR specific_reported_figure IS NULL",
                 "fx_fact_api")
_register_filter("filter_figures_default", FactFilter(), "specific_reported_figure IS NOT NULL", "fx_fact_api")


@query("filter_locations_null", _FILTERED.format(
    "(SELECT * REPLACE (CASE WHEN location % 9 = 4 THEN NULL ELSE location END AS location) FROM fx_api)",
    PLACES_SQL + " OR location IS NULL"))
def _(c):
    unplaced = FactFilter().apply(c.marts.fact_api).withColumn(
        "location", F.when(F.col("location") % 9 != 4, F.col("location"))
    )
    return _narrow(filters.filter_locations(unplaced, PLACES + ["NULL"]))


@query("filter_locations_many", _FILTERED.format("fx_api", "location BETWEEN 5 AND 2400"))
def _(c):
    """More ids than fit a literal set: the semi-join form."""
    return _narrow(FactFilter(location_ids=list(range(5, 2401))).apply(c.marts.fact_api))


@query("filter_location_set", _FILTERED.format(
    "fx_api", "location_ids_num = (SELECT max(location_ids_num) FROM fx_set_ids)"))
def _(c):
    facts = FactFilter().apply(c.marts.fact_api)
    last = c.marts.fact_api_locations.select(F.max("location_ids_num")).scalar()
    return _narrow(facts.filter(F.col("location_ids_num") == last))


@query("filter_fulltext", """
SELECT content_id, count(*) AS n FROM fx_api JOIN fx_terms t ON content_id = t.id
WHERE list_contains(content_terms, 'ing') AND NOT list_contains(content_terms, 'ere') GROUP BY content_id""")
def _(c):
    hits = FactFilter(ts="ing & !ere").apply(c.marts.fact_api, c.text_index)
    return hits.groupBy("content_id").agg(F.count(F.lit(1)).alias("n"))


@query("filter_fulltext_phrase", """
SELECT content_id, count(*) AS n FROM fx_api JOIN fx_terms t ON content_id = t.id
WHERE token_text LIKE '% ing the %' AND token_text LIKE '% ing %'
   OR list_contains(content_terms, 'vielleicht') OR list_contains(content_terms, 'ando')
GROUP BY content_id""")
def _(c):
    flt = FactFilter(ts="ing <-> the & ing | vielleicht | ando")
    hits = flt.apply(c.marts.fact_api, c.text_index)
    return hits.groupBy("content_id").agg(F.count(F.lit(1)).alias("n"))


@query("filter_fulltext_prefix", """
SELECT content_id, count(*) AS n FROM fx_api JOIN fx_terms t ON content_id = t.id
WHERE (contains(token_text, ' and') OR contains(token_text, ' ing the ')) AND NOT contains(token_text, ' ver')
GROUP BY content_id""")
def _(c):
    """Parentheses and prefixes over the stored index."""
    hits = FactFilter(ts="(and:* | ing <-> the) & !ver:*").apply(c.marts.fact_api, c.text_index)
    return hits.groupBy("content_id").agg(F.count(F.lit(1)).alias("n"))


@query("parse_filter_params", _FILTERED.format(
    "fx_fact_api", "category IN ('Conflict', 'Other') AND unit = 'Person' AND "
    "gdelt_day >= DATE '1998-06-01' AND (specific_reported_figure BETWEEN 3 AND 40 "
    "OR specific_reported_figure IS NULL) AND location IN (3, 7, 10)"))
def _(c):
    request = {
        "categories": "{Conflict,Other}", "units": " {Person} ", "terms": "",
        "specific_reported_figures": "{NULL,3,40}", "location_ids": "{3,7,10}",
        "fromdate": "1998-06-01",
    }
    return _narrow(filters.parse_filter_params(request).apply(c.marts.fact_api))


@query("parse_list_column", """
SELECT page_id, array_to_string(string_split(url, '/'), '|') AS parts FROM pages""")
def _(c):
    wrapped = F.concat(F.lit(" {"), F.replace(F.col("url"), F.lit("/"), F.lit(",")), F.lit("}"))
    return c.raw("pages").select(
        "page_id", F.array_join(filters.parse_list_column(wrapped), "|").alias("parts")
    )


@query("saved_filter_counts", f"""
SELECT 'all' AS name, count(*) AS n FROM fx_api
UNION ALL SELECT 'year', count(*) FROM fx_api WHERE {YEAR_SQL}
UNION ALL SELECT 'places', count(*) FROM fx_api WHERE {PLACES_SQL}
UNION ALL SELECT 'unknown figure', count(*) FROM fx_fact_api WHERE specific_reported_figure IS NULL
UNION ALL SELECT 'conflict households', count(*) FROM fx_api
  WHERE category = 'Conflict' AND unit = 'Household'""")
def _(c):
    return filters.saved_filter_counts(
        c.marts.fact_api,
        {
            "all": FactFilter(),
            "year": YEAR,
            "places": FactFilter(location_ids=PLACES),
            "unknown figure": FactFilter(specific_reported_figures=["null"]),
            "conflict households": FactFilter(categories=["Conflict"], units=["Household"]),
        },
    )


def _saved_filters(c):
    """A saved filter per supplier, as request texts made from its columns."""
    key = F.col("s_suppkey")
    return c.raw("supplier").select(
        F.concat(F.lit("f"), key.cast("string")).alias("name"),
        F.when(key % 3 == 0, F.lit("{Conflict,Other}")).when(key % 3 == 1, F.lit("Disaster")).alias("categories"),
        F.when(key % 4 == 1, F.lit(" {Person} ")).otherwise(F.lit("{}")).alias("units"),
        F.when(key % 5 < 2, F.concat(F.lit("N"), F.lpad(F.col("s_nationkey").cast("string"), 2, "0"))).alias("iso3s"),
        F.when(key % 7 < 3, F.concat(F.lit("{"), key.cast("string"), F.lit(",77,NULL}"))).alias("location_ids"),
        F.when(key % 2 == 0, F.lit("{20,1,NULL}")).alias("specific_reported_figures"),
        F.when(key % 6 == 0, F.lit("1997-05-10")).alias("fromdate"),
        F.when(key % 6 < 2, F.lit("1998-02-03")).alias("todate"))


_SAVED_SQL = """
saved AS (
  SELECT 'f' || s_suppkey AS name, CASE s_suppkey % 3 WHEN 0 THEN ['Conflict', 'Other'] WHEN 1 THEN ['Disaster'] END AS categories,
    CASE WHEN s_suppkey % 4 = 1 THEN 'Person' END AS unit,
    CASE WHEN s_suppkey % 5 < 2 THEN 'N' || lpad(s_nationkey::VARCHAR, 2, '0') END AS iso3,
    CASE WHEN s_suppkey % 7 < 3 THEN [s_suppkey, 77] END AS places, s_suppkey % 2 = 0 AS ranged,
    CASE WHEN s_suppkey % 6 = 0 THEN DATE '1997-05-10' END AS a, CASE WHEN s_suppkey % 6 < 2 THEN DATE '1998-02-03' END AS z
  FROM supplier),
found AS (
  SELECT s.name, f.fact, f.location, f.gkg_id FROM fx_fact_api f JOIN saved s ON
    (s.categories IS NULL OR list_contains(s.categories, f.category)) AND (s.unit IS NULL OR s.unit = f.unit)
    AND (s.iso3 IS NULL OR s.iso3 = f.iso3) AND (s.places IS NULL OR list_contains(s.places, f.location) OR f.location IS NULL)
    AND (s.a IS NULL OR f.gdelt_day >= s.a) AND (s.z IS NULL OR f.gdelt_day <= s.z)
    AND CASE WHEN s.ranged THEN f.specific_reported_figure IS NULL OR f.specific_reported_figure BETWEEN 1 AND 20
      ELSE f.specific_reported_figure IS NOT NULL END)"""


@query("match_saved_filters", f""", {_SAVED_SQL}
SELECT s.name, false AS refused, count(f.name) AS n FROM saved s LEFT JOIN found f USING (name) GROUP BY s.name""")
def _(c):
    """Counts of a whole table of saved filters."""
    return saved_filters.match_counts(c.marts.fact_api, _saved_filters(c))


@query("match_saved_filters_rows", f""", {_SAVED_SQL}
SELECT name AS filter_name, fact, location, gkg_id FROM found WHERE name IN (
  SELECT name FROM saved WHERE places IS NOT NULL)""")
def _(c):
    """Facts of those saved filters that name places."""
    placed = _saved_filters(c).filter("location_ids is not null")
    return saved_filters.match_filters(c.marts.fact_api, placed).select("filter_name", "fact", "location", "gkg_id")


_NOW = "1998-06-01 00:00:00"


@query("select_for_scraping", f"""
SELECT gkg_id, status, retrieval_attempts FROM fx_analyses WHERE status = 'new' OR
  (status = 'scraping failed' AND retrieval_attempts < 3
   AND TIMESTAMP '{_NOW}' > retrieval_date + INTERVAL 12 HOUR)""")
def _(c):
    due = filters.select_for_scraping(c.analyses, F.lit(_NOW).cast("timestamp_ntz"))
    return due.select("gkg_id", "status", "retrieval_attempts")


@query("retry_due", f"""
SELECT gkg_id, TIMESTAMP '{_NOW}' > retrieval_date + INTERVAL 12 HOUR AS due FROM fx_analyses""")
def _(c):
    now = F.lit(_NOW).cast("timestamp_ntz")
    return c.analyses.select("gkg_id", filters.retry_due(F.col("retrieval_date"), now).alias("due"))


@query("select_for_stage", "SELECT gkg_id, content_id FROM fx_analyses WHERE status = 'extracted'")
def _(c):
    return filters.select_for_stage(c.analyses, "extracted").select("gkg_id", "content_id")


@query("search_url", """
SELECT id AS doc_id FROM fx_gkg WHERE contains(document_identifier, 'src7.')
ORDER BY date DESC, id LIMIT 1""")
def _(c):
    return filters.search_url(c.gkg, "src7.")


@query("search_url_oldest", """
SELECT id AS doc_id FROM fx_gkg WHERE contains(document_identifier, 'src7.')
ORDER BY date, id LIMIT 1""")
def _(c):
    return filters.search_url(c.gkg, "src7.", newest=False)


# --- counts -------------------------------------------------------------------------------------

def _facet_sql(where):
    return " UNION ALL ".join(
        f"SELECT count(*) AS count, CAST({f} AS VARCHAR) AS value, '{f}' AS filter_type "
        f"FROM fx_fact_api WHERE {where} GROUP BY {f}"
        for f in facets.FACETS
    )


@query("facet_counts", _facet_sql(f"specific_reported_figure IS NOT NULL AND {YEAR_SQL}"))
def _(c):
    return facets.facet_counts(YEAR.apply(c.marts.fact_api))


@query("facet_counts_null_figures", _facet_sql(
    "specific_reported_figure BETWEEN 1 AND 1000 OR specific_reported_figure IS NULL"))
def _(c):
    return facets.facet_counts(
        FactFilter(specific_reported_figures=["NULL", 1, 1000]).apply(c.marts.fact_api)
    )


@query("facet_union", _facet_sql(f"specific_reported_figure IS NOT NULL AND {PLACES_SQL}"))
def _(c):
    return facets.facet_union(FactFilter(location_ids=PLACES).apply(c.marts.fact_api))


_TIMELINE = ("SELECT CAST(gdelt_day AS VARCHAR) AS gdelt_day, category, count(*) AS count FROM fx_api "
             "WHERE {} GROUP BY ALL")


@query("timeline_counts", _TIMELINE.format("true"))
def _(c):
    return facets.timeline_counts(FactFilter().apply(c.marts.fact_api))


@query("timeline_counts_year_places", _TIMELINE.format(f"{YEAR_SQL} AND {PLACES_SQL}"))
def _(c):
    flt = FactFilter(fromdate=YEAR.fromdate, todate=YEAR.todate, location_ids=PLACES)
    return facets.timeline_counts(flt.apply(c.marts.fact_api))


@query("histogram_counts", "SELECT unit, specific_reported_figure, count(*) AS count FROM fx_api GROUP BY ALL")
def _(c):
    return facets.histogram_counts(FactFilter().apply(c.marts.fact_api))


@query("category_counts_filtered", f"""
SELECT category, count(*) AS count FROM fx_api WHERE {YEAR_SQL} AND {PLACES_SQL} GROUP BY category""")
def _(c):
    flt = FactFilter(fromdate=YEAR.fromdate, todate=YEAR.todate, location_ids=PLACES)
    return facets.counts_by(flt.apply(c.marts.fact_api), "category")


@query("fact_count", f"SELECT count(DISTINCT fact) AS n FROM fx_api WHERE {YEAR_SQL}")
def _(c):
    return facets.fact_count(YEAR.apply(c.marts.fact_api))


@query("group_count", """
SELECT count(*) AS n FROM (SELECT DISTINCT specific_reported_figure, location_ids_num, term, unit
FROM fx_fact_api WHERE specific_reported_figure BETWEEN 1 AND 1000000 OR specific_reported_figure IS NULL)""")
def _(c):
    flt = FactFilter(specific_reported_figures=[None, 1, 1000000])
    return facets.group_count(flt.apply(c.marts.fact_api))


@query("status_counts", "SELECT status, count(*) AS count FROM fx_analyses GROUP BY status")
def _(c):
    return facets.status_counts(c.analyses)


@query("category_counts", """
SELECT category, count(*) AS count FROM fx_analyses WHERE relevance GROUP BY category
UNION ALL SELECT 'Not Relevant', count(*) FROM fx_analyses WHERE NOT relevance""")
def _(c):
    return facets.category_counts(c.analyses)


_SAMPLE = """(SELECT content_id FROM (SELECT DISTINCT content_id FROM fx_api WHERE {where})
ORDER BY md5(CAST(content_id AS VARCHAR)), content_id LIMIT {n})"""
_CLOUD = """
SELECT word, count(*) AS nentry, count(DISTINCT id) AS ndoc FROM (
  SELECT id, unnest(content_terms) AS word FROM fx_terms
  WHERE id IN {ids})
GROUP BY word ORDER BY nentry DESC, ndoc DESC, word{limit}"""


@query("wordcloud", _CLOUD.format(ids=_SAMPLE.format(where=YEAR_SQL, n=1000), limit=" LIMIT 100"))
def _(c):
    return facets.wordcloud(YEAR.apply(c.marts.fact_api), c.stored_contents)


@query("wordcloud_top", "SELECT * FROM (" + _CLOUD.format(
    ids="(SELECT id FROM fx_terms)", limit=" LIMIT 100") + ")")
def _(c):
    """Top words over every stored content."""
    words = c.stored_contents.select("id", F.explode("content_terms").alias("word"))
    per_doc = words.groupBy("word", "id").agg(F.count(F.lit(1)).alias("n"))
    return per_doc.groupBy("word").agg(
        F.sum("n").alias("nentry"), F.count(F.lit(1)).alias("ndoc")
    ).orderBy(F.desc("nentry"), F.desc("ndoc"), "word").limit(100)


@query("random_sample", "SELECT * FROM " + _SAMPLE.format(where="true", n=100))
def _(c):
    return facets.random_sample(FactFilter().apply(c.marts.fact_api), "content_id", 100)


@query("sample_content_join", f"""
SELECT id, length(content_clean) AS n_chars FROM fx_contents
WHERE id IN {_SAMPLE.format(where="true", n=200)}""")
def _(c):
    ids = facets.random_sample(FactFilter().apply(c.marts.fact_api), "content_id", 200)
    return c.stored_contents.join(ids, c.stored_contents["id"] == ids["content_id"], "left_semi").select(
        "id", F.length("content_clean").cast("long").alias("n_chars")
    )


@query("facts_per_article", """
SELECT a.gkg_id, count(af.fact) AS n_facts FROM fx_analyses a
LEFT JOIN fx_analysis_facts af ON a.gkg_id = af.analysis GROUP BY a.gkg_id""")
def _(c):
    return facets.facts_per_article(c.analyses, c.analysis_facts)


# --- listings -----------------------------------------------------------------------------------

_FIRST = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fact
  ORDER BY gdelt_day, gkg_id, location) AS rn FROM fx_api WHERE {}) WHERE rn = 1)"""


@query("first_per_fact", "SELECT fact, CAST(gdelt_day AS VARCHAR) AS gdelt_day, gkg_id, category, "
       f"document_identifier FROM {_FIRST.format('true')}")
def _(c):
    first = listing.first_per_fact(FactFilter().apply(c.marts.fact_api))
    return first.select("fact", "gdelt_day", "gkg_id", "category", "document_identifier")


_ARTICLES = """(
  SELECT o_orderkey AS gkg_id, 'Report ' || o_orderpriority || ' of ' || o_custkey AS title,
    CASE WHEN o_orderkey % 11 <> 0 THEN 'Author ' || (o_custkey % 50) END AS authors,
    strftime(CAST(o_orderdate AS DATE) - CAST(o_orderkey % 4 AS INTEGER), '%Y-%m-%d') AS publication_date FROM orders)"""
_DETAILS = """(
  SELECT id, CAST(id % 500 AS INTEGER) AS excerpt_start, CAST(id % 500 + 80 AS INTEGER) AS excerpt_end,
    'term:' || (id % 500 + 5) || '-' || (id % 500 + 15)
    || CASE WHEN id % 2 = 0 THEN ';loc:' || (id % 500 + 20) || '-' || (id % 500 + 26) ELSE '' END AS tags FROM fx_facts)"""


def _tags():
    return F.array_join(F.transform("tag_spans", lambda s: F.concat(
        s["type"], F.lit(":"), s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ";").alias("tags")


_URL_SQL = f"""
SELECT p.document_identifier, p.fact, CAST(p.gdelt_day AS VARCHAR) AS gdelt_day, p.iso3,
  p.source_common_name, p.specific_reported_figure, p.term, p.unit, p.vague_reported_figure,
  p.category, p.gkg_id, {joined_sql('s.location_ids')} AS location_ids,
  {joined_sql('s.location_names')} AS location_names, md5(ct.content_clean) AS content_md5,
  v.assigned_to, v.missing, v.status, v.wrong, vv.display_color, ad.title, ad.authors, fd.excerpt_start,
  fd.excerpt_end, fd.tags
FROM {{first}} p JOIN fx_fact_sets s ON p.fact = s.fact
JOIN {_ARTICLES} ad ON p.gkg_id = ad.gkg_id JOIN {_DETAILS} fd ON p.fact = fd.id
JOIN fx_contents ct ON p.content_id = ct.id
LEFT JOIN fx_validation v ON p.fact = v.fact_id
LEFT JOIN fx_validation_values vv ON v.status = vv.key_value
ORDER BY p.fact LIMIT {{limit}} OFFSET {{offset}}"""


def _url_list(c, flt, limit, offset):
    index = c.text_index if flt.ts else None
    listed = listing.url_list(
        flt.apply(c.marts.fact_api, index), c.marts.fact_api_locations,
        c.analyses.select("gkg_id").join(c.article_details.drop("publication_date"), "gkg_id"), c.stored_contents,
        c.validation, c.validation_values, limit, offset, details=c.fact_details,
        refilter=lambda few: flt.apply(few(c.marts.fact_api), index),
    )
    return listed.select(
        "document_identifier", "fact", "gdelt_day", "iso3", "source_common_name",
        "specific_reported_figure", "term", "unit", "vague_reported_figure", "category", "gkg_id",
        "location_ids", "location_names", F.md5("content_clean").alias("content_md5"),
        "assigned_to", "missing", "status", "wrong", "display_color", "title", "authors", "excerpt_start",
        "excerpt_end", _tags(),
    )


@query("url_list", _URL_SQL.format(first=_FIRST.format(YEAR_SQL), limit=32, offset=0))
def _(c):
    return _url_list(c, YEAR, 32, 0)


@query("url_list_page", _URL_SQL.format(first=_FIRST.format("true"), limit=100, offset=32))
def _(c):
    return _url_list(c, FactFilter(), 100, 32)


@query("url_list_text", _URL_SQL.format(first=_FIRST.format(
    "content_id IN (SELECT id FROM fx_terms WHERE list_contains(content_terms, 'ing'))"),
    limit=32, offset=0))
def _(c):
    return _url_list(c, FactFilter(ts="ing"), 32, 0)


@query("url_list_join", """
SELECT f.fact, f.location, a.status, length(ct.content_clean) AS n_chars, len(s.location_ids) AS n_places
FROM fx_api f JOIN fx_fact_sets s ON f.fact = s.fact JOIN fx_analyses a ON f.gkg_id = a.gkg_id
JOIN fx_facts x ON x.id = f.fact JOIN fx_contents ct ON ct.id = f.content_id""")
def _(c):
    return (
        FactFilter().apply(c.marts.fact_api)
        .join(c.marts.fact_api_locations.select("fact", "location_ids"), "fact")
        .join(c.analyses.select("gkg_id", "status"), "gkg_id")
        .join(c.facts.select(F.col("id").alias("fact")), "fact")
        .join(
            c.stored_contents.select(F.col("id").alias("content_id"),
                              F.length("content_clean").cast("long").alias("n_chars")),
            "content_id",
        )
        .select("fact", "location", "status", "n_chars",
                F.size("location_ids").cast("long").alias("n_places"))
    )


_GROUP_SQL = """
SELECT p.specific_reported_figure, p.term, p.unit, p.location_ids_num,
  {names} AS location_names, nfacts FROM (
  SELECT p.specific_reported_figure, p.term, p.unit, p.location_ids_num,
    min(s.location_names) AS location_names, count(*) AS nfacts
  FROM {first} p JOIN fx_fact_sets s ON p.fact = s.fact GROUP BY ALL) p{order}"""


@query("grouped_facts", _GROUP_SQL.format(
    names=joined_sql("location_names"), first=_FIRST.format("true"), order=""))
def _(c):
    return listing.grouped_facts(
        FactFilter().apply(c.marts.fact_api), c.marts.fact_api_locations, limit=None
    )


@query("grouped_page", _GROUP_SQL.format(
    names=joined_sql("location_names"), first=_FIRST.format(YEAR_SQL),
    order=" ORDER BY nfacts DESC, specific_reported_figure, term, unit, location_ids_num LIMIT 32 OFFSET 32"))
def _(c):
    return listing.grouped_facts(
        YEAR.apply(c.marts.fact_api), c.marts.fact_api_locations, limit=32, offset=32
    )


@query("fact_review_join", """
SELECT f.id, f.unit, v.status, v.missing, v.wrong, v.assigned_to, vv.display_color
FROM fx_facts f LEFT JOIN fx_validation v ON f.id = v.fact_id
LEFT JOIN fx_validation_values vv ON v.status = vv.key_value""")
def _(c):
    return listing.fact_review(
        c.facts.select("id", "unit"), c.validation, c.validation_values
    ).select("id", "unit", "status", "missing", "wrong", "assigned_to", "display_color")


@query("get_document", f"""
SELECT g.id AS gkg_id, g.date AS gkg_date, g.source_common_name, g.document_identifier,
  ad.title AS document_title, ad.publication_date, a.category, md5(ct.content_clean) AS content_md5
FROM fx_gkg g JOIN fx_analyses a ON g.id = a.gkg_id JOIN {_ARTICLES} ad ON ad.gkg_id = g.id
LEFT JOIN fx_contents ct ON a.content_id = ct.id""")
def _(c):
    analyses = c.analyses.select("gkg_id", "category", "content_id").join(c.article_details, "gkg_id")
    return listing.get_document(c.gkg, analyses, c.stored_contents).withColumn(
        "content_md5", F.md5("content_clean")).drop("content_clean")


_NESTED = """
SELECT fl.fact, array_to_string(array_agg(location_name || '/' || location_type || '/' || c.iso3 || '/'
  || preferred_term || '/' || coalesce(latlong, 'NULL') ORDER BY location_name), ';') AS locations
FROM fx_fact_locations fl JOIN fx_locations l ON fl.location = l.id
JOIN fx_countries c ON l.country = c.iso3 GROUP BY fl.fact"""


def _flat(places):
    def one(p):
        return F.concat_ws("/", p["location_name"], p["location_type"], p["iso3"], p["country_name"],
                           F.coalesce(p["latlong"], F.lit("NULL")))
    return F.array_join(F.transform(places, one), ";")


@query("fact_locations_nested", _NESTED)
def _(c):
    nested = listing.fact_locations_nested(c.fact_locations, c.locations, c.countries)
    return nested.select("fact", _flat("locations").alias("locations"))


@query("document_facts", f"""
SELECT af.analysis AS gkg_id, f.id AS fact_id, f.unit, f.term, f.specific_reported_figure,
  f.vague_reported_figure, f.iso3, fd.excerpt_start, fd.excerpt_end, fd.tags, n.locations
FROM fx_analysis_facts af JOIN fx_facts f ON af.fact = f.id JOIN {_DETAILS} fd ON fd.id = f.id JOIN ({_NESTED}) n ON n.fact = f.id""")
def _(c):
    listed = listing.document_facts(
        c.facts.join(c.fact_details, "id"), c.analysis_facts, c.fact_locations, c.locations, c.countries
    )
    return listed.select(
        "gkg_id", "fact_id", "unit", "term", "specific_reported_figure", "vague_reported_figure",
        "iso3", "excerpt_start", "excerpt_end", _tags(), _flat("locations").alias("locations"),
    )


@query("article_coords", """
SELECT DISTINCT af.analysis AS gkg_id, split_part(latlong, ',', 1) AS lat, split_part(latlong, ',', 2) AS lon
FROM fx_analysis_facts af JOIN fx_fact_locations fl ON af.fact = fl.fact
JOIN fx_locations l ON fl.location = l.id WHERE latlong IS NOT NULL""")
def _(c):
    return listing.article_coords(c.analysis_facts, c.fact_locations, c.locations)


@query("recent_articles", """
SELECT a.gkg_id, coalesce(left(document_identifier, 40), '') AS url,
  upper(a.status[1]) || a.status[2:] AS status, strftime(updated, '%Y-%m-%d %H:%M') AS updated,
  coalesce(left(content, 100), 'None') AS content
FROM (SELECT gkg_id, content_id, updated, CASE status WHEN 'scraping failed' THEN 'scraping Failed'
  WHEN 'extracting failed' THEN 'extracting Failed' ELSE status END AS status FROM fx_analyses
  ORDER BY updated DESC, gkg_id LIMIT 10) a
LEFT JOIN fx_gkg g ON a.gkg_id = g.id LEFT JOIN fx_contents ct ON ct.id = a.content_id""")
def _(c):
    return listing.recent_articles(c.analyses, c.gkg, c.stored_contents)


@query("minute_text", "SELECT gkg_id, strftime(updated, '%Y-%m-%d %H:%M') AS updated FROM fx_analyses")
def _(c):
    return c.analyses.select("gkg_id", F.date_format("updated", "yyyy-MM-dd HH:mm").alias("updated"))


@query("to_char_day", "SELECT gkg_id, strftime(updated, '%Y-%m-%d') AS day FROM fx_analyses")
def _(c):
    return c.analyses.select("gkg_id", F.date_format("updated", "yyyy-MM-dd").alias("day"))


@query("gdelt_day", "SELECT id, CAST(CAST(strptime(substr(CAST(date AS VARCHAR),1,8),'%Y%m%d') AS DATE) "
       "AS VARCHAR) AS gdelt_day FROM fx_gkg")
def _(c):
    return c.gkg.select("id", marts.gdelt_day(F.col("date")).alias("gdelt_day"))


@query("week_start", "SELECT id, strftime(date_trunc('week', strptime(substr(CAST(date AS VARCHAR),1,8),"
       "'%Y%m%d')), '%Y-%m-%d') AS week FROM fx_gkg")
def _(c):
    week = F.date_trunc("week", marts.gdelt_day(F.col("date"))).cast("date")
    return c.gkg.select("id", week.alias("week"))


@query("oldest_first", """
SELECT gkg_id, strftime(updated, '%Y-%m-%d') AS updated FROM fx_analyses WHERE status = 'classified'
ORDER BY fx_analyses.updated, gkg_id LIMIT 50""")
def _(c):
    return listing.oldest_first(c.analyses, "classified", 50).select(
        "gkg_id", F.date_format("updated", "yyyy-MM-dd").alias("updated")
    )


@query("unanalysed_documents", """
SELECT id, date FROM fx_gkg g WHERE NOT EXISTS (SELECT 1 FROM fx_analyses a WHERE a.gkg_id = g.id)""")
def _(c):
    return listing.unanalysed_documents(c.gkg, c.analyses).select("id", "date")


@query("new_document_batch", """
SELECT id, date FROM fx_gkg g WHERE NOT EXISTS (SELECT 1 FROM fx_analyses a WHERE a.gkg_id = g.id)
ORDER BY date, id LIMIT 1000""")
def _(c):
    return listing.new_document_batch(c.gkg, c.analyses).select("id", "date")
