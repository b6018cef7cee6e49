"""Places, coordinates and geotagging."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsfacts.catalog.base import query
from newsfacts.functions import geo
from newsfacts.operators import geotag

_NATION = "'N' || lpad(CAST({} AS VARCHAR), 2, '0')"

# Places: a country by name, by official name, a subdivision in capitals, or a name only
# candidates know. Every customer is one place mention.
_PLACES = f"""
, p_places AS (
  SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN n_name WHEN 1 THEN 'Republic of ' || n_name
    WHEN 2 THEN upper(coalesce(p_brand, 'x')) ELSE c_name END AS place_name
  FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN part ON p_partkey = c_custkey
), p_terms AS (
  SELECT n_name AS term, {_NATION.format('n_nationkey')} AS country, 1 AS priority FROM nation
  UNION ALL SELECT 'Republic of ' || n_name, {_NATION.format('n_nationkey')}, 3 FROM nation
  UNION ALL SELECT 'Republic of ' || n_name, {_NATION.format('(n_nationkey + 1) % 25')}, 2 FROM nation
    WHERE n_nationkey % 5 = 0
), p_subdivisions AS (
  SELECT DISTINCT replace(p_brand, 'a', 'á') AS name, {_NATION.format('p_size % 25')} AS iso3
  FROM part WHERE p_size % 2 = 0
), p_codes AS (
  SELECT chr(65 + n_nationkey) || 'X' AS iso2, {_NATION.format('n_nationkey')} AS iso3
  FROM nation WHERE n_nationkey <> 13
), p_candidates AS (
  SELECT place_name, min(id) AS id, i, ((min(id) * i * 7) % 100) / 100.0 AS importance,
    CAST((min(id) * i) % 180 - 90 AS VARCHAR) AS lat, CAST((min(id) * i) % 360 - 180 AS VARCHAR) AS lon,
    lower(chr(65 + CAST(min(id) % 25 AS INT))) || 'x' AS iso2,
    CASE min(id) % 3 WHEN 0 THEN 'village' END AS place_extratag,
    CASE min(id) % 5 WHEN 0 THEN 'locality' WHEN 1 THEN 'state' WHEN 2 THEN 'hamlet' END AS type,
    CASE min(id) % 2 WHEN 0 THEN 'country' ELSE 'river' END AS class
  FROM p_places, unnest([1, 2, 3]) u(i)
  GROUP BY place_name, i HAVING i <= min(p_places.id) % 4
)
"""


def _code(col):
    return F.concat(F.lit("N"), F.lpad(col.cast("string"), 2, "0"))


def places(c):
    nation = c.raw("nation").select("n_nationkey", "n_name")
    part = c.raw("part").select(F.col("p_partkey").alias("c_custkey"), "p_brand")
    key = F.col("c_custkey") % 4
    name = (
        F.when(key == 0, F.col("n_name"))
        .when(key == 1, F.concat(F.lit("Republic of "), F.col("n_name")))
        .when(key == 2, F.upper(F.coalesce("p_brand", F.lit("x"))))
        .otherwise(F.col("c_name"))
    )
    return (
        c.raw("customer").select("c_custkey", "c_name", "c_nationkey")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(part, "c_custkey", "left")
        .select(F.col("c_custkey").alias("id"), name.alias("place_name"))
    )


def country_terms(c):
    nation = c.raw("nation")
    code = _code(F.col("n_nationkey"))
    official = F.concat(F.lit("Republic of "), F.col("n_name"))
    entries = F.array(
        F.struct(F.col("n_name").alias("term"), code.alias("country"), F.lit(1).alias("priority")),
        F.struct(official.alias("term"), code.alias("country"), F.lit(3).alias("priority")),
        F.when(
            F.col("n_nationkey") % 5 == 0,
            F.struct(official.alias("term"), _code((F.col("n_nationkey") + 1) % 25).alias("country"),
                     F.lit(2).alias("priority")),
        ),
    )
    return nation.select(F.inline(F.filter(entries, lambda e: e.isNotNull())))


def subdivisions(c):
    return c.raw("part").filter("p_size % 2 = 0").select(
        F.replace(F.col("p_brand"), F.lit("a"), F.lit("á")).alias("name"),
        _code(F.col("p_size") % 25).alias("iso3"),
    ).distinct()


def codes(c):
    return c.raw("nation").filter("n_nationkey <> 13").select(
        F.concat(F.char(F.col("n_nationkey") + 65), F.lit("X")).alias("iso2"),
        _code(F.col("n_nationkey")).alias("iso3"),
    )


def candidates(c):
    first = places(c).groupBy("place_name").agg(F.min("id").alias("id"))
    numbered = first.filter("id % 4 > 0").withColumn("i", F.explode(F.sequence(F.lit(1), (F.col("id") % 4).cast("int"))))
    key = F.col("id")
    return numbered.select(
        "place_name", "id", "i",
        (((key * F.col("i") * 7) % 100) / 100.0).alias("importance"),
        ((key * F.col("i")) % 180 - 90).cast("string").alias("lat"),
        ((key * F.col("i")) % 360 - 180).cast("string").alias("lon"),
        F.concat(F.lower(F.char(key % 25 + 65)), F.lit("x")).alias("iso2"),
        F.when(key % 3 == 0, "village").alias("place_extratag"),
        F.when(key % 5 == 0, "locality").when(key % 5 == 1, "state").when(key % 5 == 2, "hamlet").alias("type"),
        F.when(key % 2 == 0, "country").otherwise("river").alias("class"),
    )


_COUNTRY = """(SELECT term AS place_name, arg_min(country, struct_pack(p := priority, c := country)) AS iso3
FROM p_terms GROUP BY term)"""
_SUB = "(SELECT lower(strip_accents(name)) AS fold, min(iso3) AS iso3 FROM p_subdivisions GROUP BY 1)"
_NAMED = f"""(SELECT p.place_name, CASE WHEN c.iso3 IS NOT NULL THEN 'country' WHEN s.iso3 IS NOT NULL
  THEN 'subdivision' END AS type, coalesce(c.iso3, s.iso3) AS country_code
FROM (SELECT DISTINCT place_name FROM p_places) p LEFT JOIN {_COUNTRY} c ON p.place_name = c.place_name
LEFT JOIN {_SUB} s ON lower(strip_accents(p.place_name)) = s.fold)"""


def kind_sql(col, classes):
    cases = " ".join(
        f"WHEN {col} IN ({', '.join(repr(v) for v in values)}) THEN '{name}'" for name, values in classes
    )
    return f"CASE {cases} ELSE 'unknown' END"


_BEST = """(SELECT place_name, arg_min(struct_pack(lat := lat, lon := lon, iso2 := iso2,
  place_extratag := place_extratag, type := type, class := class),
  struct_pack(i := -importance, lat := lat, lon := lon)) AS b, count(*) AS n FROM {} GROUP BY place_name)"""
_INFO = f"""(SELECT n.place_name,
  CASE WHEN n.country_code IS NOT NULL THEN n.type WHEN b.n IS NOT NULL THEN
    {kind_sql("coalesce(b.b.place_extratag, b.b.type, b.b.class)", geo.OSM_PLACES)} ELSE '' END AS type,
  CASE WHEN n.country_code IS NOT NULL THEN n.country_code WHEN b.n IS NOT NULL
    THEN coalesce(k.iso3, 'XXX') ELSE 'XXX' END AS country_code,
  CASE WHEN b.n IS NOT NULL THEN b.b.lat || ',' || b.b.lon ELSE '' END AS coordinates,
  CASE WHEN b.n IS NULL THEN 'no-results' WHEN b.n = 1 THEN 'single-result' ELSE 'multiple-results' END AS flag
FROM {_NAMED} n LEFT JOIN {_BEST.format('''(SELECT d.* FROM p_candidates d
    JOIN ''' + _NAMED + ''' m ON d.place_name = m.place_name LEFT JOIN p_codes k ON upper(d.iso2) = k.iso2
    WHERE m.country_code IS NULL OR m.country_code = coalesce(k.iso3, 'XXX'))''')} b ON n.place_name = b.place_name
LEFT JOIN p_codes k ON upper(b.b.iso2) = k.iso2)"""


def place_query(name, sql):
    return query(name, _PLACES + sql)


@place_query("country_lookup", f"SELECT id, p.place_name, iso3 FROM p_places p JOIN {_COUNTRY} c "
             "ON p.place_name = c.place_name")
def _(c):
    return geotag.country_lookup(places(c), country_terms(c)).select("id", "place_name", "iso3")


@place_query("subdivision_lookup", f"SELECT id, place_name, iso3 FROM p_places JOIN {_SUB} s "
             "ON lower(strip_accents(place_name)) = s.fold")
def _(c):
    return geotag.subdivision_lookup(places(c), subdivisions(c)).select("id", "place_name", "iso3")


@place_query("place_country", f"SELECT * FROM {_NAMED}")
def _(c):
    names = places(c).select("place_name").distinct()
    return geotag.place_country(names, country_terms(c), subdivisions(c))


@place_query("iso2_to_iso3", "SELECT d.id, d.i, d.place_name, coalesce(k.iso3, 'XXX') AS iso3 FROM p_candidates d "
             "LEFT JOIN p_codes k ON upper(d.iso2) = k.iso2")
def _(c):
    return geotag.iso2_to_iso3(candidates(c), codes(c), "iso2", "iso3").select("id", "i", "place_name", "iso3")


@place_query("best_geocode", "SELECT place_name, b.lat AS lat, b.lon AS lon, b.iso2 AS iso2, "
             f"b.type AS type, n AS n_candidates FROM {_BEST.format('p_candidates')}")
def _(c):
    return geotag.best_geocode(candidates(c)).select("place_name", "lat", "lon", "iso2", "type", "n_candidates")


@place_query("geocode_flag", """
SELECT p.place_name, CASE count(d.id) WHEN 0 THEN 'no-results' WHEN 1 THEN 'single-result'
  ELSE 'multiple-results' END AS flag
FROM (SELECT DISTINCT place_name FROM p_places) p LEFT JOIN p_candidates d ON p.place_name = d.place_name
GROUP BY p.place_name""")
def _(c):
    counted = candidates(c).groupBy("place_name").agg(F.count(F.lit(1)).alias("n"))
    names = places(c).select("place_name").distinct()
    return names.join(counted, "place_name", "left").select(
        "place_name", geotag.geocode_flag(F.col("n")).alias("flag")
    )


@place_query("geo_info", f"SELECT * FROM {_INFO}")
def _(c):
    return geotag.geo_info(places(c), country_terms(c), subdivisions(c), candidates(c), codes(c))


@place_query("geotag_locations", f"""
SELECT l.id, l.location_name, CASE WHEN l.country IS NULL THEN i.type ELSE 'city' END AS location_type,
  coalesce(l.country, i.country_code) AS country,
  CASE WHEN l.country IS NULL THEN i.coordinates ELSE '0,0' END AS latlong
FROM (SELECT min(id) AS id, place_name AS location_name, CASE WHEN min(id) % 5 = 0 THEN 'N01' END AS country
  FROM p_places GROUP BY place_name) l LEFT JOIN {_INFO} i ON l.location_name = i.place_name""")
def _(c):
    known = F.col("id") % 5 == 0
    stored = places(c).groupBy(F.col("place_name").alias("location_name")).agg(F.min("id").alias("id")).select(
        "id", "location_name", F.when(known, "city").alias("location_type"),
        F.when(known, "N01").alias("country"), F.when(known, "0,0").alias("latlong"),
    )
    info = geotag.geo_info(places(c), country_terms(c), subdivisions(c), candidates(c), codes(c))
    return geotag.geotag_locations(stored, info)


_SPLIT = """
, s_groups AS (
  SELECT DISTINCT fact, country FROM fx_fact_locations fl JOIN fx_locations l ON fl.location = l.id
), s_ranked AS (
  SELECT fact, country, row_number() OVER (PARTITION BY fact ORDER BY country) AS r FROM s_groups
), s_owner AS (
  SELECT fact, country, fact AS owner FROM s_ranked WHERE r = 1
  UNION ALL
  SELECT fact, country, (SELECT max(id) FROM fx_facts) + row_number() OVER (ORDER BY fact, country)
  FROM s_ranked WHERE r > 1
)
"""


@query("split_fact_by_country", _SPLIT + """
SELECT coalesce(o.owner, f.id) AS id, f.id AS source_fact, coalesce(o.country, f.iso3) AS iso3, unit, term
FROM fx_facts f LEFT JOIN s_owner o ON f.id = o.fact""")
def _(c):
    split, _pairs = geotag.split_fact_by_country(c.facts, c.fact_locations, c.locations)
    return split.select("id", "source_fact", "iso3", "unit", "term")


@query("split_fact_locations", _SPLIT + """
SELECT o.owner AS fact, fl.location FROM fx_fact_locations fl JOIN fx_locations l ON fl.location = l.id
JOIN s_owner o ON o.fact = fl.fact AND o.country = l.country""")
def _(c):
    _split, pairs = geotag.split_fact_by_country(c.facts, c.fact_locations, c.locations)
    return pairs


@query("assign_fact_iso3", _SPLIT + """
SELECT f.id, coalesce(g.country, f.iso3) AS iso3 FROM fx_facts f LEFT JOIN (
  SELECT fact, min(country) AS country FROM s_groups GROUP BY fact HAVING count(*) = 1) g ON f.id = g.fact""")
def _(c):
    return geotag.assign_fact_iso3(c.facts, c.fact_locations, c.locations).select("id", "iso3")


# --- scalar functions ---------------------------------------------------------------------------

@query("strip_accents", "SELECT doc_id, md5(strip_accents(text)) AS folded FROM documents")
def _(c):
    return c.raw("documents").select("doc_id", F.md5(geo.strip_accents(F.col("text"))).alias("folded"))


@place_query("same_place_name", """
SELECT p.id, lower(strip_accents(place_name)) = lower(strip_accents(replace(coalesce(p_brand, ''), 'a', 'á'))) AS same
FROM p_places p LEFT JOIN part ON p_partkey = p.id""")
def _(c):
    part = c.raw("part").select(F.col("p_partkey").alias("id"), "p_brand")
    accented = F.replace(F.coalesce("p_brand", F.lit("")), F.lit("a"), F.lit("á"))
    return places(c).join(part, "id", "left").select(
        "id", geo.same_place_name(F.col("place_name"), accented).alias("same")
    )


@query("strip_place_words", """
SELECT id, array_to_string(list_transform(string_split(trim(regexp_replace(lower(name),
  'the|province|county|district|city|township', '', 'g'), ' '), ' '),
  lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') AS name
FROM (SELECT l.id, 'The ' || s_name || ' County of ' || n_name || CASE l.id % 3 WHEN 0 THEN ' Province' ELSE '' END AS name
  FROM fx_locations l JOIN supplier ON s_suppkey = l.id JOIN nation ON s_nationkey = n_nationkey)""")
def _(c):
    suffix = F.when(F.col("s_suppkey") % 3 == 0, " Province").otherwise("")
    named = c.raw("supplier").join(c.raw("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("id"),
        F.concat(F.lit("The "), F.col("s_name"), F.lit(" County of "), F.col("n_name"), suffix).alias("name"),
    )
    return named.select("id", geo.strip_place_words(F.col("name")).alias("name"))


@query("lat_lon", """
SELECT id, split_part(latlong, ',', 1) AS lat, split_part(latlong, ',', 2) AS lon FROM fx_locations""")
def _(c):
    lat, lon = geo.lat_lon(F.col("latlong"))
    return c.locations.select("id", lat.alias("lat"), lon.alias("lon"))


@query("lon_lat_text", """
SELECT id, split_part(latlong, ',', 2) || ',' || split_part(latlong, ',', 1) AS swapped FROM fx_locations""")
def _(c):
    lat, lon = geo.lat_lon(F.col("latlong"))
    return c.locations.select("id", geo.lon_lat_text(lat, lon).alias("swapped"))


@query("valid_coords", """
SELECT id, coalesce(CAST(split_part(latlong, ',', 1) AS DOUBLE) BETWEEN -90 AND 90
  AND CAST(split_part(latlong, ',', 2) AS DOUBLE) BETWEEN -180 AND 180, false) AS valid FROM fx_locations""")
def _(c):
    return c.locations.select("id", geo.valid_coords(F.col("latlong")).alias("valid"))


@place_query("osm_place_type", "SELECT id, i, place_name, "
             f"{kind_sql('coalesce(place_extratag, type, class)', geo.OSM_PLACES)} AS kind FROM p_candidates")
def _(c):
    place = geo.best_place(F.col("place_extratag"), F.col("type"), F.col("class"))
    return candidates(c).select("id", "i", "place_name", geo.place_type(place).alias("kind"))


@place_query("layer_place_type", "SELECT id, i, place_name, "
             f"{kind_sql('coalesce(type, class)', geo.LAYER_PLACES)} AS kind FROM p_candidates")
def _(c):
    layer = F.coalesce("type", "class")
    return candidates(c).select("id", "i", "place_name", geo.place_type(layer, geo.LAYER_PLACES).alias("kind"))
