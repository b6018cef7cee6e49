"""Repair jobs and spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsfacts.catalog.base import query
from newsfacts.catalog.prelude import joined_sql, terms_sql, cloud_sql
from newsfacts.functions import spans as sp
from newsfacts.operators import repair
from newsfacts.operators.spans import tag_span_union

# Places stored several times under one name: every customer is a place named by its nation and
# segment.
_DUPLICATES = """
, d_locations AS (
  SELECT c_custkey AS id, c_mktsegment || ' ' || CAST(c_nationkey AS VARCHAR) AS location_name,
    CASE WHEN c_custkey % 50 = 7 THEN 'Q00' ELSE 'N' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') END AS country
  FROM customer
), d_pairs AS (
  SELECT o_orderkey AS fact, o_custkey AS location FROM orders
  UNION ALL SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 10 = 0
)
"""


def duplicate_locations(c):
    return c.raw("customer").select(
        F.col("c_custkey").alias("id"),
        F.concat_ws(" ", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("location_name"),
        F.when(F.col("c_custkey") % 50 == 7, "Q00")
        .otherwise(F.concat(F.lit("N"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0")))
        .alias("country"),
    )


def duplicate_pairs(c):
    pairs = c.raw("orders").select(F.col("o_orderkey").alias("fact"), F.col("o_custkey").alias("location"))
    return pairs.unionAll(pairs.filter("fact % 10 = 0"))


@query("duplicate_names_self_join", _DUPLICATES + """
SELECT a.id, min(b.id) AS canonical FROM d_locations a JOIN d_locations b
ON a.location_name = b.location_name GROUP BY a.id""")
def _(c):
    return repair.canonical_ids(duplicate_locations(c))


@query("canonical_locations", _DUPLICATES + """
SELECT fact, m.canonical AS location FROM d_pairs p JOIN (
  SELECT id, min(id) OVER (PARTITION BY location_name) AS canonical FROM d_locations) m ON p.location = m.id""")
def _(c):
    return repair.canonical_locations(duplicate_pairs(c), duplicate_locations(c))


@query("duplicate_pairs_exists", """
SELECT fact, location, count(*) - 1 AS surplus FROM fx_raw_fact_locations GROUP BY ALL HAVING count(*) > 1""")
def _(c):
    return repair.repeated_pairs(c.raw_fact_locations)


@query("unique_fact_locations", "SELECT DISTINCT fact, location FROM fx_raw_fact_locations")
def _(c):
    return repair.unique_fact_locations(c.raw_fact_locations)


@query("add_unknown_country", "SELECT iso3, preferred_term FROM fx_countries UNION SELECT 'XXX', 'Unknown'")
def _(c):
    return repair.add_unknown_country(c.countries)


@query("backfill_terms", f"""
SELECT id, md5({joined_sql('CASE WHEN id % 2 = 0 THEN [] ELSE content_terms END')}) AS terms_md5 FROM (
  SELECT id, {terms_sql(cloud_sql('content_clean'))} AS content_terms FROM fx_contents)""")
def _(c):
    half = c.stored_contents.select(
        "id", "content_clean",
        F.when(F.col("id") % 2 == 0, F.array().cast("array<string>")).alias("content_terms"),
    )
    return repair.backfill_terms(half).select(
        "id", F.md5(F.array_join("content_terms", ",")).alias("terms_md5")
    )


@query("reset_extraction", """
SELECT a.gkg_id, CASE status WHEN 'extracted' THEN 'classified' ELSE status END AS status,
  CASE status WHEN 'extracted' THEN 0 ELSE count(af.fact) END AS n_facts
FROM fx_analyses a LEFT JOIN fx_analysis_facts af ON a.gkg_id = af.analysis GROUP BY a.gkg_id, a.status""")
def _(c):
    analyses, bridge = repair.reset_extraction(c.analyses, c.analysis_facts)
    counted = bridge.groupBy(F.col("analysis").alias("gkg_id")).agg(F.count(F.lit(1)).alias("n"))
    return analyses.join(counted, "gkg_id", "left").select(
        "gkg_id", "status", F.coalesce("n", F.lit(0)).alias("n_facts")
    )


@query("constraint_checks", _DUPLICATES + """
SELECT 'location name is unique' AS rule, location_name AS key, count(*) AS n FROM d_locations
GROUP BY location_name HAVING count(*) > 1
UNION ALL SELECT 'fact and location are unique', fact || '/' || location, count(*) FROM d_pairs
GROUP BY fact, location HAVING count(*) > 1
UNION ALL SELECT 'location exists', CAST(location AS VARCHAR), count(*) FROM d_pairs
WHERE location NOT IN (SELECT id FROM d_locations) GROUP BY location
UNION ALL SELECT 'fact exists', CAST(fact AS VARCHAR), count(*) FROM d_pairs
WHERE fact NOT IN (SELECT gkg_id FROM fx_analyses) GROUP BY fact
UNION ALL SELECT 'country exists', country, count(*) FROM d_locations
WHERE country NOT IN (SELECT iso3 FROM fx_countries) GROUP BY country""")
def _(c):
    known = c.analyses.select(F.col("gkg_id").alias("id"))
    return repair.constraint_checks(duplicate_pairs(c), duplicate_locations(c), known, c.countries)


# --- spans --------------------------------------------------------------------------------------

# Spans: every line item marks a stretch of its order's text; line and part number place it.
_SPANS = """
, t_spans AS (
  SELECT l_orderkey AS gkg_id, ((l_orderkey*1000000 + l_partkey)*10000 + l_suppkey)*10 + l_linenumber AS seq,
    CASE l_linenumber % 3 WHEN 0 THEN 'loc' WHEN 1 THEN 'term' ELSE 'quantity' END AS type,
    CAST(l_partkey % 40 AS INT) AS start, CAST(l_partkey % 40 + l_suppkey % 9 + 1 AS INT) AS stop
  FROM lineitem
)
"""
_UNION = """
(SELECT gkg_id, string_agg(type, ', ' ORDER BY start) AS type, min(start) AS start, max(stop) AS stop FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY gkg_id ORDER BY start) AS island FROM (
    SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY gkg_id ORDER BY start
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM (
      SELECT gkg_id, start, arg_max(type, seq) AS type, arg_max(stop, seq) AS stop
      FROM t_spans GROUP BY gkg_id, start))) GROUP BY gkg_id, island)"""


def spans(c):
    fact = "((l_orderkey*1000000 + l_partkey)*10000 + l_suppkey)*10 + l_linenumber"
    line = F.col("l_linenumber") % 3
    return c.raw("lineitem").select(
        F.col("l_orderkey").alias("gkg_id"),
        F.expr(fact).alias("seq"),
        F.when(line == 0, "loc").when(line == 1, "term").otherwise("quantity").alias("type"),
        (F.col("l_partkey") % 40).cast("int").alias("start"),
        (F.col("l_partkey") % 40 + F.col("l_suppkey") % 9 + 1).cast("int").alias("end"),
    )


@query("tag_span_union", _SPANS + f"SELECT gkg_id, type, start, stop AS \"end\" FROM {_UNION}")
def _(c):
    return tag_span_union(spans(c)).select("gkg_id", "type", "start", "end")


def _text_spans(c):
    """Per document, three overlapping marks whose place depends on its id."""
    a = (F.col("doc_id") % 7).cast("int")
    marks = F.array(
        F.struct(F.lit("term").alias("type"), (a + 5).alias("start"), (a + 12).alias("end")),
        F.struct(F.lit("loc").alias("type"), F.lit(1).alias("start"), (a + 2).alias("end")),
        F.struct(F.lit("Quantity").alias("type"), F.lit(4).alias("start"), F.lit(6).alias("end")),
        F.struct(F.lit("term").alias("type"), F.lit(4).alias("start"), F.lit(8).alias("end")),
    )
    return c.raw("documents").select("doc_id", "text", marks.cast(sp.SPANS).alias("spans"))


_DOC_SPANS = """
, m_raw AS (
  SELECT doc_id, text, unnest([
    struct_pack(seq := 1, type := 'term', s := CAST(doc_id % 7 + 5 AS INT), e := CAST(doc_id % 7 + 12 AS INT)),
    struct_pack(seq := 2, type := 'loc', s := 1, e := CAST(doc_id % 7 + 2 AS INT)),
    struct_pack(seq := 3, type := 'Quantity', s := 4, e := 6),
    struct_pack(seq := 4, type := 'term', s := 4, e := 8)]) AS m FROM documents
), m_one AS (
  SELECT doc_id, any_value(text) AS text, m.s AS s, arg_max(m.type, m.seq) AS type, arg_max(m.e, m.seq) AS e
  FROM m_raw GROUP BY doc_id, m.s
), m_islands AS (
  SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS island FROM (
    SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY doc_id ORDER BY s
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM m_one)
), m_merged AS (
  SELECT doc_id, any_value(text) AS text, string_agg(type, ', ' ORDER BY s) AS type, min(s) AS s, max(e) AS e
  FROM m_islands GROUP BY doc_id, island
), m_pieces AS (
  SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS done FROM m_merged
)
"""


@query("merge_spans", _DOC_SPANS + """
SELECT doc_id, string_agg(type || ':' || s || '-' || e, ';' ORDER BY s) AS spans FROM m_merged GROUP BY doc_id""")
def _(c):
    flat = F.transform(sp.merge_spans(F.col("spans")), lambda s: F.concat(
        s["type"], F.lit(":"), s["start"].cast("string"), F.lit("-"), s["end"].cast("string")))
    return _text_spans(c).select("doc_id", F.array_join(flat, ";").alias("spans"))


@query("mark_tagged_text", _DOC_SPANS + """
SELECT doc_id, md5(string_agg(substr(text, done + 1, s - done) || '<mark data-entity="' || lower(type) || '">'
  || substr(text, s + 1, e - s) || '</mark>', '' ORDER BY s) || substr(any_value(text), max(e) + 1)) AS marked
FROM m_pieces GROUP BY doc_id""")
def _(c):
    merged = _text_spans(c).select("doc_id", "text", sp.merge_spans(F.col("spans")).alias("spans"))
    return merged.select("doc_id", F.md5(sp.mark_tagged_text(F.col("text"), F.col("spans"))).alias("marked"))


@query("first_span_start", "SELECT doc_id, least(4, CAST(doc_id % 7 + 5 AS INT)) AS first FROM documents")
def _(c):
    return _text_spans(c).select("doc_id", sp.first_span_start(F.col("spans")).alias("first"))


@query("tag_spans_json", """
SELECT doc_id, '[{"type":"term","start":' || (doc_id % 7 + 5) || ',"end":' || (doc_id % 7 + 12)
  || '},{"type":"loc","start":1,"end":' || (doc_id % 7 + 2)
  || '},{"type":"Quantity","start":4,"end":6},{"type":"term","start":4,"end":8}]' AS tags FROM documents""")
def _(c):
    there = sp.spans_to_json(F.col("spans"))
    return _text_spans(c).select("doc_id", sp.spans_to_json(sp.spans_from_json(there)).alias("tags"))
