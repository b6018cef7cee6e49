"""Common table expressions shared by the checking SQL (DuckDB dialect)."""

from newsfacts.functions.text import SPACE, STOP_WORDS

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_FACT = "((l_orderkey*1000000 + l_partkey)*10000 + l_suppkey)*10 + l_linenumber"
_NATION = "'N' || lpad(CAST({} AS VARCHAR), 2, '0')"


def clean_sql(col: str) -> str:
    """``cleanup_text`` in SQL."""
    steps = [
        ("([a-zA-Z0-9])(IMPACT|RESPONSE)", r"\1. \2"),
        ("(IMPACT|RESPONSE)([a-zA-Z0-9])", r"\1. \2"),
        (r"([a-zA-Z])(\p{Nd})", r"\1. \2"),
        (rf"(\p{{Nd}})[{SPACE}](\p{{Nd}})", r"\1\2"),
        (f"[{SPACE}]+", " "),
    ]
    for pattern, new in steps:
        col = f"regexp_replace({col}, '{pattern}', '{new}', 'g')"
    return f"regexp_replace(replace({col}, 'peole', 'people'), '[^\\x20-\\x7E\\t\\n\\r\\x0b\\x0c]', '', 'g')"


def cloud_sql(col: str) -> str:
    return f"regexp_replace({col}, '[0-9]|said|year|people|says|one|two', '', 'g')"


def tokens_sql(col: str) -> str:
    return f"regexp_extract_all(lower({col}), '[a-z0-9]+')"


def terms_sql(col: str) -> str:
    return f"list_filter({tokens_sql(col)}, lambda t: t NOT IN ({_STOP}))"


def joined_sql(col: str) -> str:
    """An array as comma-separated text, NULL elements spelled out."""
    return (
        f"array_to_string(list_transform({col}, lambda x: coalesce(CAST(x AS VARCHAR), 'NULL')), ',')"
    )


PRELUDE = f"""
WITH fx_gkg AS (
  SELECT o_orderkey AS id, 'rec-' || CAST(o_orderkey AS VARCHAR) AS gkgrecordid,
    CAST(year(o_orderdate) AS BIGINT)*10000000000 + CAST(month(o_orderdate) AS BIGINT)*100000000
      + CAST(day(o_orderdate) AS BIGINT)*1000000 + 174500 AS date,
    'src' || CAST(o_custkey % 20 AS VARCHAR) || '.example.com' AS source_common_name,
    'http://www.src' || CAST(o_custkey % 20 AS VARCHAR) || '.example.com/doc/'
      || CAST(o_orderkey AS VARCHAR) AS document_identifier
  FROM orders WHERE o_orderkey % 17 <> 16 OR o_orderkey % 2 = 0
), fx_analyses AS (
  SELECT o_orderkey AS gkg_id,
    CASE o_orderkey % 9 WHEN 0 THEN 'new' WHEN 1 THEN 'scraping failed' WHEN 2 THEN 'scraped'
      WHEN 3 THEN 'classified' WHEN 4 THEN 'extracted' WHEN 5 THEN 'extracting failed'
      ELSE 'geotagged' END AS status,
    CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS relevance,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'Conflict' WHEN '2-HIGH' THEN 'Disaster'
      WHEN '3-MEDIUM' THEN 'Other' WHEN '5-LOW' THEN 'Disaster' END AS category,
    CAST(o_orderkey % 5 AS INT) AS retrieval_attempts,
    o_orderdate AS retrieval_date, o_orderdate AS updated,
    o_orderkey % (SELECT count(*) FROM documents) AS content_id
  FROM orders WHERE o_orderkey % 17 <> 16
), fx_facts AS (
  SELECT {_FACT} AS id, min(l_orderkey) AS gkg_id,
    min(CASE l_linestatus WHEN 'O' THEN 'Person' ELSE 'Household' END) AS unit,
    min(CASE l_partkey % 6 WHEN 0 THEN 'Displaced' WHEN 1 THEN 'Evacuated' WHEN 2 THEN 'Forced to Flee'
      WHEN 3 THEN 'Homeless' WHEN 4 THEN 'Evicted' ELSE 'Destroyed Housing' END) AS term,
    min(CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE CAST(l_quantity AS INT) *
      CASE l_linenumber WHEN 1 THEN 1 WHEN 2 THEN 10 WHEN 3 THEN 100 WHEN 4 THEN 1000
        WHEN 5 THEN 20000 WHEN 6 THEN 1 ELSE 3000000 END END) AS specific_reported_figure,
    min(CASE WHEN l_suppkey % 7 = 0 THEN 'hundreds' END) AS vague_reported_figure,
    min({_NATION.format('s_nationkey')}) AS iso3
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY {_FACT}
), fx_analysis_facts AS (
  SELECT DISTINCT l_orderkey AS analysis, {_FACT} AS fact FROM lineitem
), fx_locations AS (
  SELECT s_suppkey AS id, s_name AS location_name,
    CASE s_suppkey % 3 WHEN 0 THEN 'city' WHEN 1 THEN 'subdivision' ELSE 'country' END AS location_type,
    {_NATION.format('s_nationkey')} AS country,
    CASE WHEN s_suppkey % 10 <> 9 THEN CAST((s_suppkey*37) % 200 - 100 AS VARCHAR) || ','
      || CAST((s_suppkey*53) % 360 - 180 AS VARCHAR) END AS latlong
  FROM supplier
), fx_countries AS (
  SELECT {_NATION.format('n_nationkey')} AS iso3, n_name AS preferred_term FROM nation
), fx_raw_fact_locations AS (
  SELECT {_FACT} AS fact, l_suppkey AS location FROM lineitem WHERE l_partkey % 11 <> 0
  UNION ALL
  SELECT {_FACT}, l_suppkey - l_suppkey % 10 FROM lineitem
  WHERE l_partkey % 3 = 0 AND l_partkey % 11 <> 0
), fx_fact_locations AS (
  SELECT DISTINCT fact, location FROM fx_raw_fact_locations
), fx_sets AS (
  SELECT fact, array_agg(location ORDER BY location) AS location_ids,
    array_agg(location_name ORDER BY location) AS location_names
  FROM fx_fact_locations LEFT JOIN fx_locations ON location = fx_locations.id GROUP BY fact
), fx_set_ids AS (
  SELECT location_ids, CAST(sum(n) OVER (ORDER BY location_ids) - n + 1 AS BIGINT) AS location_ids_num
  FROM (SELECT location_ids, count(*) AS n FROM fx_sets GROUP BY location_ids)
), fx_fact_sets AS (
  SELECT fact, s.location_ids, location_names, location_ids_num
  FROM fx_sets s LEFT JOIN fx_set_ids i ON s.location_ids = i.location_ids
), fx_fact_api AS (
  SELECT g.document_identifier, g.source_common_name,
    CAST(strptime(substr(CAST(g.date AS VARCHAR),1,8),'%Y%m%d') AS DATE) AS gdelt_day,
    f.id AS fact, f.unit, f.term, f.specific_reported_figure, f.vague_reported_figure, f.iso3,
    fl.location, a.gkg_id, a.category, a.content_id, st.location_ids_num
  FROM fx_facts f JOIN fx_analysis_facts af ON f.id = af.fact
  JOIN fx_analyses a ON af.analysis = a.gkg_id JOIN fx_gkg g ON g.id = a.gkg_id
  JOIN fx_fact_locations fl ON f.id = fl.fact JOIN fx_fact_sets st ON st.fact = f.id
  WHERE a.category IS NOT NULL
), fx_api AS (
  SELECT * FROM fx_fact_api WHERE specific_reported_figure IS NOT NULL
), fx_sentences AS (
  SELECT l_orderkey AS gkg_id, {_FACT} AS fact,
    CASE WHEN l_suppkey % 7 = 0 THEN 'Hundreds of' ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR) END
    || CASE l_linestatus WHEN 'O' THEN ' people were ' ELSE ' families were ' END
    || CASE l_partkey % 5 WHEN 0 THEN 'displaced' WHEN 1 THEN 'evacuated' WHEN 2 THEN 'forced to flee'
      WHEN 3 THEN 'left homeless' ELSE 'evicted' END
    || CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE ' in ' || n_name END || '.' AS sentence
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
), fx_contents AS (
  SELECT doc_id AS id, text AS content, {clean_sql('text')} AS content_clean FROM documents
), fx_terms AS (
  SELECT id, content_clean, {terms_sql(cloud_sql('content_clean'))} AS content_terms,
    ' ' || array_to_string({tokens_sql(cloud_sql('content_clean'))}, ' ') || ' ' AS token_text FROM fx_contents
), fx_validation AS (
  SELECT id AS fact_id,
    CASE id % 4 WHEN 0 THEN 'verified' WHEN 1 THEN 'rejected' WHEN 2 THEN 'in review'
      ELSE 'unknown to the dictionary' END AS status,
    CASE WHEN id % 3 = 0 THEN 'location' END AS missing,
    CASE WHEN id % 7 = 0 THEN 'figure' END AS wrong,
    'analyst' || CAST(id % 9 AS VARCHAR) AS assigned_to
  FROM fx_facts WHERE id % 5 = 0
), fx_validation_values AS (
  SELECT * FROM (VALUES ('verified', 'green'), ('rejected', 'red'), ('in review', 'yellow'),
    ('assigned', 'blue')) v(key_value, display_color)
)
"""
