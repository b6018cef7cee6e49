"""Sources, sinks, stages and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsfacts.catalog.base import query
from newsfacts.catalog.prelude import tokens_sql
from newsfacts.functions import text as tx
from newsfacts.operators import extract as ex
from newsfacts.operators import stages
from newsfacts.plans import flow
from newsfacts.session import new_path
from newsfacts.sources import pages as pg
from newsfacts.sources import readers, writers
from newsfacts.streaming import streams

_NOW = "1999-01-01 00:00:00"


def now():
    return F.lit(_NOW).cast("timestamp_ntz")


# --- readers ------------------------------------------------------------------------------------

@query("read_gkg", """
SELECT id AS url_id, date, document_identifier FROM fx_gkg WHERE id % 13 <> 5""".replace(
    "id AS url_id", "CAST(id AS VARCHAR) AS url_id"))
def _(c):
    """The articles written as a feed, some with a broken date or a URL that is not one."""
    path = new_path(c.spark, "feed")
    key = F.col("id")
    date = F.when(key % 13 == 5, F.when(key % 2 == 0, "no date").otherwise(F.col("date").cast("string"))).otherwise(
        F.col("date").cast("string"))
    url = F.when((key % 13 == 5) & (key % 2 == 1), "ftp://x").otherwise(F.col("document_identifier"))
    empty = F.lit("")
    c.gkg.select(
        key.cast("string").alias("url_id"), "gkgrecordid", date.alias("date"), "source_common_name",
        url.alias("document_identifier"), empty.alias("locations"), empty.alias("v2_counts"),
        empty.alias("v2_themes"),
    ).write.csv(path, escape='"')
    return readers.read_gkg(c.spark, path).select("url_id", "date", "document_identifier")


def _country_tables(c):
    path = new_path(c.spark, "countries")
    key = F.col("n_nationkey")
    c.raw("nation").select(
        F.concat(F.lit("N"), F.lpad(key.cast("string"), 2, "0")).alias("code_3"),
        F.col("n_name").alias("country_name"),
        F.when(key % 2 == 0, F.concat(F.lit("Republic of "), F.col("n_name"))).alias("official_name"),
        F.when(key % 5 == 0, F.concat(F.col("n_name"), F.lit(", the \"old\" one"))).alias("common_name"),
        F.when(key != 7, F.concat(key.cast("string"), F.lit(",-"), key.cast("string"))).alias("latlong"),
    ).write.csv(path, header=True, escape='"')
    return readers.load_countries(c.spark, path)


@query("load_countries", """
SELECT iso3, preferred_term FROM fx_countries""")
def _(c):
    return _country_tables(c).countries


@query("load_country_terms", """
SELECT n_name AS term, 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS country, 1 AS priority FROM nation
UNION ALL SELECT n_name || ', the "old" one', 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0'), 2 FROM nation
WHERE n_nationkey % 5 = 0
UNION ALL SELECT 'Republic of ' || n_name, 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0'), 3 FROM nation
WHERE n_nationkey % 2 = 0""", prelude=False)
def _(c):
    return _country_tables(c).country_terms


@query("load_country_locations", """
SELECT n_name AS location_name, 'country' AS location_type,
  'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS country,
  CASE WHEN n_nationkey <> 7 THEN n_nationkey || ',-' || n_nationkey END AS latlong FROM nation""", prelude=False)
def _(c):
    return _country_tables(c).locations


_SEEDS = [(w, k) for k, words in {**readers.vocab.SEED_KEYWORDS}.items() for w in words]
_SEEDS += [(w, k) for k, words in readers.vocab.ADDED_KEYWORDS.items() for w in words]


@query("load_keywords", """
SELECT description, keyword_type, count(*) AS n FROM (
  SELECT unnest(regexp_extract_all(lower(sentence), '[a-z0-9]+')) AS w FROM fx_sentences) t
JOIN (SELECT DISTINCT * FROM (VALUES """ + ", ".join(f"('{w}', '{k}')" for w, k in _SEEDS) + """)
  v(description, keyword_type)) k ON t.w = k.description GROUP BY ALL""")
def _(c):
    """Occurrences of each stored keyword in the articles."""
    keywords = readers.load_keywords(c.spark, added=readers.vocab.ADDED_KEYWORDS)
    words = c.article_sentences.select(F.explode(tx.tokens(F.col("sentence"))).alias("description"))
    counted = words.groupBy("description").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(keywords, "description").select("description", "keyword_type", "n")


@query("read_labeled_docs", """
SELECT d.doc_id, md5(text) AS text_md5, quality AS is_displacement, source AS category
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""", prelude=False)
def _(c):
    path = new_path(c.spark, "training")
    readers.labeled_docs(c.raw("documents"), c.raw("labels")).select(
        "doc_id", "text", F.col("quality").alias("is_displacement"), F.col("source").alias("category")
    ).write.csv(path, header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False,
                ignoreTrailingWhiteSpace=False)
    rows = readers.read_labeled_docs(c.spark, path)
    return rows.select("doc_id", F.md5("text").alias("text_md5"), "is_displacement", "category")


@query("read_stop_words", f"""
SELECT id, count(*) AS n FROM (SELECT doc_id AS id, unnest({tokens_sql('text')}) AS w FROM documents)
WHERE w NOT IN (SELECT DISTINCT unnest({tokens_sql('text')}) FROM benchmark) GROUP BY id""", prelude=False)
def _(c):
    """Words of every document that are not in a stored list, here the words of the benchmark."""
    path = new_path(c.spark, "stop-words")
    c.raw("benchmark").select(F.explode(tx.tokens(F.col("text")))).distinct().write.text(path)
    stop = readers.read_stop_words(c.spark, path)
    words = c.raw("documents").select(F.col("doc_id").alias("id"), F.explode(tx.tokens(F.col("text"))).alias("word"))
    # Count first: one row per (document, word) meets the list instead of one per occurrence.
    counted = words.groupBy("id", "word").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(stop, "word", "left_anti").groupBy("id").agg(F.sum("n").alias("n"))


@query("label_counts", "SELECT quality, count(*) AS n FROM labels GROUP BY quality", prelude=False)
def _(c):
    return c.raw("labels").groupBy("quality").agg(F.count(F.lit(1)).alias("n"))


@query("label_index", """
SELECT doc_id, lang, CAST(CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 WHEN 'fr' THEN 3 END AS INT)
  AS label FROM documents""", prelude=False)
def _(c):
    return readers.label_index(c.raw("documents").select("doc_id", "lang"), "lang", "label")


@query("english_only", "SELECT doc_id, n_chars FROM documents WHERE lang = 'en'", prelude=False)
def _(c):
    return pg.english_only(c.raw("documents")).select("doc_id", "n_chars")


# --- pages --------------------------------------------------------------------------------------

def _entities(col):
    for entity, char in pg.ENTITIES:
        col = f"replace({col}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return col


def _squeeze(col):
    return f"trim(regexp_replace({col}, '[{tx.SPACE}]+', ' ', 'g'), ' ')"


def _body_sql():
    body = "regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g')"
    for tag in pg.DROPPED:
        body = f"regexp_replace({body}, '(?is)<{tag}(?:\\s[^>]*)?>.*?</{tag}>', ' ', 'g')"
    plain = lambda b: _squeeze(_entities(f"regexp_replace({b}, '<[^>]*>', ' ', 'g')"))
    links = "array_to_string(regexp_extract_all(b, '(?is)<a(?:\\s[^>]*)?>(.*?)</a>', 1), '')"
    keep = (f"length({plain('b')}) > 0 AND length({plain(links)}) <= "
            f"length({plain('b')}) * {pg.MAX_LINK_SHARE}")
    block = pg.BLOCK.replace("'", "''")
    return (f"array_to_string(list_transform(list_filter(string_split_regex({body}, '{block}'), "
            f"lambda b: {keep}), lambda b: {plain('b')}), ' ')")


@query("html_to_article", f"""
SELECT page_id, nullif({_squeeze(_entities("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))}, '') AS title,
  md5({_body_sql()}) AS content_md5,
  CASE WHEN {_body_sql()} = '' THEN 'Content is empty' END AS error FROM pages""", prelude=False)
def _(c):
    return pg.html_to_article(c.raw("pages")).select(
        "page_id", "title", F.md5("content").alias("content_md5"), "error"
    )


_ROUTED = """
SELECT page_id, CASE page_id % 6 WHEN 0 THEN url || '.pdf' WHEN 1 THEN url || '#head' ELSE url END AS url,
  html || CASE page_id % 6 WHEN 2 THEN '<iframe src="/local.pdf"></iframe><iframe class="x" src="http://files.example.org/'
    || page_id || '.pdf"></iframe>' WHEN 3 THEN '<iframe src="http://files.example.org/typed/' || page_id || '"></iframe>'
    WHEN 4 THEN '<iframe src="http://files.example.org/page.html"></iframe>' ELSE '' END AS html FROM pages"""


@query("pdf_route", f"""
SELECT page_id, CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN url
  WHEN 2 THEN 'http://files.example.org/' || page_id || '.pdf'
  WHEN 3 THEN 'http://files.example.org/typed/' || page_id
  ELSE CASE WHEN url LIKE '%.pdf' THEN url END END AS pdf_url FROM ({_ROUTED})""", prelude=False)
def _(c):
    key = F.col("page_id") % 6
    number = F.col("page_id").cast("string")
    routed = c.raw("pages").select(
        "page_id",
        F.when(key == 0, F.concat("url", F.lit(".pdf"))).when(key == 1, F.concat("url", F.lit("#head")))
        .otherwise(F.col("url")).alias("url"),
        F.concat(
            "html",
            F.when(key == 2, F.concat(
                F.lit('<iframe src="/local.pdf"></iframe><iframe class="x" src="http://files.example.org/'),
                number, F.lit('.pdf"></iframe>')))
            .when(key == 3, F.concat(F.lit('<iframe src="http://files.example.org/typed/'), number, F.lit('"></iframe>')))
            .when(key == 4, '<iframe src="http://files.example.org/page.html"></iframe>')
            .otherwise(""),
        ).alias("html"),
    )
    heads = routed.select(
        F.when(key == 1, F.col("url")).otherwise(
            F.concat(F.lit("http://files.example.org/typed/"), number)).alias("url"),
        F.lit("application/pdf").alias("content_type"),
    )
    return pg.pdf_route(routed, heads)


# --- writers ------------------------------------------------------------------------------------

@query("write_content", """
SELECT id, 'text' AS content_type, length(content) AS n, length(content_clean) AS n_clean, len(content_terms) AS n_terms
FROM fx_terms JOIN (SELECT doc_id, text AS content FROM documents) ON doc_id = id""")
def _(c):
    from newsfacts.plans.marts import write_content

    stored = write_content(c.contents, new_path(c.spark, "contents"))
    return stored.select(
        "id", "content_type", F.length("content").cast("long").alias("n"),
        F.length("content_clean").cast("long").alias("n_clean"), F.size("content_terms").cast("long").alias("n_terms"),
    )


@query("write_facts", """
, w_known AS (
  SELECT n_name AS location_name, CAST(n_nationkey AS BIGINT) AS id FROM nation WHERE n_nationkey < 10
), w_names AS (
  SELECT fact, regexp_extract(sentence, ' in ([A-Z_0-9]+)[.]$', 1) AS location_name FROM fx_sentences
  WHERE contains(sentence, ' in ')
), w_new AS (
  SELECT location_name, (SELECT max(id) FROM w_known) + row_number() OVER (ORDER BY location_name) AS id
  FROM (SELECT DISTINCT location_name FROM w_names WHERE location_name NOT IN (SELECT location_name FROM w_known))
)
SELECT DISTINCT fact, id AS location FROM w_names JOIN (SELECT location_name, id FROM w_known UNION ALL
  SELECT location_name, id FROM w_new) USING (location_name)""")
def _(c):
    known = c.raw("nation").filter("n_nationkey < 10").select(
        F.col("n_name").alias("location_name"), F.col("n_nationkey").cast("long").alias("id")
    )
    names = c.raw("nation").select(F.col("n_name").alias("name"))
    found = ex.location_match(ex.tokenise(c.article_sentences), names, ["gkg_id", "fact"])
    _locations, pairs = writers.write_facts(found, known)
    return pairs


_SUBMIT = """
SELECT url AS document_identifier, (SELECT max(id) FROM fx_gkg) + row_number() OVER (ORDER BY url) AS id,
  19990101000000 AS date, CASE WHEN regexp_matches(url, 'www[^\\n][^\\n]*?/') THEN regexp_extract(url, 'www[^\\n]([^\\n]*?)/', 1)
  WHEN regexp_matches(url, '//[^\\n]*?/') THEN regexp_extract(url, '//([^\\n]*?)/', 1) END AS source_common_name
FROM (SELECT DISTINCT url FROM pages)"""


@query("submit_url", _SUBMIT)
def _(c):
    """Page URLs, and the URLs of known articles, which are left out."""
    known = c.gkg.select(F.col("document_identifier").alias("url"))
    urls = c.raw("pages").select("url").unionByName(known)
    rows, _analyses = writers.submit_urls(urls, c.gkg, now())
    return rows.select("document_identifier", "id", "date", "source_common_name")


@query("export_json", """
SELECT id, document_identifier, source_common_name, date FROM fx_gkg""")
def _(c):
    path = new_path(c.spark, "export")
    writers.export_json(c.gkg.select("id", "document_identifier", "source_common_name", "date"), path)
    return c.spark.read.schema(
        "id long, document_identifier string, source_common_name string, date long"
    ).json(path)


# --- stages -------------------------------------------------------------------------------------

@query("initiate", """
SELECT id AS gkg_id, 'new' AS status, CAST(0 AS INT) AS retrieval_attempts FROM fx_gkg
WHERE id NOT IN (SELECT gkg_id FROM fx_analyses)""")
def _(c):
    return writers.initiate(c.gkg, c.analyses, now()).select("gkg_id", "status", "retrieval_attempts")


@query("claim_batch", """
SELECT gkg_id, CASE status WHEN 'classified' THEN 'extracting' ELSE status END AS status FROM fx_analyses""")
def _(c):
    batch = stages.claim_batch(c.analyses, F.col("status") == "classified", "extracting", now())
    return batch.select("gkg_id", "status")


def _needs_content(rows):
    return rows.withColumn(
        "error", F.when(F.col("content_id") % 7 == 3, F.concat(F.lit("bad content "), F.col("content_id").cast("string")))
    ).withColumn("processing_time", (F.col("content_id") % 16).cast("double") / 4)


def _extracting():
    return stages.Stage(
        F.col("status") == "classified", "extracting", "extracted", "extracting failed", _needs_content
    )


_STAGE = """
SELECT gkg_id, CASE WHEN status = 'classified' THEN CASE WHEN content_id % 7 = 3 THEN 'extracting failed'
    ELSE 'extracted' END ELSE status END AS status,
  CASE WHEN status = 'classified' AND content_id % 7 = 3 THEN 'bad content ' || content_id END AS error_msg,
  CASE WHEN status = 'classified' THEN (content_id % 16) / 4.0 END AS processing_time FROM fx_analyses"""


@query("run_stage", _STAGE.replace("(content_id % 16) / 4.0", "CAST((content_id % 16) / 4.0 AS DOUBLE)"))
def _(c):
    table, _history = stages.run_stage(c.analyses, _extracting(), now())
    return table.select("gkg_id", "status", "error_msg", "processing_time")


@query("stage_function", """
SELECT gkg_id, CASE WHEN status = 'new' THEN CASE WHEN retrieval_attempts > 2 THEN 'scraping failed'
  ELSE 'scraped' END ELSE status END AS status FROM fx_analyses""")
def _(c):
    """A user's own selection and function."""
    own = stages.Stage(
        F.col("status") == "new", "scraping", "scraped", "scraping failed",
        lambda rows: rows.withColumn("error", F.when(F.col("retrieval_attempts") > 2, "too many")),
    )
    table, _history = stages.run_stage(c.analyses, own, now())
    return table.select("gkg_id", "status")


@query("stage_timing", f"""
SELECT status, count(*) AS n, avg(processing_time) AS avg_time, max(processing_time) AS max_time,
  count(error_msg) AS failures FROM ({_STAGE}) GROUP BY status""".replace(
    "(content_id % 16) / 4.0", "CAST((content_id % 16) / 4.0 AS DOUBLE)").replace(
    "avg(processing_time)", "round(avg(processing_time), 6)"))
def _(c):
    table, _history = stages.run_stage(c.analyses, _extracting(), now())
    return stages.stage_timing(table).withColumn("avg_time", F.round("avg_time", 6))


_CHANGES = """
, c_changes AS (
  SELECT l_orderkey AS gkg_id, CASE l_linenumber % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'scraped' ELSE 'classified' END AS expected,
    'editing' AS new_status, l_partkey * 100000 + l_suppkey * 10 + l_linenumber AS requested FROM lineitem
), c_winners AS (
  SELECT c.gkg_id, arg_min(c.new_status, c.requested) AS new_status, min(c.requested) AS requested
  FROM c_changes c JOIN fx_analyses a ON c.gkg_id = a.gkg_id AND c.expected = a.status GROUP BY c.gkg_id
)
"""


def changes(c):
    line = F.col("l_linenumber") % 3
    return c.raw("lineitem").select(
        F.col("l_orderkey").alias("gkg_id"),
        F.when(line == 0, "new").when(line == 1, "scraped").otherwise("classified").alias("expected"),
        F.lit("editing").alias("new_status"),
        (F.col("l_partkey") * 100000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("requested"),
    )


@query("advance_status", _CHANGES + """
SELECT a.gkg_id, coalesce(w.new_status, a.status) AS status FROM fx_analyses a LEFT JOIN c_winners w
ON a.gkg_id = w.gkg_id""")
def _(c):
    table, _history, _rejected = stages.advance_status(c.analyses, changes(c), now())
    return table.select("gkg_id", "status")


@query("advance_status_rejected", _CHANGES + """
SELECT c.gkg_id, c.expected, c.requested FROM c_changes c LEFT JOIN c_winners w
ON c.gkg_id = w.gkg_id AND c.requested = w.requested WHERE w.gkg_id IS NULL""")
def _(c):
    _table, _history, rejected = stages.advance_status(c.analyses, changes(c), now())
    return rejected.select("gkg_id", "expected", "requested")


@query("append_history", _CHANGES + """
SELECT a.gkg_id, a.status, count(af.fact) AS n_facts FROM fx_analyses a JOIN c_winners w ON a.gkg_id = w.gkg_id
LEFT JOIN fx_analysis_facts af ON af.analysis = a.gkg_id GROUP BY ALL""")
def _(c):
    _table, before, _rejected = stages.advance_status(c.analyses, changes(c), now())
    empty = before.limit(0).withColumn("history_id", F.lit(0).cast("long"))
    history, bridge = stages.append_history(empty, before, c.analysis_facts)
    counted = bridge.groupBy(F.col("analysis_history").alias("history_id")).agg(F.count(F.lit(1)).alias("n"))
    return history.join(counted, "history_id", "left").select(
        "gkg_id", "status", F.coalesce("n", F.lit(0)).alias("n_facts")
    )


# Versions: every line item is a past version of its order.
_HISTORY = """
, h_versions AS (
  SELECT l_orderkey AS gkg_id, ((l_orderkey*1000000 + l_partkey)*10000 + l_suppkey)*10 + l_linenumber AS history_id,
    l_shipdate AS updated, l_returnflag || l_linenumber AS status FROM lineitem
)
"""


def versions(c):
    return c.raw("lineitem").select(
        F.col("l_orderkey").alias("gkg_id"),
        F.expr("((l_orderkey*1000000 + l_partkey)*10000 + l_suppkey)*10 + l_linenumber").alias("history_id"),
        F.col("l_shipdate").alias("updated"),
        F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("status"),
    )


@query("version_sequence", _HISTORY + """
SELECT gkg_id, history_id, row_number() OVER w AS version, lag(status) OVER w AS previous_status,
  strftime(lead(updated) OVER w, '%Y-%m-%d %H:%M:%S') AS next_updated FROM h_versions
WINDOW w AS (PARTITION BY gkg_id ORDER BY updated, history_id)""")
def _(c):
    return stages.version_sequence(versions(c)).select(
        "gkg_id", "history_id", "version", "previous_status", "next_updated"
    )


@query("latest_version", _HISTORY + """
SELECT gkg_id, history_id, status FROM (SELECT *, row_number() OVER (PARTITION BY gkg_id
  ORDER BY updated DESC, history_id DESC) AS r FROM h_versions) WHERE r = 1""")
def _(c):
    return stages.latest_version(versions(c)).select("gkg_id", "history_id", "status")


@query("capture_errors", """
SELECT id, specific_reported_figure AS value,
  CASE WHEN specific_reported_figure IS NULL THEN 'invalid literal for int() with base 10: ''hundreds''' END AS error
FROM fx_facts""")
def _(c):
    parse = stages.capture_errors(int, "int")
    text = F.coalesce(F.col("specific_reported_figure").cast("string"), "vague_reported_figure")
    out = c.facts.select("id", parse(text).alias("r"))
    return out.select("id", "r.value", "r.error")


_ALL_STAGES = f"""
, r_all AS (
  SELECT gkg_id, status, retrieval_attempts, retrieval_date, content_id FROM fx_analyses
  UNION ALL SELECT id, 'new', 0, NULL, NULL FROM fx_gkg WHERE id NOT IN (SELECT gkg_id FROM fx_analyses)
), r_scraped AS (
  SELECT a.*, d.lang, d.source, CASE WHEN status = 'new' OR (status = 'scraping failed' AND retrieval_attempts < 3
      AND TIMESTAMP '{_NOW}' > retrieval_date + INTERVAL 12 HOUR)
    THEN CASE WHEN d.lang = 'en' THEN 'scraped' ELSE 'scraping failed' END ELSE status END AS s1
  FROM r_all a LEFT JOIN documents d ON a.content_id = d.doc_id
), r_classified AS (
  SELECT *, CASE WHEN s1 = 'scraped' THEN CASE WHEN source = 'src3' THEN 'classifying failed' ELSE 'classified' END
    ELSE s1 END AS s2 FROM r_scraped
), r_extracted AS (
  SELECT *, CASE WHEN s2 = 'classified' THEN 'extracted' ELSE s2 END AS s3 FROM r_classified
), r_bad AS (
  SELECT DISTINCT af.analysis AS gkg_id FROM fx_analysis_facts af JOIN fx_fact_locations fl ON af.fact = fl.fact
  JOIN fx_locations l ON fl.location = l.id WHERE l.latlong IS NULL
)
SELECT r.gkg_id, CASE WHEN s3 = 'extracted' THEN CASE WHEN b.gkg_id IS NULL THEN 'geotagged' ELSE 'geotagging failed' END
  ELSE s3 END AS status FROM r_extracted r LEFT JOIN r_bad b ON r.gkg_id = b.gkg_id"""


@query("run_all_stages", _ALL_STAGES)
def _(c):
    docs = c.raw("documents")
    contents = docs.select(F.col("doc_id").alias("content_id"), "lang")
    predictions = docs.filter("source <> 'src3'").select(
        F.col("doc_id").alias("content_id"), F.lit("Disaster").alias("category"), F.lit(True).alias("relevance")
    )
    bad = (
        c.analysis_facts.join(c.fact_locations, "fact")
        .join(c.locations.filter("latlong is null").select(F.col("id").alias("location")), "location", "left_semi")
        .select(F.col("analysis").alias("gkg_id")).distinct()
    )
    return flow.run_all(c.gkg, c.analyses, contents, predictions, bad, now()).select("gkg_id", "status")


# --- streams ------------------------------------------------------------------------------------

_DAILY_SQL = """
SELECT strftime(day, '%Y-%m-%d') AS day, event_type, n AS count FROM (
  SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY ALL)"""
_WEEKLY_SQL = """
SELECT strftime(week, '%Y-%m-%d') AS week, event_type, n AS count FROM (
  SELECT date_trunc('week', ts) AS week, event_type, count(*) AS n FROM events GROUP BY ALL)"""


def _daily(c):
    events = streams.read_table_stream(c.spark, c.sf_dir, "events.parquet")
    return streams.daily_counts_stream(events, "ts", "event_type")


def _weekly(c):
    events = streams.read_table_stream(c.spark, c.sf_dir, "events.parquet")
    return streams.weekly_counts_stream(events, "ts", "event_type")


@query("daily_counts_stream", _DAILY_SQL, prelude=False)
def _(c):
    return streams.run_updating(_daily(c), "daily", ["day", "event_type"])


@query("weekly_counts_stream", _WEEKLY_SQL, prelude=False)
def _(c):
    return streams.run_updating(_weekly(c), "weekly", ["week", "event_type"])


@query("daily_counts_final", _DAILY_SQL + """
WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""", prelude=False)
def _(c):
    """Days that the watermark has closed; they do not change any more."""
    return streams.run_available(_daily(c), "daily")


@query("weekly_counts_final", _WEEKLY_SQL + """
WHERE week + INTERVAL 7 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""", prelude=False)
def _(c):
    return streams.run_available(_weekly(c), "weekly")


def _initiate_stream(c, interval):
    articles = new_path(c.spark, "articles")
    analyses = new_path(c.spark, "analyses")
    c.gkg.select("id", "date").write.parquet(articles)
    c.analyses.select("gkg_id", "status", "updated").write.parquet(f"{analyses}/batch=-1")
    running = streams.initiate_stream(
        streams.read_table_stream(c.spark, articles), analyses, new_path(c.spark, "state"), now(), interval
    )
    if interval:
        running.processAllAvailable()
        running.stop()
    else:
        running.awaitTermination()
    return c.spark.read.parquet(analyses).select("gkg_id", "status")


_WITH_NEW = """
SELECT gkg_id, status FROM fx_analyses UNION ALL
SELECT id, 'new' FROM fx_gkg WHERE id NOT IN (SELECT gkg_id FROM fx_analyses)"""


@query("initiate_stream", _WITH_NEW)
def _(c):
    return _initiate_stream(c, None)


@query("run_continuous", _WITH_NEW)
def _(c):
    return _initiate_stream(c, "1 second")
