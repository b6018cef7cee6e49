"""Scalar text functions over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsfacts.catalog.base import query
from newsfacts.catalog.prelude import joined_sql
from newsfacts.functions import text as tx
from newsfacts.functions.text import SPACE


@query("cleanup_text", "SELECT id, md5(content_clean) AS clean_md5, length(content_clean) AS n FROM fx_contents")
def _(c):
    return c.contents.select(
        "id", F.md5("content_clean").alias("clean_md5"), F.length("content_clean").cast("long").alias("n")
    )


@query("collapse_whitespace", f"""
SELECT conv_id, turn, regexp_replace(text, '[{SPACE}]+', ' ', 'g') AS text FROM conversations""", prelude=False)
def _(c):
    return c.raw("conversations").select("conv_id", "turn", tx.collapse_whitespace(F.col("text")).alias("text"))


@query("wordcloud_text", """
SELECT doc_id, md5(regexp_replace(text, '[0-9]|said|year|people|says|one|two', '', 'g')) AS text_md5
FROM documents""", prelude=False)
def _(c):
    return c.raw("documents").select("doc_id", F.md5(tx.wordcloud_text(F.col("text"))).alias("text_md5"))


@query("term_vector", f"""
SELECT id, len(content_terms) AS n, md5({joined_sql('content_terms')}) AS terms_md5 FROM fx_terms""")
def _(c):
    return c.stored_contents.select(
        "id", F.size("content_terms").cast("long").alias("n"),
        F.md5(F.array_join("content_terms", ",")).alias("terms_md5"),
    )


@query("source_name_from_url", r"""
SELECT page_id, CASE WHEN regexp_matches(url, 'www[^\n][^\n]*?/') THEN regexp_extract(url, 'www[^\n]([^\n]*?)/', 1)
  WHEN regexp_matches(url, '//[^\n]*?/') THEN regexp_extract(url, '//([^\n]*?)/', 1) END AS source FROM pages
UNION ALL SELECT -id, source_common_name FROM fx_gkg""")
def _(c):
    pages = c.raw("pages").select("page_id", "url")
    articles = c.gkg.select((-F.col("id")).alias("page_id"), F.col("document_identifier").alias("url"))
    return pages.unionByName(articles).select(
        "page_id", tx.source_name_from_url(F.col("url")).alias("source")
    )


@query("url_host", """
SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)) AS host FROM pages""", prelude=False)
def _(c):
    return c.raw("pages").select("page_id", tx.url_host(F.col("url")).alias("host"))


@query("excerpt", """
SELECT doc_id, substr(text, CAST(doc_id % 50 AS INT) + 1, CAST(doc_id % 90 AS INT)) AS excerpt
FROM documents""", prelude=False)
def _(c):
    start = (F.col("doc_id") % 50).cast("int")
    end = start + (F.col("doc_id") % 90).cast("int")
    return c.raw("documents").select("doc_id", tx.excerpt(F.col("text"), start, end).alias("excerpt"))


@query("json_object", """
SELECT id, '{"location_name":"' || location_name || '","location_type":"' || location_type
  || '","iso3":"' || country || '"' || coalesce(',"latlong":"' || latlong || '"', '') || '}' AS entry
FROM fx_locations""")
def _(c):
    row = F.struct("location_name", "location_type", F.col("country").alias("iso3"), "latlong")
    return c.locations.select("id", F.to_json(row).alias("entry"))
