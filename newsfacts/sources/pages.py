"""Articles from stored web pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsfacts.functions import text as tx

# Elements whose content is never article text.
DROPPED = ["script", "style", "noscript", "nav", "header", "footer", "aside", "form", "head"]
BLOCK = r"(?i)</?(?:p|div|article|section|main|body|html|h[1-6]|ul|ol|li|table|tr|td|th|blockquote|pre|br|hr)(?:\s[^>]*)?/?>"

# Entities worth decoding, in order; the ampersand comes last.
ENTITIES = [
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
    ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"),
]

MAX_LINK_SHARE = 0.5


NUMERIC = r"&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"


def _character(entity: Column) -> Column:
    """What a numeric entity stands for; itself where that is no character. An ampersand is left to the last step."""
    digits = F.substring(entity, F.lit(3), F.length(entity) - 3)
    code = F.when(F.lower(F.substring(digits, 1, 1)) == "x", F.conv(F.substring(digits, 2, 6), 16, 10)).otherwise(
        digits).cast("long")
    valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    return F.when(code == 38, F.lit("&amp;")).when(
        valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(entity)


def decode_entities(col: Column) -> Column:
    """Numeric entities and the named ones above, each decoded once."""
    found = F.array_distinct(F.regexp_extract_all(col, F.lit(NUMERIC), 0))
    col = F.aggregate(found, col, lambda text, entity: F.replace(text, entity, _character(entity)))
    for entity, char in ENTITIES:
        col = F.replace(col, F.lit(entity), F.lit(char))
    return col


def html_title(html: Column) -> Column:
    return F.nullif(
        F.trim(tx.collapse_whitespace(decode_entities(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))),
        F.lit(""),
    )


def html_meta(html: Column, names: list[str]) -> Column:
    """Content of the first meta element with one of the names, whichever attribute comes first."""
    named = rf"""(?=[^>]*?\b(?:name|property)\s*=\s*["'](?:{"|".join(names)})["'])"""
    pattern = rf"""(?is)<meta\s{named}[^>]*?\bcontent\s*=\s*(?:"([^"]*)"|'([^']*)')"""
    content = F.concat(F.regexp_extract(html, pattern, 1), F.regexp_extract(html, pattern, 2))
    return F.nullif(F.trim(tx.collapse_whitespace(decode_entities(content))), F.lit(""))


def html_body(html: Column) -> Column:
    """Blocks of text in order, whatever their length, without those that are mostly links."""
    body = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    for tag in DROPPED:
        body = F.regexp_replace(body, rf"(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}>", " ")

    def plain(block: Column) -> Column:
        bare = F.regexp_replace(block, r"<[^>]*>", " ")
        return F.trim(tx.collapse_whitespace(decode_entities(bare)))

    def parts(block: Column) -> Column:
        links = F.regexp_extract_all(block, F.lit(r"(?is)<a(?:\s[^>]*)?>(.*?)</a>"), 1)
        return F.struct(
            plain(block).alias("text"),
            F.length(plain(F.array_join(links, ""))).alias("linked"),
        )

    blocks = F.transform(F.split(body, BLOCK), parts)
    kept = F.filter(
        blocks,
        lambda b: (F.length(b["text"]) > 0)
        & (b["linked"] <= F.length(b["text"]) * MAX_LINK_SHARE),
    )
    return F.array_join(F.transform(kept, lambda b: b["text"]), " ")


def html_to_article(pages: DataFrame) -> DataFrame:
    """(page_id, url, title, authors, published, content, error) for each page."""
    html = F.col("html")
    body = pages.select(
        "page_id",
        "url",
        html_title(html).alias("title"),
        html_meta(html, ["author", "article:author"]).alias("authors"),
        html_meta(html, ["article:published_time", "date", "pubdate"]).alias("published"),
        html_body(html).alias("content"),
    )
    return body.withColumn("error", F.when(F.col("content") == "", "Content is empty"))


def pdf_route(pages: DataFrame, content_types: DataFrame) -> DataFrame:
    """(page_id, pdf_url): the page itself when it is a PDF by name or content type, else its first
    embedded frame that is one, else NULL. ``content_types`` holds (url, content_type)."""
    pdf_types = content_types.filter(F.col("content_type") == "application/pdf").select(
        F.col("url").alias("_url")
    ).distinct()
    is_pdf = F.endswith(F.col("url"), F.lit(".pdf")) | F.col("_url").isNotNull()
    src = F.regexp_extract_all(F.col("html"), F.lit(r"""(?is)<iframe[^>]*\ssrc=["']([^"']*)["']"""), 1)
    frames = pages.select("page_id", F.posexplode(src).alias("pos", "url")).filter(
        F.contains(F.col("url"), F.lit("http"))
    )
    first = (
        frames.join(pdf_types, F.col("url") == F.col("_url"), "left")
        .filter(is_pdf)
        .groupBy("page_id")
        .agg(F.min_by("url", "pos").alias("_frame"))
    )
    return (
        pages.select("page_id", "url")
        .join(pdf_types, F.col("url") == F.col("_url"), "left")
        .join(first, "page_id", "left")
        .select("page_id", F.coalesce(F.when(is_pdf, F.col("url")), "_frame").alias("pdf_url"))
    )


def english_only(documents: DataFrame, language: str = "lang") -> DataFrame:
    """Rows whose detected language is English; undetected ones are dropped too."""
    return documents.filter(F.col(language) == "en")
