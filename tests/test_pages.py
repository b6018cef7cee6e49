"""Articles from pages: entities, meta elements and short blocks."""

import pytest
from pyspark.sql import functions as F

from newsfacts.sources import pages


def one(spark, html):
    table = spark.createDataFrame([(1, "http://a.example/x", html)], "page_id long, url string, html string")
    return pages.html_to_article(table).first()


@pytest.mark.parametrize("text, want", [
    ("caf&#233; &#x41;&#X42; &#128512;", "café AB 😀"), ("a &amp;#65; b", "a &#65; b"), ("&#38;lt; &#38;#65;", "&lt; &#65;"),
    ("&#0; &#55296; &#1114112; &#9999999; &#xFFFFFF;", "&#0; &#55296; &#1114112; &#9999999; &#xFFFFFF;"),
    ("&#65;&#65;&#65;", "AAA"), ("&#39;&quot;&#39;", "'\"'"), ("none & some &#; &#x; &#12a;", "none & some &#; &#x; &#12a;"),
    ("", ""), (None, None),
])
def test_entities(spark, text, want):
    table = spark.createDataFrame([(text,)], "t string")
    assert table.select(pages.decode_entities(F.col("t"))).first()[0] == want


def test_meta_in_any_order(spark):
    page = one(spark, """<html><head><title>T</title><meta content="Ann O'Neil" name="author">
      <meta name='description' content='no'><meta property="article:published_time" content='1998-01-02'></head>
      <body><p>Yes.</p></body></html>""")
    assert (page.authors, page.published, page.content, page.error) == ("Ann O'Neil", "1998-01-02", "Yes.", None)
    other = one(spark, """<meta name="authority" content="x"><meta data-x="1" name="author" content="First &amp; Co">
      <meta name="author" content="Second">""")
    assert (other.authors, other.published) == ("First & Co", None)


def test_short_blocks_stay_and_link_lists_go(spark):
    page = one(spark, """<body><div><a href="/1">Home</a> <a href="/2">World</a></div><h1>Flood</h1>
      <p>40 fled.</p><p>More <a href="/3">here</a> on the story of the flood.</p><ul><li><a href="/4">x</a></li></ul>
      <script>var no;</script></body>""")
    assert page.content == "Flood 40 fled. More here on the story of the flood."
    empty = one(spark, "<body><a href='/1'>only</a></body>")
    assert (empty.content, empty.error) == ("", "Content is empty")
    assert one(spark, None).content is None
