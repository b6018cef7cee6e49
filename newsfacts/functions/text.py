r"""Text clean-up and term functions.

Python's ``\s`` covers Unicode spaces and \x1c-\x1f; Java's ``\s`` covers neither, so the class is
spelled out here once and used everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's \s matches, as a Java regex class body.
SPACE = r"\t\n\x0B\f\r\x1c-\x1f \x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

# PostgreSQL's english stop word list.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself "
    "she her hers herself it its itself they them their theirs themselves what which who whom this "
    "that these those am is are was were be been being have has had having do does did doing a an "
    "the and but if or because as until while of at by for with about against between into through "
    "during before after above below to from up down in out on off over under again further then "
    "once here there when where why how all any both each few more most other some such no nor not "
    "only own same so than too very s t can will just don should now"
).split()


def collapse_whitespace(col: Column) -> Column:
    """Every run of whitespace becomes one space.

    In two steps, because text is mostly single plain spaces: the first touches only the other
    kinds, the second only repeated spaces.
    """
    return F.regexp_replace(F.regexp_replace(col, f"[{SPACE}&&[^ ]]", " "), " {2,}", " ")


def cleanup_text(col: Column) -> Column:
    """Repair common scraping errors, then keep printable ASCII. The order of the steps matters."""
    headings = "(IMPACT|RESPONSE)"
    col = F.when(
        F.contains(col, F.lit("IMPACT")) | F.contains(col, F.lit("RESPONSE")),
        F.regexp_replace(
            F.regexp_replace(col, f"([a-zA-Z0-9]){headings}", "$1. $2"),
            f"{headings}([a-zA-Z0-9])",
            "$1. $2",
        ),
    ).otherwise(col)
    col = F.regexp_replace(col, r"\p{Nd}(?<=[a-zA-Z]\p{Nd})", ". $0")
    col = F.regexp_replace(col, rf"(\p{{Nd}})[{SPACE}](\p{{Nd}})", "$1$2")
    col = collapse_whitespace(col)
    col = F.replace(col, F.lit("peole"), F.lit("people"))
    # Plain spaces are the only whitespace left, so printable means this range.
    return F.regexp_replace(col, r"[^\x20-\x7E]+", "")


def wordcloud_text(col: Column) -> Column:
    """Drop digits and a few filler strings wherever they occur, also inside words."""
    return F.regexp_replace(col, "[0-9]|said|year|people|says|one|two", "")


def tokens(col: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(col), F.lit("([a-z0-9]+)"), 1)


def term_vector(col: Column, stop_words: list[str] | None = None) -> Column:
    """Tokens in text order without stop words; repeats are kept, so occurrences can be counted."""
    stop = STOP_WORDS if stop_words is None else stop_words
    return F.filter(tokens(col), lambda t: ~t.isin(stop))


def token_text(col: Column) -> Column:
    """All tokens, one space before and after each: a word or phrase is then a plain substring."""
    return F.concat(F.lit(" "), F.array_join(tokens(col), " "), F.lit(" "))


def source_name_from_url(url: Column) -> Column:
    """Text between ``www.`` and the next slash, else between ``//`` and the next slash, else NULL.

    An empty match (``http:///x``) counts as a match, as it does for a Python regex search.
    """
    after_www = r"www[^\n]([^\n]*?)/"
    after_slashes = r"//([^\n]*?)/"
    return (
        F.when(F.regexp_like(url, F.lit(after_www)), F.regexp_extract(url, after_www, 1))
        .when(F.regexp_like(url, F.lit(after_slashes)), F.regexp_extract(url, after_slashes, 1))
    )


def url_host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def parse_figure(text: Column) -> tuple[Column, Column]:
    """(specific, vague): an integer once commas are dropped, else the text itself."""
    bare = F.replace(text, F.lit(","), F.lit(""))
    specific = F.when(F.regexp_like(bare, F.lit(r"^\s*[+-]?[0-9]+\s*$")), bare.try_cast("int"))
    return specific, F.when(specific.isNull(), bare)


def excerpt(content: Column, start: Column, end: Column) -> Column:
    return F.substring(content, start + 1, end - start)
