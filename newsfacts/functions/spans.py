"""Tagged spans of a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<type:string,start:int,end:int>>"


def spans_to_json(spans: Column) -> Column:
    return F.to_json(spans)


def spans_from_json(text: Column) -> Column:
    return F.from_json(text, SPANS)


def first_span_start(spans: Column) -> Column:
    """Least start among spans that are not places."""
    kept = F.filter(spans, lambda s: s["type"] != "loc")
    return F.array_min(F.transform(kept, lambda s: s["start"]))


def merge_spans(spans: Column) -> Column:
    """Spans of one array: the last of each start, in order, merged where they touch or overlap.

    Spans are sorted once and folded left to right; the running result is (finished, open span).
    """
    indexed = F.transform(spans, lambda s, i: F.struct(
        s["start"].alias("start"), i.alias("i"), s["end"].alias("end"), s["type"].alias("type")))
    ordered = F.array_sort(indexed)
    # Keep the last of each run of equal starts.
    following = F.transform(ordered, lambda s, i: F.struct(
        s["type"].alias("type"), s["start"].alias("start"), s["end"].alias("end"),
        F.get(ordered, i + 1)["start"].alias("next")))
    last = F.filter(following, lambda s: s["next"].isNull() | (s["next"] != s["start"]))
    last = F.transform(last, lambda s: F.struct(s["type"], s["start"], s["end"]).cast(
        "struct<type:string,start:int,end:int>"))
    empty = F.array().cast(SPANS)

    def step(done: Column, s: Column) -> Column:
        open_ = F.get(done, F.size(done) - 1)
        grown = F.struct(
            F.concat(open_["type"], F.lit(", "), s["type"]).alias("type"),
            open_["start"].alias("start"),
            F.greatest(open_["end"], s["end"]).alias("end"),
        )
        return F.when(
            (F.size(done) == 0) | (s["start"] > open_["end"]), F.concat(done, F.array(s))
        ).otherwise(F.concat(F.slice(done, 1, F.size(done) - 1), F.array(grown)))

    return F.aggregate(last, empty, step)


def mark_tagged_text(text: Column, spans: Column) -> Column:
    """Text with every merged span wrapped in a ``mark`` element that names its type."""
    start_of = lambda i: F.coalesce(F.when(i > 0, F.get(spans, i - 1)["end"]), F.lit(0))
    pieces = F.transform(spans, lambda s, i: F.concat(
        F.substring(text, start_of(i) + 1, s["start"] - start_of(i)),
        F.lit('<mark data-entity="'), F.lower(s["type"]), F.lit('">'),
        F.substring(text, s["start"] + 1, s["end"] - s["start"]),
        F.lit("</mark>"),
    ))
    tail_start = F.coalesce(F.get(spans, F.size(spans) - 1)["end"], F.lit(0))
    tail = F.substring(text, tail_start + 1, F.greatest(F.length(text) - tail_start, F.lit(0)))
    return F.concat(F.array_join(pieces, ""), tail)
