"""Text queries over a stored positional index.

The index has a row for each term and content, with the places of the term among the content's tokens. It lies in a
folder for each first character and is sorted by term within, so a word or a prefix reads its own folder and, of that,
only the row groups that hold it. Stop words are indexed too, as phrases may hold them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsfacts.functions import text as tx
from newsfacts.session import Scratch, tidy

# --- queries -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Word:
    """A word, or all words that begin with it."""

    text: str
    prefix: bool = False


@dataclass(frozen=True)
class Phrase:
    """Words that follow each other directly; a single word is a phrase of one."""

    words: tuple[Word, ...]


@dataclass(frozen=True)
class Not:
    child: Phrase | Not | And | Or


@dataclass(frozen=True)
class And:
    children: tuple


@dataclass(frozen=True)
class Or:
    children: tuple


_SYMBOL = re.compile(r"\s*(<->|[&|!()]|(?:[^\s&|!()<]|<(?!->))+)")

_OPERATORS = {"&", "|", "!", "(", ")", "<->"}


def parse_text_query(query: str) -> Phrase | Not | And | Or | None:
    """``|`` binds least, then ``&``, ``!``, and ``<->`` between words; parentheses group.

    ``word:*`` is a prefix. What is neither letter nor digit parts words, which then follow each other: ``a-b`` and
    ``a b`` are ``a <-> b``. A stop word on its own is left out together with its operator; None is left of a query of
    stop words alone, which matches nothing.
    """
    symbols = _SYMBOL.findall(query)
    at = 0

    def peek() -> str | None:
        return symbols[at] if at < len(symbols) else None

    def take() -> str:
        nonlocal at
        at += 1
        return symbols[at - 1]

    def several(symbol: str, part, node):
        found = [part()]
        while peek() == symbol:
            take()
            found.append(part())
        found = [f for f in found if f is not None]
        return node(tuple(found)) if len(found) > 1 else found[0] if found else None

    def any_of():
        return several("|", all_of, Or)

    def all_of():
        return several("&", maybe_not, And)

    def maybe_not():
        if peek() != "!":
            return group_or_phrase()
        take()
        child = maybe_not()
        return None if child is None else Not(child)

    def group_or_phrase():
        if peek() == "(":
            take()
            inner = any_of()
            if peek() != ")":
                raise ValueError(f"a parenthesis is not closed: {query}")
            take()
            if peek() == "<->":
                raise ValueError(f"only words follow each other: {query}")
            return inner
        words: list[Word] = []
        while True:
            if peek() is None or peek() in _OPERATORS:
                raise ValueError(f"a word is missing: {query}")
            while peek() is not None and peek() not in _OPERATORS:
                symbol = take().lower()
                prefix = symbol.endswith(":*")
                found = re.findall("[a-z0-9]+", symbol)
                words += [Word(w, prefix and i == len(found) - 1) for i, w in enumerate(found)]
            if peek() != "<->":
                break
            take()
        if all(not w.prefix and w.text in tx.STOP_WORDS for w in words):
            return None
        return Phrase(tuple(words))

    if not symbols:
        return None
    tree = any_of()
    if at < len(symbols):
        raise ValueError(f"not understood from {symbols[at]!r} on: {query}")
    return tree


def text_predicate(query: str, token_text: Column) -> Column:
    """The query as a test of one stored token text (all tokens, a space before and after each)."""

    def test(node) -> Column:
        if isinstance(node, Not):
            return ~test(node.child)
        if isinstance(node, (And, Or)):
            return reduce(and_ if isinstance(node, And) else or_, map(test, node.children))
        if any(w.prefix for w in node.words[:-1]):
            pattern = " ".join(w.text + ("[a-z0-9]*" if w.prefix else "") for w in node.words)
            return F.regexp_like(token_text, F.lit(f" {pattern}" + ("" if node.words[-1].prefix else " ")))
        return F.contains(token_text, F.lit(
            " " + " ".join(w.text for w in node.words) + ("" if node.words[-1].prefix else " ")))

    tree = parse_text_query(query)
    return F.lit(False) if tree is None else test(tree)


# --- the index ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class TextIndex:
    """``postings`` (head, term, id, places), ``frequencies`` (head, term, n) and the ``ids`` of all indexed contents."""

    postings: DataFrame
    frequencies: DataFrame
    ids: DataFrame


def postings(contents: DataFrame) -> DataFrame:
    """(term, id, places): contents (id, token_text) turned over. Rows that repeat an id are one content."""
    each = contents.select("id", F.posexplode(F.split(F.trim("token_text"), " ")).alias("place", "term"))
    # A content's places of one term: as many as the content has tokens at most.
    return each.filter("term <> ''").groupBy("term", "id").agg(F.array_sort(F.collect_set("place")).alias("places"))


def write_index(contents: DataFrame, path: str) -> TextIndex:
    """Index contents (id, token_text); contents without a text are in no list and match nothing, negations included."""
    spark = contents.sparkSession
    with Scratch(spark) as scratch, tidy(spark):
        # Stored before they are ranged: the ranges are found from a sample, for which all lists would be made twice.
        lists = scratch.written(postings(contents), "lists")
        (
            lists.withColumn("head", F.substring("term", 1, 1))
            # A range over (term, id) spreads the list of a frequent term over many tasks and files.
            .repartitionByRange("term", "id").sortWithinPartitions("head", "term", "id")
            .write.partitionBy("head").parquet(f"{path}/postings")
        )
        (
            spark.read.schema("term string, head string").parquet(f"{path}/postings").groupBy("head", "term")
            .agg(F.count(F.lit(1)).alias("n")).repartitionByRange("head", "term").sortWithinPartitions("head", "term")
            .write.partitionBy("head").parquet(f"{path}/frequencies")
        )
        contents.filter("token_text is not null").select("id").distinct().write.parquet(f"{path}/ids")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> TextIndex:
    """``head`` is named as text, since folders of digits alone would be read as numbers."""
    return TextIndex(
        spark.read.schema("term string, id long, places array<int>, head string").parquet(f"{path}/postings"),
        spark.read.schema("term string, n long, head string").parquet(f"{path}/frequencies"),
        spark.read.parquet(f"{path}/ids"),
    )


# --- search ------------------------------------------------------------------------------------


def _asked(word: Word) -> Column:
    """The rows of a word or prefix: a folder, and a range of terms that the files' statistics know."""
    head = F.col("head") == word.text[0]
    if not word.prefix:
        return head & (F.col("term") == word.text)
    return head & (F.col("term") >= word.text) & (F.col("term") < word.text + "{")  # comes after the letters


def _words(node) -> set[Word]:
    if isinstance(node, Phrase):
        return set(node.words)
    return _words(node.child) if isinstance(node, Not) else set().union(*map(_words, node.children))


def _frequencies(index: TextIndex, words: list[Word]) -> dict[Word, int]:
    """Rows of each word's list; as many numbers as the query has words."""
    if not words:
        return {}
    asked = index.frequencies.filter(reduce(or_, map(_asked, words)))
    found = asked.agg(*[F.sum(F.when(_asked(w), F.col("n"))).alias(f"n{i}") for i, w in enumerate(words)]).first()
    return {w: found[i] or 0 for i, w in enumerate(words)}


def _moved(places: str, by: int) -> Column:
    return F.transform(places, lambda place: place - by)


def search(index: TextIndex, query: str) -> DataFrame:
    """(id): contents that match. Lists are intersected from the rarest on, a phrase's with places moved by the word's
    number; the complement of a list is taken only where nothing else bounds it."""
    tree = parse_text_query(query)
    nothing = index.ids.limit(0)
    if tree is None:
        return nothing
    sizes = _frequencies(index, sorted(_words(tree), key=lambda w: (w.text, w.prefix)))

    def size(node) -> float:
        """Most ids that a node can have."""
        if isinstance(node, Phrase):
            return min(sizes[w] for w in node.words)
        if isinstance(node, Not):
            return float("inf")
        return (min if isinstance(node, And) else sum)(map(size, node.children))

    def found(node) -> DataFrame:
        if size(node) == 0:
            return nothing
        if isinstance(node, Phrase):
            return phrase(node)
        if isinstance(node, Not):
            return index.ids.join(found(node.child), "id", "left_anti")
        if isinstance(node, Or):
            return reduce(DataFrame.union, map(found, node.children)).distinct()
        wanted = sorted((c for c in node.children if not isinstance(c, Not)), key=size)
        out = found(wanted[0]) if wanted else index.ids
        for child in wanted[1:]:
            out = out.join(found(child), "id", "left_semi")
        for child in node.children:
            if isinstance(child, Not):
                out = out.join(found(child.child), "id", "left_anti")
        return out

    def phrase(node: Phrase) -> DataFrame:
        if len(node.words) == 1:
            rows = index.postings.filter(_asked(node.words[0])).select("id")
            return rows.distinct() if node.words[0].prefix else rows
        out = None
        for i in sorted(range(len(node.words)), key=lambda i: sizes[node.words[i]]):
            rows = index.postings.filter(_asked(node.words[i]))
            if node.words[i].prefix:  # several terms of a content
                rows = rows.groupBy("id").agg(F.flatten(F.collect_list("places")).alias("places"))
            begin = rows.select("id", _moved("places", i).alias("begin"))
            out = begin if out is None else (
                out.join(begin.withColumnRenamed("begin", "other"), "id")
                .select("id", F.array_intersect("begin", "other").alias("begin")).filter(F.size("begin") > 0))
        return out.select("id")

    return found(tree)
