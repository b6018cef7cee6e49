"""Word features of documents: tokens, stems, phrases, collocations, tf-idf and language."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsfacts.functions import lexicon as lx
from newsfacts.functions import text as tx
from newsfacts.operators.extract import location_match, tokenise
from newsfacts.session import Scratch, ship, written

# Words, or runs of punctuation.
WORD_PUNCT = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"


def word_punct(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD_PUNCT})"), 1)


def _not_digits(t: Column) -> Column:
    return ~F.regexp_like(t, F.lit(r"^\p{Nd}+$"))


def category_tokens(text: Column, stop_words: list[str] = tx.STOP_WORDS) -> Column:
    """Tokens longer than two; stop words are compared before lower-casing; numbers are dropped."""
    kept = F.filter(word_punct(text), lambda t: (F.length(t) > 2) & ~t.isin(stop_words))
    return F.filter(F.transform(kept, F.lower), _not_digits)


def category_stems(
    text: Column, lexicon: lx.Lexicon, stop_words: list[str] = tx.STOP_WORDS
) -> Column:
    """The same with stop words compared in lower case, then reduced to base forms."""
    lower = F.transform(F.filter(word_punct(text), lambda t: F.length(t) > 2), F.lower)
    stems = F.transform(F.filter(lower, lambda t: ~t.isin(stop_words)), lambda t: lx.lemma(t, lexicon))
    return F.filter(stems, _not_digits)


def phrase_features(lemmas: Column) -> Column:
    """Neighbouring lemmas joined: three where there are three, two at the end of the text."""
    starts = F.filter(F.transform(lemmas, lambda _l, i: i), lambda i: i < F.size(lemmas) - 1)
    return F.transform(starts, lambda i: F.array_join(F.slice(lemmas, i + 1, F.lit(3)), "_"))


def pos_features(text: Column, lexicon: lx.Lexicon, stop_words: list[str] = tx.STOP_WORDS) -> Column:
    """Lemmas without stop words, words of one or two letters and numbers."""
    kept = F.filter(
        word_punct(text),
        lambda t: (F.length(t) > 2) & ~t.isin(stop_words) & ~lx.number_like(t),
    )
    return F.transform(kept, lambda t: lx.lemma(t, lexicon))


def _whole(name: Column) -> Column:
    """Pattern of a name where it stands by itself, not within a longer word."""
    letter = r"[\p{L}\p{N}_]"
    return F.concat(F.lit(rf"(?<!{letter})\Q"), name, F.lit(rf"\E(?!{letter})"))


def generalise_entities(
    sentences: DataFrame, gazetteer: DataFrame, keys: list[str], text: str = "sentence"
) -> DataFrame:
    """Countries become one name, other places another, numbers ``1000``; URLs and addresses go.

    ``gazetteer`` holds (name, kind). Longer names are replaced first, and only where they are whole words.
    """
    parsed = tokenise(sentences.withColumnRenamed(text, "sentence"))
    places = location_match(parsed, gazetteer, keys)
    named = places.select(*keys, F.explode("locations").alias("name")).join(
        gazetteer.select("name", "kind"), "name"
    )
    swaps = named.groupBy(*keys).agg(
        F.array_sort(F.collect_set(F.struct(
            (-F.length("name")).alias("n"), "name",
            F.when(F.col("kind") == "country", "Switzerland").otherwise("Geneva").alias("new"),
        ))).alias("_swaps")
    )
    swapped = F.aggregate(
        F.coalesce("_swaps", F.array().cast("array<struct<n:int,name:string,new:string>>")),
        F.col(text), lambda acc, s: F.regexp_replace(acc, _whole(s["name"]), s["new"]),
    )
    address = r"(?i)\b(?:https?://|www\.)\S+|\b[\w.+-]+@[\w-]+\.[\w.-]+"
    bare = F.regexp_replace(swapped, address, " ")
    words = F.transform(F.split(F.trim(tx.collapse_whitespace(bare)), " "),
                        lambda t: F.when(lx.number_like(t), "1000").otherwise(t))
    return sentences.join(swaps, keys, "left").select(*keys, F.array_join(words, " ").alias("text"))


def corpus_word_freq(docs: DataFrame, terms: str = "terms") -> DataFrame:
    return docs.select(F.explode(terms).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def vocab_counts(docs: DataFrame, key: str, terms: str, vocabulary: list[str]) -> DataFrame:
    """(key, word, n) for the words of a fixed vocabulary that occur; counted within each row."""
    found = F.filter(F.col(terms), lambda t: t.isin(vocabulary))
    counts = F.transform(
        F.array_sort(F.array_distinct("_f")),
        lambda w: F.struct(w.alias("word"), F.size(F.filter("_f", lambda x: x == w)).alias("n")),
    )
    return docs.select(key, found.alias("_f")).select(key, F.inline(counts))


def document_frequency(docs: DataFrame, key: str, terms: str) -> tuple[DataFrame, DataFrame]:
    """(key, word, tf) and (word, df)."""
    tf = docs.select(key, F.explode(terms).alias("word")).groupBy(key, "word").agg(
        F.count(F.lit(1)).alias("tf")
    )
    return tf, tf.groupBy("word").agg(F.count(F.lit(1)).alias("df"))


def dictionary(df: DataFrame, n_docs: Column, no_below: int = 5, no_above: float = 0.5) -> DataFrame:
    """Words in at least ``no_below`` documents and at most a share of all."""
    return df.filter((F.col("df") >= no_below) & (F.col("df") <= n_docs * no_above))


def tfidf(
    docs: DataFrame, key: str, terms: str, no_below: int = 5, no_above: float = 0.5
) -> DataFrame:
    """(key, word, weight): tf times log2(documents / df), scaled to unit length per document."""
    n_docs = docs.select(F.count(F.lit(1))).scalar()
    tf, df = document_frequency(docs, key, terms)
    words = dictionary(df, n_docs, no_below, no_above).select(
        "word", F.log2(n_docs / F.col("df")).alias("idf")
    )
    weighted = tf.join(words, "word").select(key, "word", (F.col("tf") * F.col("idf")).alias("w"))
    norms = weighted.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_norm")).filter("_norm > 0")
    return weighted.join(norms, key).select(key, "word", (F.col("w") / F.col("_norm")).alias("weight"))


# --- collocations -------------------------------------------------------------------------------


def collocations(
    docs: DataFrame, terms: str, min_count: int = 5, threshold: float = 10.0
) -> DataFrame:
    """(a, b, n, score) of neighbouring words that occur together more than their counts explain.

    score = (n_ab - min_count) * vocabulary size / (n_a * n_b).
    """
    single = corpus_word_freq(docs, terms)
    pairs = F.transform(
        F.filter(F.transform(terms, lambda _t, i: i), lambda i: i < F.size(terms) - 1),
        lambda i: F.struct(F.get(terms, i).alias("a"), F.get(terms, i + 1).alias("b")),
    )
    together = docs.select(F.inline(pairs)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter(
        F.col("n") >= min_count
    )
    size = single.select(F.count(F.lit(1))).scalar()
    first = single.select(F.col("word").alias("a"), F.col("n").alias("n_a"))
    second = single.select(F.col("word").alias("b"), F.col("n").alias("n_b"))
    score = (F.col("n") - min_count) * size / (F.col("n_a") * F.col("n_b"))
    return together.join(first, "a").join(second, "b").select("a", "b", "n", score.alias("score")).filter(
        F.col("score") > threshold
    )


def join_collocations(docs: DataFrame, key: str, terms: str, accepted: DataFrame) -> DataFrame:
    """Documents with accepted neighbours joined by ``_``, left to right without overlaps."""
    at = docs.select(key, F.posexplode(terms).alias("pos", "a"), F.col(terms).alias("_t")).select(
        key, "pos", "a", F.get("_t", F.col("pos") + 1).alias("b")
    ).filter("b is not null")
    hits = at.join(accepted.select("a", "b"), ["a", "b"], "left_semi").groupBy(key).agg(
        F.array_sort(F.collect_list("pos")).alias("_at")
    )
    return docs.join(hits, key, "left").select(
        key, F.when(F.col("_at").isNull(), F.col(terms)).otherwise(_join_at(terms, "_at")).alias(terms)
    )


@F.pandas_udf(T.ArrayType(T.StringType()))
def _join_at(terms: pd.Series, starts: pd.Series) -> pd.Series:
    """Each list with the words at some positions joined to their successors, the left one first."""
    out = []
    for words, at in zip(terms, starts):
        wanted = set() if at is None else set(at)
        joined, i = [], 0
        while i < len(words):
            pair = i in wanted
            joined.append(f"{words[i]}_{words[i + 1]}" if pair else words[i])
            i += 2 if pair else 1
        out.append(joined)
    return pd.Series(out)


def ngrams(
    docs: DataFrame, key: str, terms: str, min_count: int = 5, threshold: float = 10.0,
    append: bool = False,
) -> DataFrame:
    """Two passes: pairs, then pairs of the result, which are triples and more. With ``append`` the
    joined words follow the original ones instead of replacing them."""
    # Each pass reads its words several times, so they are stored rather than worked out again.
    with Scratch(docs.sparkSession) as scratch:
        words = (written if append else scratch.written)(docs.select(key, terms), "words")

        def accepted(words: DataFrame) -> DataFrame:
            # Stored, so that its size is known: few pairs are sent to all tasks, instead of all positions to their pairs.
            return written(collocations(words, terms, min_count, threshold).select("a", "b"), "accepted")

        once = written(join_collocations(words, key, terms, accepted(words)), "pairs")
    twice = join_collocations(once, key, terms, accepted(once))
    if not append:
        return twice
    both = words.select(key, F.col(terms).alias("_o")).join(twice, key)
    extra = F.filter(terms, lambda t: ~F.array_contains("_o", t))
    return both.select(key, F.concat("_o", extra).alias(terms))


# --- language -----------------------------------------------------------------------------------


def _flat(text: Column) -> Column:
    return tx.collapse_whitespace(F.lower(text))


def _counted_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, gram, n): how often a text (key, text) has each run of three characters.

    A trigram is the number made of its three code points of 21 bits.
    """
    for batch in batches:
        keys, found, times = [], [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            code = np.frombuffer((text or "").encode("utf-32-le"), np.uint32).astype(np.int64)
            if len(code) > 2:
                gram, n = np.unique(code[:-2] << 42 | code[1:-1] << 21 | code[2:], return_counts=True)
                keys.append(pa.repeat(pa.scalar(key, pa.string()), len(gram)))
                found.append(gram)
                times.append(n)
        if found:
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays(keys), pa.array(np.concatenate(found)), pa.array(np.concatenate(times))],
                names=["key", "gram", "n"])


def trigram_counts(texts: DataFrame) -> DataFrame:
    """(key, gram, n) of every row of ``texts`` (key, text): overlapping runs of three characters of the lower-cased
    text, whitespace collapsed, counted where the text is read. Rows of equal keys are not added up."""
    ship(texts.sparkSession)
    return texts.select(F.col("key").cast("string").alias("key"), _flat(F.col("text")).alias("text")).mapInArrow(
        _counted_trigrams, "key string, gram long, n long")


def _gram_text(gram: Column) -> Column:
    points = [F.shiftright(gram, by).bitwiseAND(F.lit(0x1FFFFF)) for by in (42, 21, 0)]
    return F.decode(F.unhex(F.concat(*[F.lpad(F.hex(p), 8, "0") for p in points])), "UTF-32")


def _gram_code(gram: Column) -> Column:
    points = [F.ascii(F.substring(gram, i, 1)).cast("long") for i in (1, 2, 3)]
    return F.shiftleft(points[0], 42) + F.shiftleft(points[1], 21) + points[2]


def language_profiles(docs: DataFrame, text: str, language: str) -> DataFrame:
    """(lang, gram, weight, mass): every trigram of each language in labelled documents.

    ``weight`` is the logarithm of 1 + how often the language has it. ``mass`` is that of all trigrams of the language
    plus one for each trigram known in any language and one for all others: what a trigram that the language lacks
    costs is ``mass``, and one that it has ``mass - weight`` (add-one smoothing).
    """
    labelled = docs.filter(F.col(language).isNotNull()).select(
        F.col(language).alias("key"), F.col(text).alias("text"))
    counted = written(
        trigram_counts(labelled).groupBy(F.col("key").alias("lang"), "gram").agg(F.sum("n").alias("n")), "trigrams")
    known = counted.select("gram").distinct().count()
    mass = counted.groupBy("lang").agg(F.log(F.sum("n") + known + 1).alias("mass"))
    # Stored, so that its size is known when texts are joined with it.
    return written(counted.join(mass, "lang").select(
        "lang", _gram_text(F.col("gram")).alias("gram"), F.log(F.col("n") + 1).alias("weight"), "mass"), "profiles")


def detect_language(docs: DataFrame, text: str, profiles: DataFrame) -> DataFrame:
    """Adds ``detected``: the language under which the text's trigrams are likeliest; ties go to the first in
    alphabetical order. Languages that have none of them are no candidates, so a text of unknown trigrams stays NULL.

    Equal texts are counted together, which changes all their likelihoods alike. Trigrams are counted within a text,
    and each meets its weights in all languages at once; profiles join by trigram, whatever their number.
    """
    keyed = docs.select(F.md5(F.col(text)).alias("key"), F.col(text).alias("text"))
    totals = keyed.groupBy("key").agg(F.sum(F.greatest(F.length(_flat(F.col("text"))) - 2, F.lit(0))).alias("total"))
    weights = profiles.groupBy(_gram_code(F.col("gram")).alias("gram")).agg(
        F.collect_list(F.struct("lang", "weight", "mass")).alias("known"))
    shared = trigram_counts(keyed).join(weights, "gram").select("key", "n", F.inline("known")).groupBy("key", "lang").agg(
        F.sum(F.col("n") * F.col("weight")).alias("gain"), F.max("mass").alias("mass"))
    likely = F.round(F.col("gain") - F.col("total") * F.col("mass"), 6)
    best = shared.join(totals, "key").groupBy("key").agg(
        F.min_by("lang", F.struct((-likely).alias("cost"), "lang")).alias("detected")).withColumnRenamed("key", "_t")
    return docs.withColumn("_t", F.md5(F.col(text))).join(best, "_t", "left").drop("_t")
