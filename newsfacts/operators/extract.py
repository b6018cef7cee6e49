"""From article text to facts.

Everything inside a sentence is worked out on arrays within its row; rows meet only for the
gazetteer, for places remembered from earlier sentences and for article relevance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsfacts import vocab
from newsfacts.functions import dates
from newsfacts.functions import lexicon as lx
from newsfacts.functions import text as tx
from newsfacts.operators.keys import scan_within_keys
from newsfacts.session import written

# A word (with inner hyphens, apostrophes and number separators) or one other character.
TOKEN = r"[A-Za-z0-9]+(?:[-'][A-Za-z0-9]+|[.,][0-9]+)*|[^\sA-Za-z0-9]"
SENTENCE_END = r"""(?<=[.!?]) (?=[A-Z0-9"'])"""

# Distances, in tokens.
SECOND_WORD_WINDOW = 3
EVICTION_WINDOW = 3

RUN = 256  # numbers summed at a time
SHORT = 40  # tokens of a sentence whose offsets are counted one by one


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once. An expression that a lambda names is worked out in each of its steps."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_sums(numbers: Column) -> Column:
    """Running sums of an array of integers, each with its own number included.

    An accumulated array is copied at every step, so runs are summed on their own and then shifted by
    the sums of the runs before: a long array costs little more than its length.
    """
    def sums(values: Column, base: Column) -> Column:
        return F.aggregate(
            values, F.struct(base.alias("sum"), F.array().cast("array<int>").alias("all")),
            lambda acc, x: F.struct(
                (acc["sum"] + x).alias("sum"), F.concat(acc["all"], F.array(acc["sum"] + x)).alias("all")),
            lambda acc: acc["all"],
        )

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0), lambda acc, x: acc + x)

    def in_runs(all_: Column) -> Column:
        last = F.floor((F.size(all_) - 1) / RUN).cast("int")
        starts = F.when(F.size(all_) > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda k: F.slice(all_, k * RUN + 1, F.lit(RUN)))

    def shifted(runs: Column) -> Column:
        bases = sums(F.transform(runs, total), F.lit(0))
        return F.flatten(F.transform(
            F.arrays_zip(runs.alias("run"), bases.alias("base")),
            lambda z: sums(z["run"], z["base"] - total(z["run"])),
        ))

    return let(numbers, lambda all_: F.when(F.size(all_).between(0, RUN), sums(all_, F.lit(0))).otherwise(
        let(in_runs(all_), shifted)))


def split_sentences(contents: DataFrame, key: str = "id", text: str = "content_clean") -> DataFrame:
    """(key, sent_no, sentence, sent_start): clean text has single spaces, so offsets add up."""
    sentences = F.split(F.col(text), SENTENCE_END)
    ends = running_sums(F.transform("_s", lambda s: F.length(s) + 1))
    parts = contents.select(key, sentences.alias("_s")).select(
        key, F.arrays_zip(F.col("_s").alias("sentence"), ends.alias("next")).alias("_z")
    )
    return parts.select(key, F.posexplode("_z").alias("sent_no", "z")).select(
        key, "sent_no", F.col("z.sentence").alias("sentence"),
        (F.col("z.next") - F.length("z.sentence") - 1).alias("sent_start"),
    )


def tokenise(sentences: DataFrame) -> DataFrame:
    """Adds ``pieces`` (tokens with the space before them) and ``tokens``."""
    return sentences.withColumn(
        "pieces", F.regexp_extract_all(F.col("sentence"), F.lit(rf"\s*(?:{TOKEN})"), 0)
    ).withColumn("tokens", F.transform("pieces", lambda p: F.ltrim(p)))


def tokens_with_offsets(sentences: DataFrame) -> DataFrame:
    """One row per token: position and character range within the sentence."""
    parsed = tokenise(sentences)
    keep = [c for c in sentences.columns if c != "sentence"]
    ends = running_sums(F.transform("pieces", F.length))
    zipped = parsed.select(*keep, F.arrays_zip(F.col("tokens").alias("token"), ends.alias("end")).alias("_z"))
    return zipped.select(*keep, F.posexplode("_z").alias("pos", "z")).select(
        *keep, "pos", F.col("z.token").alias("token"),
        (F.col("z.end") - F.length("z.token")).alias("start"), F.col("z.end").alias("end"),
    )


def with_lemmas(parsed: DataFrame, lexicon: lx.Lexicon) -> DataFrame:
    return parsed.withColumn("lemmas", F.transform("tokens", lambda t: lx.lemma(t, lexicon)))


def keyword_relevance(sentences: DataFrame, lexicon: lx.Lexicon, key: str = "gkg_id") -> DataFrame:
    """Keys whose text contains a keyword of relevant articles."""
    wanted = lexicon.lemmas(vocab.ARTICLE_KEYWORD)
    forms = [s for s, l in lexicon.surfaces.items() if l in wanted]
    words = tx.tokens(F.col("sentence"))
    return sentences.filter(F.arrays_overlap(words, F.array(*[F.lit(f) for f in forms]))).select(key).distinct()


# --- terms, units and quantities within a sentence ----------------------------------------------

_TERM = "struct<first:int,last:int,lemmas:array<string>,kind:string,needs_relevance:boolean>"


def term_candidates(tokens: Column, lemmas: Column, lexicon: lx.Lexicon) -> Column:
    """Reporting terms of a sentence: token range, lemmas, and the units each may have
    (``person``, ``structure`` or ``both``)."""
    person = lexicon.lemmas(vocab.PERSON_TERM)
    structure = lexicon.lemmas(vocab.STRUCTURE_TERM)
    joint = lexicon.joint_terms()

    def window(i: Column, n: int) -> Column:
        return F.slice(lemmas, i + 2, F.lit(n))

    def second(i: Column, words: list[str]) -> Column:
        """Position of the first of ``words`` shortly after position i, else NULL."""
        near = window(i, SECOND_WORD_WINDOW)
        hits = F.filter(F.transform(near, lambda l, k: F.when(l.isin(words), k)), lambda k: k.isNotNull())
        return i + 1 + F.get(hits, F.lit(0))

    def term(first, last, names, kind, relevance=False) -> Column:
        return F.struct(
            first.alias("first"), last.alias("last"), F.array(*names).alias("lemmas"),
            kind.alias("kind"), F.lit(relevance).alias("needs_relevance"),
        ).cast(_TERM)

    both = F.lit("both")

    def kind_of(word: Column) -> Column:
        return (
            F.when(word.isin(joint), "both").when(word.isin(structure), "structure").otherwise("person")
        )

    def at(l: Column, i: Column) -> Column:
        verb_form = F.lower(F.get(tokens, i)).isin(
            [s for s, b in lexicon.surfaces.items() if b in lexicon.verbs]
        )
        eviction_near = F.exists(window(i, EVICTION_WINDOW), lambda x: x == "eviction")
        helper = second(i, person + structure)
        feared = second(i, person + structure)
        lives = second(i, ["life"])
        return (
            F.when(l == "eviction", term(i, i, [l], both))
            .when(verb_form & l.isin(lexicon.verbs) & ~((l == "force") & eviction_near),
                  term(i, i, [l], kind_of(l)))
            .when(l.isin("leave", "render", "become") & helper.isNotNull(),
                  term(i, helper, [F.lit("leave"), F.get(lemmas, helper)], kind_of(F.get(lemmas, helper))))
            .when(l == "affect", term(i, i, [l], both, relevance=True))
            .when(l.isin("fear", "assume") & feared.isNotNull(),
                  term(i, feared, [l, F.get(lemmas, feared)], kind_of(F.get(lemmas, feared))))
            .when((l == "claim") & lives.isNotNull(),
                  term(i, lives, [l, F.lit("lives")], F.lit("person")))
        )

    return F.filter(F.transform(lemmas, at), lambda t: t.isNotNull())


def _triggers(lexicon: lx.Lexicon) -> list[str]:
    return [*lexicon.verbs, "eviction", "leave", "render", "become", "affect", "fear", "assume", "claim"]


def may_report(sentence: Column, lexicon: lx.Lexicon) -> Column:
    """Whether a sentence holds any word a reporting term can start with. Runs on the bare text, so
    that the other sentences, nearly all of them in ordinary text, are never tokenised."""
    wanted = set(_triggers(lexicon))
    forms = sorted({s for s, l in lexicon.surfaces.items() if l in wanted})
    return F.regexp_like(F.lower(sentence), F.lit(rf"\b(?:{'|'.join(forms)})\b"))


def with_terms(parsed: DataFrame, lexicon: lx.Lexicon) -> DataFrame:
    """One row per reporting term, in a column ``term``. Sentences without one are dropped."""
    candidates = parsed.withColumn(
        "_found", term_candidates(F.col("tokens"), F.col("lemmas"), lexicon)
    )
    # A term inside a two-word term is part of it, not a term of its own.
    outer = F.filter(
        "_found",
        lambda t: ~F.exists("_found", lambda o: (o["first"] < t["first"]) & (t["first"] <= o["last"])),
    )
    return candidates.select(*parsed.columns, F.explode(outer).alias("term"))


def nearest_unit(lemmas: Column, term: Column, lexicon: lx.Lexicon) -> Column:
    """Position of the allowed unit closest to the term, the earlier one of two, else NULL."""
    person = lexicon.lemmas(vocab.PERSON_UNIT)
    structure = lexicon.lemmas(vocab.STRUCTURE_UNIT)
    distances = F.filter(
        F.transform(
            lemmas,
            lambda l, i: F.when(
                (l.isin(person) & (term["kind"] != "structure"))
                | (l.isin(structure) & (term["kind"] != "person")),
                F.struct(
                    F.when(i < term["first"], term["first"] - i).otherwise(i - term["last"]).alias("d"),
                    i.alias("i"),
                ),
            ),
        ),
        lambda d: d.isNotNull(),
    )
    return F.array_min(distances)["i"]


def quantity_before(tokens: Column, lemmas: Column, position: Column, lexicon: lx.Lexicon) -> Column:
    """Position of the last number before the unit at ``position``, else NULL.

    The number may be any distance away within the unit's phrase, which begins after the previous unit,
    a comma, colon, semicolon or bracket, or with the sentence. A unit right before this one ("300
    family homes") belongs to the phrase.
    """
    units = [*lexicon.lemmas(vocab.PERSON_UNIT), *lexicon.lemmas(vocab.STRUCTURE_UNIT)]
    before = F.slice(tokens, 1, position)
    number = F.array_max(F.transform(before, lambda t, k: F.when(lx.number_like(t), k)))
    border = F.array_max(F.transform(F.slice(lemmas, 1, position), lambda l, k: F.when(
        l.isin(",", ";", ":", "(", ")") | (l.isin(units) & (k < position - 1)), k)))
    return let(F.struct(number.alias("number"), border.alias("border")), lambda at: F.when(
        at["border"].isNull() | (at["number"] > at["border"]), at["number"]))


def token_start(pieces: Column, tokens: Column, i: Column) -> Column:
    """Character offset of token i within its sentence."""
    before = F.length(F.array_join(F.slice(pieces, 1, i), ""))
    return before + F.length(F.get(pieces, i)) - F.length(F.get(tokens, i))


def reports(parsed: DataFrame, lexicon: lx.Lexicon) -> DataFrame:
    """One row per report: unit, term, figures and spans. ``parsed`` has pieces, tokens, lemmas."""
    keys = [c for c in parsed.columns if c not in ("pieces", "tokens", "lemmas", "sentence")]
    terms = with_terms(parsed, lexicon)
    # Without a unit, a number right before the verb (or its auxiliary) reports persons.
    first = F.col("term.first")
    auxiliary = F.coalesce(F.get("lemmas", first - 1).isin("was", "were", "been", "are", "is"), F.lit(False))
    bare = F.when(auxiliary, first - 2).otherwise(first - 1)
    bare = F.when((bare >= 0) & lx.number_like(F.get("tokens", bare)), bare)

    def positions(unit: Column) -> Column:
        quantity = F.when(unit.isNotNull(), quantity_before(F.col("tokens"), F.col("lemmas"), unit, lexicon)).otherwise(bare)
        return F.struct(unit.alias("unit_pos"), quantity.alias("qty_pos"))

    # Generated rather than filtered: a filter on columns would work them out once more.
    found = F.filter(
        F.array(let(nearest_unit(F.col("lemmas"), F.col("term"), lexicon), positions)),
        lambda at: at["unit_pos"].isNotNull() | at["qty_pos"].isNotNull())
    located = terms.select("*", F.inline(found))
    unit_lemma = F.get("lemmas", F.col("unit_pos"))
    quantity = F.get("tokens", F.col("qty_pos"))
    specific, vague = tx.parse_figure(quantity)
    offset = F.col("sent_start")

    def span(kind: str, a: Column, b: Column) -> Column:
        start = offset + token_start(F.col("pieces"), F.col("tokens"), a)
        end = offset + token_start(F.col("pieces"), F.col("tokens"), b) + F.length(F.get("tokens", b))
        return F.when(
            a.isNotNull(),
            F.struct(F.lit(kind).alias("type"), start.cast("int").alias("start"), end.cast("int").alias("end")),
        )

    spans = F.filter(
        F.array(
            span("term", F.col("term.first"), F.col("term.last")),
            span("quantity", F.col("qty_pos"), F.col("qty_pos")),
        ),
        lambda s: s.isNotNull(),
    )
    return located.select(
        *keys,
        F.when(F.col("unit_pos").isNull(), vocab.PERSON)
        .otherwise(lx.unit_label(unit_lemma, lexicon)).alias("unit"),
        lx.term_label(F.col("term.lemmas"), F.coalesce(unit_lemma, F.lit(""))).alias("term"),
        specific.alias("specific_reported_figure"),
        vague.alias("vague_reported_figure"),
        offset.alias("excerpt_start"),
        (offset + F.length("sentence")).alias("excerpt_end"),
        spans.alias("tag_spans"),
        F.col("term.needs_relevance").alias("needs_relevance"),
    )


# --- places -------------------------------------------------------------------------------------


def location_match(parsed: DataFrame, gazetteer: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, locations, loc_spans): places of a sentence, longest match first come, in order.

    Runs of tokens that start with a capital are looked up, as written, by equality in a gazetteer;
    matches inside longer ones are dropped. A run is as long as any name with the same first token,
    so names may have any number of tokens.
    """
    names = gazetteer.select("name")
    lengths = (
        names.select(F.regexp_extract_all("name", F.lit(f"(?:{TOKEN})"), 0).alias("_t"))
        .filter(F.size("_t") > 0)
        .groupBy(F.get("_t", F.lit(0)).alias("_first"))
        .agg(F.collect_set(F.size("_t")).alias("_sizes"))
    )
    # In a short sentence the pieces before a capitalised token are counted when it is met; sums over all pieces, for
    # which a long one is not counted again and again, are more work than that.
    short = F.size("pieces") <= SHORT
    longest = F.coalesce(lengths.select(F.max(F.array_max("_sizes"))).scalar(), F.lit(0))
    starts = F.filter(
        F.transform("tokens", lambda t, i: F.when(F.regexp_like(t, F.lit("^[A-Z]")), F.struct(
            i.alias("pos"), t.alias("_first"), F.when(short, token_start(F.col("pieces"), F.col("tokens"), i)).otherwise(
                F.get("_ends", i) - F.length(t)).alias("_at"),
            F.slice("pieces", i + 1, F.col("_longest")).alias("_tail")))),
        lambda s: s.isNotNull(),
    )
    sent_start = F.col("sent_start") if "sent_start" in parsed.columns else F.lit(0)
    candidates = (
        parsed.select(
            *keys, sent_start.alias("_sent_start"), "pieces", "tokens", longest.alias("_longest"),
            F.when(~short, running_sums(F.transform("pieces", F.length))).alias("_ends"))
        .select(*keys, "_sent_start", F.inline(starts))
        .join(lengths, "_first")
        .select(*keys, "pos", "_tail", (F.col("_sent_start") + F.col("_at")).cast("int").alias("start"),
                F.explode("_sizes").alias("n"))
        .filter(F.col("n") <= F.size("_tail"))
        .select(*keys, "pos", "n", "start",
                F.ltrim(F.array_join(F.slice("_tail", 1, F.col("n")), "")).alias("name"))
    )
    # A match lies inside a longer one if one that starts no later ends no earlier.
    end = F.col("pos") + F.col("n")
    earlier = Window.partitionBy(*keys).orderBy("pos", F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    hits = (
        candidates.join(names, "name", "left_semi")
        .withColumn("_reach", F.max(end).over(earlier))
        .filter(F.col("_reach").isNull() | (F.col("_reach") < end))
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("pos", "n", "name", "start"))).alias("h"))
    )
    return hits.select(
        *keys,
        F.col("h.name").alias("locations"),
        F.transform("h", lambda x: F.struct(
            F.lit("loc").alias("type"), x["start"].alias("start"),
            (x["start"] + F.length(x["name"])).cast("int").alias("end"))).alias("loc_spans"),
    )


def location_memory(sentences: DataFrame, key: str, order: str) -> DataFrame:
    """Adds ``remembered``: the locations of the latest earlier sentence of the article with any."""
    return scan_within_keys(
        sentences, [key], [order], last_known={"remembered": "locations"}
    )


# --- facts --------------------------------------------------------------------------------------


def extract_facts(
    sentences: DataFrame,
    gazetteer: DataFrame,
    lexicon: lx.Lexicon | None = None,
    key: str = "gkg_id",
    order: str = "sent_no",
) -> DataFrame:
    """Sentences (key, order, sentence, sent_start) to facts with places. Exact repeats are dropped.

    A sentence without a place takes those of the latest earlier sentence of its article.
    """
    lexicon = lexicon or lx.Lexicon()
    keys = [key, order]
    candidates = tokenise(sentences.filter(may_report(F.col("sentence"), lexicon)))
    found = reports(with_lemmas(candidates, lexicon), lexicon)
    # Reports are few and read several times below, so they are stored, as they are made: without a shuffle.
    found = written(found, "reports")
    # Whether an article is relevant matters only to some terms, so only articles with such a term are looked through.
    unsure = found.filter("needs_relevance").select(key).distinct()
    relevant = written(
        keyword_relevance(sentences.join(unsure, key, "left_semi"), lexicon, key), "relevant")
    found = found.filter(~F.col("needs_relevance")).unionByName(
        found.filter("needs_relevance").join(relevant, key, "left_semi").select(*found.columns)).drop("needs_relevance")
    # Places matter only in articles that report something.
    reporting = sentences.join(found.select(key), key, "left_semi")
    placed = reporting.select(*keys).join(
        location_match(tokenise(reporting), gazetteer, keys), keys, "left"
    )
    remembered = location_memory(placed, key, order)
    spans = F.concat("tag_spans", F.coalesce("loc_spans", F.array().cast("array<struct<type:string,start:int,end:int>>")))
    return (
        found.join(remembered, keys)
        .withColumn("locations", F.coalesce("locations", "remembered"))
        .withColumn("tag_spans", spans)
        .drop("remembered", "loc_spans", "sent_start")
        .dropDuplicates()
    )


def extract_dates(
    contents: DataFrame, key: str, text: str, published: str
) -> DataFrame:
    """(key, phrase, date): likely event dates named in a text."""
    phrases = contents.select(
        key, published, F.explode(F.regexp_extract_all(F.col(text), F.lit(dates.PHRASE), 0)).alias("phrase")
    )
    resolved = phrases.withColumn("date", dates.resolve_relative_date(F.col("phrase"), F.col(published)))
    return resolved.filter(
        F.col("date").isNotNull() & dates.date_likelihood(F.col("date"), F.col(published))
    ).select(key, "phrase", "date")
