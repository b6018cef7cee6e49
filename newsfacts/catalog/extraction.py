"""From article text to facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsfacts import vocab
from newsfacts.catalog.base import query
from newsfacts.functions import dates
from newsfacts.functions import lexicon as lx
from newsfacts.functions import text as tx
from newsfacts.operators import extract as ex
from newsfacts.plans import marts
from newsfacts.session import new_path, written
from newsfacts.sources import fact_store

LEXICON = lx.Lexicon()
_TOKEN = ex.TOKEN.replace("'", "''")
_RULES = ", ".join(f"('{s}', '{l}', '{k}')" for s, l, k in LEXICON.rows())

# The templated sentences, taken apart again.
_PARTS = f"""
, e_parts AS (
  SELECT gkg_id, fact, sentence,
    CASE WHEN contains(sentence, ' people were ') THEN 'people' ELSE 'families' END AS unit_word,
    CASE WHEN contains(sentence, ' people were ') THEN 'Person' ELSE 'Household' END AS unit,
    regexp_extract(sentence, '^(Hundreds|[0-9]+)', 1) AS figure,
    regexp_extract(sentence, '(displaced|evacuated|forced to flee|left homeless|evicted)', 1) AS verb,
    nullif(regexp_extract(sentence, ' in ([A-Z_0-9]+)[.]$', 1), '') AS place
  FROM fx_sentences
), e_terms AS (
  SELECT e.*, t.first_word, t.last_word, t.kind, t.label, t.lemmas FROM e_parts e JOIN (VALUES
    ('displaced', 'displaced', 'displaced', 'person', 'Displaced', 'displace'),
    ('evacuated', 'evacuated', 'evacuated', 'both', 'Evacuated', 'evacuate'),
    ('forced to flee', 'forced', 'forced', 'person', 'Displaced', 'force'),
    ('forced to flee', 'flee', 'flee', 'person', 'Forced to Flee', 'flee'),
    ('left homeless', 'left', 'homeless', 'person', 'Homeless', 'leave,homeless'),
    ('evicted', 'evicted', 'evicted', 'person', 'Evicted', 'evict')
  ) t(verb, first_word, last_word, kind, label, lemmas) ON e.verb = t.verb
)
"""


def sentences(c):
    return c.article_sentences.withColumn("sent_start", F.lit(0))


def gazetteer(c):
    return c.raw("nation").select(F.col("n_name").alias("name"))


def parts(name, sql):
    return query(name, _PARTS + sql)


@query("split_sentences", """
SELECT id, count(*) AS n, sum(pos * sent_start) AS weighted, max(sent_start + length(sentence)) AS last_end,
  md5(string_agg(sentence, '|' ORDER BY pos)) AS text_md5
FROM (SELECT id, pos, sentence, CAST(coalesce(sum(length(sentence) + 1) OVER (PARTITION BY id ORDER BY pos
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS sent_start
  FROM (SELECT id, unnest(parts) AS sentence, unnest(range(len(parts))) AS pos FROM (
    SELECT id, string_split(regexp_replace(content_clean, '([.!?]) ([A-Z0-9"''])', '\\1' || chr(1) || '\\2', 'g'),
      chr(1)) AS parts FROM fx_contents)))
GROUP BY id""".replace("sum(pos * sent_start)", "CAST(sum(pos * sent_start) AS BIGINT)"))
def _(c):
    s = ex.split_sentences(c.stored_contents)
    ordered = F.transform(
        F.array_sort(F.collect_list(F.struct("sent_no", "sentence"))), lambda x: x["sentence"]
    )
    return s.groupBy("id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("sent_no").cast("long") * F.col("sent_start")).alias("weighted"),
        F.max(F.col("sent_start").cast("long") + F.length("sentence")).alias("last_end"),
        F.md5(F.array_join(ordered, "|")).alias("text_md5"),
    )


@query("tokens_with_offsets", f"""
SELECT id, count(*) AS n, CAST(sum(length(token)) AS BIGINT) AS chars, CAST(sum(stop) AS BIGINT) AS ends
FROM (SELECT id, regexp_replace(piece, '^\\s+', '') AS token,
    sum(length(piece)) OVER (PARTITION BY id ORDER BY pos) AS stop
  FROM (SELECT id, unnest(p) AS piece, unnest(range(len(p))) AS pos FROM (
    SELECT id, regexp_extract_all(content_clean, '\\s*(?:{_TOKEN})') AS p FROM fx_contents)))
GROUP BY id""")
def _(c):
    whole = c.stored_contents.select("id", F.col("content_clean").alias("sentence"))
    return ex.tokens_with_offsets(whole).groupBy("id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.length("token")).alias("chars"),
        F.sum("end").alias("ends"),
    )


@query("lemma_lookup", f"""
SELECT coalesce(l.lemma, w) AS lemma, count(*) AS n FROM (
  SELECT unnest(regexp_extract_all(lower(sentence), '{_TOKEN}')) AS w FROM fx_sentences) t
LEFT JOIN (SELECT DISTINCT surface, lemma FROM (VALUES {_RULES}, ('left', 'leave', '-')) v(surface, lemma, kind)) l
ON l.surface = w GROUP BY 1""")
def _(c):
    parsed = ex.with_lemmas(ex.tokenise(sentences(c)), LEXICON)
    return parsed.select(F.explode("lemmas").alias("lemma")).groupBy("lemma").agg(
        F.count(F.lit(1)).alias("n")
    )


@query("joint_terms", """
SELECT 'evacuate' AS lemma, count(*) AS n FROM fx_sentences WHERE contains(sentence, 'evacuated')""")
def _(c):
    """Occurrences of the terms that take persons and structures alike."""
    parsed = ex.with_lemmas(ex.tokenise(sentences(c)), LEXICON)
    spark = c.spark
    person = spark.createDataFrame([(t,) for t in LEXICON.lemmas(vocab.PERSON_TERM)], "lemma string")
    structure = spark.createDataFrame([(t,) for t in LEXICON.lemmas(vocab.STRUCTURE_TERM)], "lemma string")
    joint = person.intersect(structure)
    return parsed.select(F.explode("lemmas").alias("lemma")).join(joint, "lemma", "left_semi").groupBy(
        "lemma"
    ).agg(F.count(F.lit(1)).alias("n"))


def _occurrences(c, kinds):
    """Occurrences of all keywords of some kinds, the lists concatenated."""
    parsed = ex.with_lemmas(ex.tokenise(sentences(c)), LEXICON)
    lists = [
        c.spark.createDataFrame([(w, k) for w in LEXICON.lemmas(k)], "lemma string, kind string")
        for k in kinds
    ]
    union = lists[0].unionAll(lists[1])
    words = parsed.select(F.explode("lemmas").alias("lemma")).groupBy("lemma").agg(F.count(F.lit(1)).alias("n"))
    return words.join(union, "lemma").select("lemma", "kind", "n")


_OCCUR = f"""
SELECT lemma, kind, count(*) AS n FROM (
  SELECT unnest(regexp_extract_all(lower(sentence), '{_TOKEN}')) AS w FROM fx_sentences) t
JOIN (VALUES {_RULES}) l(surface, lemma, kind) ON l.surface = w WHERE kind IN {{}} GROUP BY ALL"""


@query("all_terms", _OCCUR.format("('person_term', 'structure_term')"))
def _(c):
    return _occurrences(c, [vocab.PERSON_TERM, vocab.STRUCTURE_TERM])


@query("all_units", _OCCUR.format("('person_unit', 'structure_unit')"))
def _(c):
    return _occurrences(c, [vocab.PERSON_UNIT, vocab.STRUCTURE_UNIT])


@query("keyword_relevance", """
SELECT DISTINCT gkg_id FROM fx_sentences WHERE contains(sentence, 'Hundreds')""")
def _(c):
    return ex.keyword_relevance(
        sentences(c), lx.Lexicon({vocab.ARTICLE_KEYWORD: ["Hundred"]})
    )


@parts("term_match", """
SELECT gkg_id, fact, lemmas, kind, position(first_word IN sentence) - 1 AS start FROM e_terms""")
def _(c):
    found = _terms(c)
    start = ex.token_start(F.col("pieces"), F.col("tokens"), F.col("term.first"))
    return found.select(
        "gkg_id", "fact", F.array_join("term.lemmas", ",").alias("lemmas"), F.col("term.kind").alias("kind"),
        start.cast("long").alias("start"),
    )


def _terms(c):
    return ex.with_terms(ex.with_lemmas(ex.tokenise(sentences(c)), LEXICON), LEXICON)


@parts("unit_search", "SELECT gkg_id, fact, lemmas, unit_word FROM e_terms")
def _(c):
    unit = F.get("tokens", ex.nearest_unit(F.col("lemmas"), F.col("term"), LEXICON))
    return _terms(c).select(
        "gkg_id", "fact", F.array_join("term.lemmas", ",").alias("lemmas"), unit.alias("unit_word")
    )


@parts("quantity_search", "SELECT gkg_id, fact, lemmas, figure FROM e_terms")
def _(c):
    unit = ex.nearest_unit(F.col("lemmas"), F.col("term"), LEXICON)
    figure = F.get("tokens", ex.quantity_before(F.col("tokens"), F.col("lemmas"), F.col("u"), LEXICON))
    return _terms(c).withColumn("u", unit).select(
        "gkg_id", "fact", F.array_join("term.lemmas", ",").alias("lemmas"), figure.alias("figure")
    )


@parts("location_match", "SELECT gkg_id, fact, place AS locations FROM e_parts WHERE place IS NOT NULL")
def _(c):
    matched = ex.location_match(ex.tokenise(sentences(c)), gazetteer(c), ["gkg_id", "fact"])
    return matched.select("gkg_id", "fact", "locations")


@parts("location_memory", """
SELECT gkg_id, fact, last_value(place IGNORE NULLS) OVER (PARTITION BY gkg_id ORDER BY fact
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS remembered FROM e_parts""")
def _(c):
    matched = ex.location_match(ex.tokenise(sentences(c)), gazetteer(c), ["gkg_id", "fact"])
    placed = sentences(c).select("gkg_id", "fact").join(
        matched.select("gkg_id", "fact", "locations"), ["gkg_id", "fact"], "left"
    )
    return ex.location_memory(placed, "gkg_id", "fact").select("gkg_id", "fact", "remembered")


@parts("next_previous_token", """
SELECT gkg_id, fact, first_word, regexp_extract(sentence, '([A-Za-z0-9]+) ' || first_word || '\\b', 1) AS previous,
  CASE WHEN first_word = 'forced' THEN 'to' WHEN first_word = 'left' THEN 'homeless'
    WHEN place IS NULL THEN '.' ELSE 'in' END AS following FROM e_terms""")
def _(c):
    """Tokens right before and after each reporting term's first word."""
    i = F.col("term.first")
    return _terms(c).select(
        "gkg_id", "fact", F.get("tokens", i).alias("first_word"), F.get("tokens", i - 1).alias("previous"),
        F.get("tokens", i + 1).alias("following"),
    )


_FACTS = """
SELECT t.gkg_id, t.fact, t.unit, t.label AS term, TRY_CAST(t.figure AS INT) AS specific_reported_figure,
  CASE WHEN t.figure = 'Hundreds' THEN t.figure END AS vague_reported_figure, 0 AS excerpt_start,
  CAST(length(t.sentence) AS INT) AS excerpt_end, m.place AS locations{extra}
FROM e_terms t JOIN (SELECT gkg_id, fact, coalesce(place, last_value(place IGNORE NULLS) OVER (
  PARTITION BY gkg_id ORDER BY fact ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS place
  FROM e_parts) m ON t.fact = m.fact AND t.gkg_id = m.gkg_id"""


def _facts(c):
    return ex.extract_facts(sentences(c), gazetteer(c), LEXICON, order="fact")


@parts("extract_facts", _FACTS.format(extra=""))
def _(c):
    return _facts(c).drop("tag_spans")


@parts("stored_facts", "SELECT gkg_id, unit, term, specific_reported_figure, vague_reported_figure, excerpt_end,"
       " locations AS location_name FROM (" + _FACTS.format(extra="") + ")")
def _(c):
    """Facts written in two halves and then all again, read back through the bridges."""
    path, found = new_path(c.spark, "facts"), written(_facts(c), "found")
    half = F.pmod(F.xxhash64("gkg_id"), F.lit(2)) == 0
    for rows in (found.filter(half), found.filter(~half), found):
        store = fact_store.write_facts_store(rows, path, sentence="fact")
    named = store.fact_locations.join(
        store.locations.select(F.col("id").alias("location"), "location_name"), "location").drop("location")
    return (
        store.facts.withColumnRenamed("id", "fact").join(store.analysis_facts, "fact").join(named, "fact", "left")
        .select(F.col("analysis").alias("gkg_id"), "unit", "term", "specific_reported_figure", "vague_reported_figure",
                "excerpt_end", "location_name"))


@parts("stored_fact_api", "SELECT strftime(strptime(CAST(g.date // 1000000 AS VARCHAR), '%Y%m%d'), '%Y-%m-%d') AS gdelt_day,"
       " a.category, f.unit, f.term, f.locations AS location_name, count(*) AS n FROM (" + _FACTS.format(extra="")
       + ") f JOIN fx_analyses a USING (gkg_id) JOIN fx_gkg g ON g.id = f.gkg_id"
         " WHERE a.category IS NOT NULL AND f.locations IS NOT NULL GROUP BY ALL")
def _(c):
    """The read model over stored facts."""
    store = fact_store.write_facts_store(_facts(c), new_path(c.spark, "facts"), sentence="fact")
    sets = marts.fact_api_locations(store.fact_locations, store.locations)
    api = marts.build_fact_api(store.facts, store.analysis_facts, c.analyses, c.gkg, store.fact_locations, sets)
    places = store.locations.select(F.col("id").alias("location"), "location_name")
    return api.join(places, "location").groupBy("gdelt_day", "category", "unit", "term", "location_name").agg(
        F.count(F.lit(1)).alias("n"))


@parts("report_spans", """
SELECT gkg_id, fact, label AS term,
  'term:' || (position(first_word IN sentence) - 1) || '-' || (position(last_word IN sentence) - 1 + length(last_word))
  || ';quantity:0-' || length(figure)
  || coalesce(';loc:' || (position(place IN sentence) - 1) || '-' || (position(place IN sentence) - 1 + length(place)), '')
  AS spans FROM e_terms""")
def _(c):
    flat = F.transform("tag_spans", lambda s: F.concat(
        s["type"], F.lit(":"), s["start"].cast("string"), F.lit("-"), s["end"].cast("string")))
    return _facts(c).select("gkg_id", "fact", "term", F.array_join(flat, ";").alias("spans"))


@parts("distinct_reports", """
SELECT DISTINCT gkg_id, unit, label AS term, figure FROM e_terms""")
def _(c):
    """Reports that say the same within an article count once."""
    found = ex.reports(ex.with_lemmas(ex.tokenise(sentences(c)), LEXICON), LEXICON)
    figure = F.coalesce(F.col("specific_reported_figure").cast("string"), "vague_reported_figure")
    return found.select("gkg_id", "unit", "term", figure.alias("figure")).dropDuplicates()


@query("extract_facts_documents")
def _(c):
    """The whole chain over whole document texts; places are capitalised words of page titles."""
    s = ex.split_sentences(c.stored_contents.withColumnRenamed("id", "gkg_id"), "gkg_id")
    lexicon = lx.Lexicon({
        vocab.PERSON_TERM: ["thed", "ationed"], vocab.STRUCTURE_TERM: ["resed"],
        vocab.PERSON_UNIT: ["the", "la"], vocab.STRUCTURE_UNIT: ["of"],
        vocab.ARTICLE_KEYWORD: ["ing"],
    })
    names = c.raw("pages").select(
        F.regexp_extract("html", "<title>([A-Z][a-z]+)", 1).alias("name")
    ).filter("name <> ''").distinct()
    counted = ex.location_match(ex.tokenise(s), names, ["gkg_id", "sent_no"])
    places = counted.groupBy("gkg_id").agg(F.sum(F.size("locations")).alias("n_places"))
    facts = ex.extract_facts(s, names, lexicon).groupBy("gkg_id").agg(F.count(F.lit(1)).alias("n_facts"))
    return s.groupBy("gkg_id").agg(F.count(F.lit(1)).alias("n_sentences")).join(
        places, "gkg_id", "left").join(facts, "gkg_id", "left")


# --- labels and numbers -------------------------------------------------------------------------

@query("number_like", """
SELECT doc_id, count(*) FILTER (WHERE regexp_matches(regexp_replace(regexp_replace(w, '^[+~-]', ''), '[,.]', '', 'g'),
  '^[0-9]+(/[0-9]+)?$') OR lower(w) IN ('dozens', 'hundreds', 'thousands', {words})) AS n
FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents) GROUP BY doc_id""".replace(
    "{words}", ", ".join(f"'{w}'" for w in lx.NUMBER_WORDS)))
def _(c):
    words = c.raw("documents").select("doc_id", F.explode(F.split("text", " ")).alias("w"))
    return words.groupBy("doc_id").agg(F.count_if(lx.number_like(F.col("w"))).alias("n"))


@query("parse_figure", """
SELECT id, specific_reported_figure AS specific, vague_reported_figure AS vague FROM fx_facts""")
def _(c):
    """Figures written with separators, read back."""
    written = F.coalesce(
        F.format_number("specific_reported_figure", 0), F.col("vague_reported_figure")
    )
    specific, vague = tx.parse_figure(written)
    return c.facts.select("id", specific.alias("specific"), vague.alias("vague"))


@parts("unit_label", "SELECT gkg_id, fact, unit FROM e_parts")
def _(c):
    units = [s for s, _l, k in LEXICON.rows() if k in (vocab.PERSON_UNIT, vocab.STRUCTURE_UNIT)]
    word = F.get(F.filter(tx.tokens(F.col("sentence")), lambda t: t.isin(units)), F.lit(0))
    return sentences(c).select("gkg_id", "fact", lx.unit_label(lx.lemma(word, LEXICON), LEXICON).alias("unit"))


@parts("term_label", """
SELECT gkg_id, fact, CASE WHEN verb = 'forced to flee' THEN 'Forced to Flee' ELSE label END AS term
FROM e_terms WHERE first_word <> 'flee'""")
def _(c):
    lemmas = F.transform(tx.tokens(F.col("sentence")), lambda t: lx.lemma(t, LEXICON))
    return sentences(c).select("gkg_id", "fact", lx.term_label(lemmas, F.lit("people")).alias("term"))


@query("category_label", """
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'Conflict' WHEN '2-HIGH' THEN 'Disaster'
  ELSE 'Other' END AS category FROM orders""")
def _(c):
    p = F.col("o_orderpriority")
    predicted = F.when(p == "1-URGENT", "conflict").when(p == "2-HIGH", "disaster").otherwise(p)
    return c.raw("orders").select("o_orderkey", lx.category_label(predicted).alias("category"))


@query("relevance_label", """
SELECT doc_id, CASE quality WHEN 1 THEN true WHEN 0 THEN false END AS relevance FROM labels""")
def _(c):
    return c.raw("labels").select("doc_id", lx.relevance_label(F.col("quality")).alias("relevance"))


# --- dates --------------------------------------------------------------------------------------

_MONTH_NAMES = ["january", "february", "march", "april", "may", "june", "july", "august",
                "september", "october", "november", "december"]
# One phrase per article; the number in it, where there is one, comes from the article's id.
_DATES = """
, d_base AS (
  SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS pub, o_orderkey % 10 AS kind,
    CAST(o_orderkey % 11 + 2 AS INT) AS n FROM orders
), d_parsed AS (
  SELECT *, CAST(CASE kind WHEN 0 THEN pub WHEN 1 THEN pub - 1 WHEN 2 THEN pub - n * 7 WHEN 3 THEN pub - 7
    WHEN 4 THEN pub + 7 WHEN 5 THEN pub + CAST((8 - isodow(pub)) AS INT)
    WHEN 6 THEN make_date(year(pub), n - 1, 14) WHEN 7 THEN make_date(2016, n - 1, 3)
    WHEN 8 THEN pub - INTERVAL 1 MONTH WHEN 9 THEN pub - n END AS DATE) AS first_date
  FROM d_base
), d_named AS (
  SELECT *, CAST(CASE WHEN kind = 6 AND first_date < pub THEN first_date + INTERVAL 1 YEAR ELSE first_date END AS DATE)
    AS named FROM d_parsed
), d_resolved AS (
  SELECT id, pub, kind, n, CAST(CASE WHEN named <= pub THEN named
    WHEN kind IN (6, 7) THEN named - INTERVAL 1 YEAR
    ELSE pub - CAST(floor((named - pub) / 7) AS INT) * 7
      - (7 - CASE WHEN (named - pub) % 7 = 0 THEN 7 ELSE CAST((named - pub) % 7 AS INT) END) END AS DATE) AS date
  FROM d_named
)
"""


def date_phrases(c):
    key = F.col("o_orderkey")
    n = (key % 11 + 2).cast("int")
    kind = key % 10
    month = F.element_at(F.array(*[F.lit(m.capitalize()) for m in _MONTH_NAMES]), n - 1)
    phrase = (
        F.when(kind == 0, "today").when(kind == 1, "Yesterday")
        .when(kind == 2, F.concat(n.cast("string"), F.lit(" weeks ago")))
        .when(kind == 3, "last week").when(kind == 4, "Next week").when(kind == 5, "on Monday")
        .when(kind == 6, F.concat(month, F.lit(" 14")))
        .when(kind == 7, F.concat(F.lit("3 "), month, F.lit(" 2016")))
        .when(kind == 8, "last month").otherwise(F.concat(n.cast("string"), F.lit(" days ago")))
    )
    return c.raw("orders").select(
        key.alias("id"), F.col("o_orderdate").cast("date").alias("pub"), phrase.alias("phrase")
    )


@query("resolve_relative_date", _DATES + "SELECT id, CAST(date AS VARCHAR) AS date FROM d_resolved")
def _(c):
    return date_phrases(c).select(
        "id", dates.resolve_relative_date(F.col("phrase"), F.col("pub")).alias("date")
    )


@query("date_likelihood", """
SELECT o_orderkey AS id, date_diff('day', l_shipdate, o_orderdate) BETWEEN 0 AND 366 AS likely, count(*) AS n
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""", prelude=False)
def _(c):
    pairs = c.raw("lineitem").join(c.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    likely = dates.date_likelihood(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date"))
    return pairs.groupBy(F.col("o_orderkey").alias("id"), likely.alias("likely")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query("extract_dates", _DATES + """
SELECT id, CAST(date AS VARCHAR) AS date FROM d_resolved WHERE pub - date BETWEEN 0 AND 366""")
def _(c):
    articles = date_phrases(c).withColumn(
        "text", F.concat(F.lit("Officials said "), F.col("phrase"), F.lit(" that people had fled."))
    )
    return ex.extract_dates(articles, "id", "text", "pub").select("id", "date")
