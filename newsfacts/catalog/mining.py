"""Word features, topics, classifiers and neighbours."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from newsfacts import vocab
from newsfacts.catalog.base import query
from newsfacts.catalog.prelude import _STOP
from newsfacts.functions import lexicon as lx
from newsfacts.functions import text as tx
from newsfacts.operators import models, words
from newsfacts.operators.keys import dealt, shares
from newsfacts.operators.neighbours import knn_classify
from newsfacts.session import written
from newsfacts.sources import pages, readers

# A lexicon whose forms occur in the documents.
WORDS = lx.Lexicon({
    vocab.PERSON_UNIT: ["thed", "ering", "and"], vocab.STRUCTURE_UNIT: ["le", "der"],
    vocab.PERSON_TERM: ["ationed"],
})
_FORMS = ", ".join(f"('{s}', '{l}')" for s, l in WORDS.surfaces.items())
_LEMMA = f"(SELECT * FROM (VALUES {_FORMS}) v(surface, lemma))"
_WORD = words.WORD_PUNCT


def docs(c):
    return c.raw("documents").select("doc_id", "text", "lang", "source")


_STORED = {}
_SHARE = 8 << 20  # characters of text whose words a task holds at once


def _pos(c):
    """Words of every document, stored on first use in a session."""
    if c not in _STORED:
        texts = docs(c).select("doc_id", "text")
        n = shares(texts, "text", _SHARE)
        _STORED[c] = written(
            dealt(texts, n).select("doc_id", words.pos_features(F.col("text"), WORDS).alias("terms")), "terms"
        ), n
    return _STORED[c][0]


def _dealt_pos(c):
    """The same for fitting, which keeps the words of a task in memory: a task reads files of many shares together."""
    terms = _pos(c)
    return dealt(terms, _STORED[c][1])


# --- language -----------------------------------------------------------------------------------

_LANGUAGE_SQL = f"""
WITH chars AS (
  SELECT doc_id, lang, string_split(regexp_replace(lower(text), '[{tx.SPACE}]+', ' ', 'g'), '') AS c FROM documents
), grams AS (
  SELECT doc_id, lang, unnest(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2])) AS gram
  FROM chars
), known AS (
  SELECT lang, gram, count(*) AS n FROM grams WHERE lang IS NOT NULL GROUP BY lang, gram
), mass AS (
  SELECT lang, ln(sum(n) + (SELECT count(DISTINCT gram) FROM known) + 1) AS mass FROM known GROUP BY lang
), scores AS (
  SELECT g.doc_id, k.lang, sum(ln(k.n + 1)) AS gain FROM grams g JOIN known k ON g.gram = k.gram GROUP BY ALL
), likely AS (
  SELECT s.doc_id, s.lang, round(gain - t.total * m.mass, 6) AS score FROM scores s JOIN mass m ON s.lang = m.lang
  JOIN (SELECT doc_id, count(*) AS total FROM grams GROUP BY doc_id) t ON s.doc_id = t.doc_id
)
SELECT d.doc_id, s.detected FROM documents d LEFT JOIN (
  SELECT doc_id, arg_min(lang, struct_pack(n := -score, l := lang)) AS detected FROM likely GROUP BY doc_id) s
ON d.doc_id = s.doc_id"""


@query("english_detected", f"SELECT doc_id FROM ({_LANGUAGE_SQL}) WHERE detected = 'en'", prelude=False)
def _(c):
    """Documents kept by what their text is found to be, not by a given label."""
    found = words.detect_language(docs(c), "text", words.language_profiles(docs(c), "text", "lang"))
    return pages.english_only(found, "detected").select("doc_id")


@query("detect_language", _LANGUAGE_SQL, prelude=False)
def _(c):
    profiles = words.language_profiles(docs(c), "text", "lang")
    return words.detect_language(docs(c), "text", profiles).select("doc_id", "detected")


# --- word features ------------------------------------------------------------------------------

def _kept_sql(conditions, out="lower(t)"):
    return (f"list_transform(list_filter(regexp_extract_all(text, '{_WORD}'), lambda t: {conditions}), "
            f"lambda t: {out})")


_DIGITS = "regexp_matches(t, '^\\p{Nd}+$')"


@query("category_tokens", f"""
SELECT doc_id, len(k) AS n, md5(array_to_string(k, ',')) AS tokens_md5 FROM (SELECT doc_id,
  {_kept_sql(f"length(t) > 2 AND t NOT IN ({_STOP}) AND NOT {_DIGITS}")} AS k FROM documents)""", prelude=False)
def _(c):
    kept = docs(c).select("doc_id", words.category_tokens(F.col("text")).alias("k"))
    return kept.select("doc_id", F.size("k").cast("long").alias("n"), F.md5(F.array_join("k", ",")).alias("tokens_md5"))


def _lemmas_sql(conditions, lower):
    """Documents as ordered lemma lists."""
    word = "lower(w)"
    return f"""(SELECT doc_id, list(coalesce(l.lemma, {word}) ORDER BY pos) AS k FROM (
  SELECT doc_id, unnest(k) AS w, unnest(range(len(k))) AS pos FROM (
    SELECT doc_id, {_kept_sql(conditions, 'lower(t)' if lower else 't')} AS k FROM documents)) t
  LEFT JOIN {_LEMMA} l ON l.surface = {word} GROUP BY doc_id)"""


@query("category_stems", f"""
SELECT doc_id, len(k) AS n, md5(array_to_string(k, ',')) AS stems_md5
FROM {_lemmas_sql(f"length(t) > 2 AND lower(t) NOT IN ({_STOP}) AND NOT {_DIGITS}", True)}""", prelude=False)
def _(c):
    stems = docs(c).select("doc_id", words.category_stems(F.col("text"), WORDS).alias("k")).filter(F.size("k") > 0)
    return stems.select("doc_id", F.size("k").cast("long").alias("n"), F.md5(F.array_join("k", ",")).alias("stems_md5"))


_NUMBER = ("(regexp_matches(regexp_replace(regexp_replace(t, '^[+~-]', ''), '[,.]', '', 'g'), '^[0-9]+(/[0-9]+)?$') "
           "OR lower(t) IN ('dozens', 'hundreds', 'thousands', " + ", ".join(f"'{w}'" for w in lx.NUMBER_WORDS) + "))")
_POS_SQL = _lemmas_sql(f"length(t) > 2 AND t NOT IN ({_STOP}) AND NOT {_NUMBER}", False)


@query("pos_features", f"""
SELECT doc_id, len(k) AS n, md5(array_to_string(k, ',')) AS features_md5 FROM {_POS_SQL}""", prelude=False)
def _(c):
    fresh = docs(c).select("doc_id", words.pos_features(F.col("text"), WORDS).alias("terms"))
    return fresh.filter(F.size("terms") > 0).select(
        "doc_id", F.size("terms").cast("long").alias("n"), F.md5(F.array_join("terms", ",")).alias("features_md5")
    )


@query("phrase_features", f"""
SELECT doc_id, md5(array_to_string(list_transform(range(1, len(k)), lambda i: array_to_string(k[i:i + 2], '_')), ','))
  AS phrases_md5 FROM {_POS_SQL}""", prelude=False)
def _(c):
    phrases = words.phrase_features(F.col("terms"))
    return _pos(c).filter(F.size("terms") > 0).select("doc_id", F.md5(F.array_join(phrases, ",")).alias("phrases_md5"))


@query("generalise_entities", """
SELECT gkg_id, fact, regexp_replace(regexp_replace(sentence, 'NATION_[0-9]+',
  CASE WHEN CAST(regexp_extract(sentence, 'NATION_([0-9]+)', 1) AS INT) % 2 = 0 THEN 'Switzerland' ELSE 'Geneva' END),
  '^(Hundreds|[0-9]+)', '1000') AS text FROM (
    SELECT gkg_id, fact, CASE WHEN contains(sentence, 'NATION') THEN sentence ELSE sentence || ' NATION_0' END AS s,
      sentence FROM fx_sentences)""".replace(
    "CAST(regexp_extract(sentence, 'NATION_([0-9]+)', 1) AS INT)",
    "coalesce(TRY_CAST(regexp_extract(sentence, 'NATION_([0-9]+)', 1) AS INT), 0)"))
def _(c):
    """Every sentence gets a link appended, which goes again."""
    kind = F.when(F.col("n_nationkey") % 2 == 0, "country").otherwise("city")
    gazetteer = c.raw("nation").select(F.col("n_name").alias("name"), kind.alias("kind"))
    linked = c.article_sentences.withColumn(
        "sentence", F.concat("sentence", F.lit(" http://x.example/"), F.col("fact").cast("string"))
    )
    return words.generalise_entities(linked, gazetteer, ["gkg_id", "fact"])


@query("corpus_word_freq", f"""
SELECT word, count(*) AS n FROM (SELECT unnest(k) AS word FROM {_POS_SQL}) GROUP BY word""", prelude=False)
def _(c):
    return words.corpus_word_freq(_pos(c))


# Vocabulary of a count model, and a few words that occur in the documents.
_VOCABULARY = [
    "leave", "evacuate", "homeless", "forced", "flee", "fled", "destroyed", "destruction", "submerged",
    "wrecked", "washed", "away", "devastated", "under", "water", "underwater", "inundated", "camp",
    "collapse", "left", "reconstruct", "demolished", "uninhabitable", "border", "across", "refugee",
    "shelter", "crops", "corn", "rice", "maize", "wheat", "field", "the", "ing", "ere", "der", "para",
]


@query("vocab_counts", f"""
SELECT doc_id, word, CAST(count(*) AS INT) AS n FROM (
  SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM documents)
WHERE word IN ({', '.join(f"'{w}'" for w in _VOCABULARY)}) GROUP BY ALL""", prelude=False)
def _(c):
    counted = docs(c).select("doc_id", tx.tokens(F.col("text")).alias("terms"))
    return words.vocab_counts(counted, "doc_id", "terms", _VOCABULARY)


_DF = f"""
WITH terms AS (SELECT doc_id, k FROM {_POS_SQL}), tf AS (
  SELECT doc_id, word, count(*) AS tf FROM (SELECT doc_id, unnest(k) AS word FROM terms) GROUP BY ALL
), n AS (SELECT count(*) AS n FROM documents), words AS (
  SELECT word, df, log2((SELECT n FROM n)::DOUBLE / df) AS idf FROM (SELECT word, count(*) AS df FROM tf GROUP BY word)
  WHERE df >= 5 AND df <= (SELECT n FROM n) * 0.5
)
"""


@query("tfidf", _DF + """
SELECT doc_id, word, round(w / norm, 6) AS weight FROM (
  SELECT doc_id, word, tf * idf AS w, sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY doc_id)) AS norm
  FROM tf JOIN words USING (word)) WHERE norm > 0""", prelude=False)
def _(c):
    weights = words.tfidf(_pos(c), "doc_id", "terms")
    return weights.withColumn("weight", F.round("weight", 6))


@query("ngram_collocations", f"""
WITH terms AS (SELECT doc_id, k FROM {_POS_SQL}), single AS (
  SELECT word, count(*) AS n FROM (SELECT unnest(k) AS word FROM terms) GROUP BY word
), pairs AS (
  SELECT p.a AS a, p.b AS b, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(k)),
    lambda i: struct_pack(a := k[i], b := k[i + 1]))) AS p FROM terms) GROUP BY ALL HAVING count(*) >= 5
)
SELECT a, b, n, round(score, 6) AS score FROM (
  SELECT a, b, p.n, CAST((p.n - 5) * (SELECT count(*) FROM single) AS DOUBLE) / (x.n * y.n) AS score
  FROM pairs p JOIN single x ON x.word = a JOIN single y ON y.word = b) WHERE score > 10""", prelude=False)
def _(c):
    return words.collocations(_pos(c), "terms").withColumn("score", F.round("score", 6))


@query("ngram_texts")
def _(c):
    """Documents with collocations of two passes joined."""
    joined = words.ngrams(_pos(c), "doc_id", "terms")
    return joined.select("doc_id", F.size("terms").alias("n"), F.md5(F.array_join("terms", " ")).alias("text_md5"))


# --- topics -------------------------------------------------------------------------------------

def _tfidf_vectors(c, size=2000):
    from pyspark.ml import Pipeline

    model = Pipeline(stages=models.tfidf_stages("terms", "features", size=size)).fit(terms := _dealt_pos(c))
    return model, model.transform(terms)


@query("lsi")
def _(c):
    model, vectors = _tfidf_vectors(c)
    basis = models.fit_lsi(vectors, "features", len(model.stages[0].vocabulary), 50)
    out = models.lsi_project(vectors, "features", basis, "topics")
    strength = F.aggregate(vector_to_array("topics"), F.lit(0.0), lambda acc, x: acc + x * x)
    return out.select("doc_id", F.size(vector_to_array("topics")).alias("n_topics"), F.round(strength, 4).alias("energy"))


@query("lda")
def _(c):
    _model, vectors = _tfidf_vectors(c)
    topics = models.fit_lda(vectors, "features_tf", 8).transform(vectors)
    share = vector_to_array("topicDistribution")
    return topics.select("doc_id", F.round(F.array_max(share), 4).alias("top_share"),
                         (F.array_position(share, F.array_max(share)) - 1).alias("topic"))


@query("top_topic_terms")
def _(c):
    model, vectors = _tfidf_vectors(c)
    fitted = models.fit_lda(vectors, "features_tf", 8)
    return models.top_topic_terms(fitted, model.stages[0].vocabulary).select("topic", "rank", "word")


@query("feature_union")
def _(c):
    """Phrase and word branches side by side."""
    from pyspark.ml import Pipeline

    both = _dealt_pos(c).withColumn("phrases", words.phrase_features(F.col("terms")))
    stages = models.tfidf_stages("terms", "by_word", max_df=0.7, size=1000) + models.tfidf_stages(
        "phrases", "by_phrase", min_df=2, size=1000)
    fitted = Pipeline(stages=stages).fit(both).transform(both)
    out = models.feature_union(fitted, ["by_word", "by_phrase"])
    size = F.size(F.filter(vector_to_array("features"), lambda x: x != 0))
    return out.select("doc_id", size.alias("n_nonzero"))


# --- classifiers --------------------------------------------------------------------------------

_PART = "CAST('0x' || substr(md5('42-' || {}), 1, 8) AS BIGINT) % 1000"


@query("train_test_split", f"""
SELECT doc_id, CASE WHEN {_PART.format('doc_id')} < 800 THEN 'train' ELSE 'test' END AS part FROM labels""",
       prelude=False)
def _(c):
    train, test = models.train_test_split(c.raw("labels"), "doc_id")
    return train.select("doc_id", F.lit("train").alias("part")).unionAll(test.select("doc_id", F.lit("test").alias("part")))


def _embedded(c):
    vectors = c.raw("embeddings").select(
        "vec_id", F.col("label").cast("double").alias("label"),
        array_to_vector(F.col("embedding").cast("array<double>")).alias("features"),
    )
    return models.train_test_split(vectors, "vec_id")


def _predicted(c, kind):
    train, test = _embedded(c)
    return models.classifier(kind).fit(train).transform(test).select("vec_id", "label", "prediction")


@query("linear_svc")
def _(c):
    return _predicted(c, "linear_svc")


@query("logistic_ovr")
def _(c):
    return _predicted(c, "logistic_ovr")


@query("gaussian_nb")
def _(c):
    return _predicted(c, "gaussian_nb")


@query("random_forest")
def _(c):
    return _predicted(c, "random_forest")


@query("grid_search")
def _(c):
    from pyspark.ml.classification import LogisticRegression

    train, test = _embedded(c)
    model = LogisticRegression(maxIter=10, featuresCol="features", labelCol="label")
    best = models.grid_search(train, model, {model.regParam: [1 / c_ for c_ in (0.1, 1, 10)]}, folds=5)
    return best.transform(test).select("vec_id", "label", "prediction")


@query("stacking")
def _(c):
    train, test = _embedded(c)
    base_train, meta_train = models.train_test_split(train, "vec_id", 0.6, seed=7)
    base = {k: models.classifier(k) for k in ("linear_svc", "gaussian_nb", "logistic_ovr")}
    meta = models.classifier("random_forest", features="_stacked")
    return models.stacking(base_train, meta_train, test, base, meta).select("vec_id", "label", "prediction")


@query("classify_documents")
def _(c):
    labeled = readers.labeled_docs(docs(c), c.raw("labels"))
    prepared = readers.label_index(labeled, "lang", "category_label").select(
        "doc_id", F.col("category_label").cast("double").alias("category_label"),
        F.col("quality").cast("double").alias("quality"),
        words.category_tokens(F.col("text")).alias("raw_terms"),
        words.category_tokens(tx.cleanup_text(F.col("text"))).alias("clean_terms"),
    )
    by_category = models.text_classifier("raw_terms", "category_label", size=2000).fit(prepared)
    by_relevance = models.text_classifier("clean_terms", "quality", "logistic_ovr", size=2000).fit(prepared)
    every = docs(c).select(
        "doc_id", words.category_tokens(F.col("text")).alias("raw_terms"),
        words.category_tokens(tx.cleanup_text(F.col("text"))).alias("clean_terms"),
    )
    scored = models.classify_documents(every, by_category, by_relevance)
    return scored.select("doc_id", "category_prediction",
                         lx.relevance_label(F.col("relevance_prediction")).alias("relevance"))


@query("classification_report", """
WITH p AS (SELECT quality AS y, CAST(n_chars % 3 > 0 AS INT) AS z FROM labels JOIN documents USING (doc_id)), k AS (
  SELECT DISTINCT y AS class FROM p UNION SELECT DISTINCT z FROM p)
SELECT class, round(coalesce(hit / nullif(said, 0), 0), 6) AS precision, round(coalesce(hit / nullif(support, 0), 0), 6) AS recall,
  round(coalesce(2 * hit / nullif(said + support, 0), 0), 6) AS f1, CAST(support AS BIGINT) AS support FROM (
  SELECT class, (SELECT count(*) FROM p WHERE y = class AND z = class)::DOUBLE AS hit,
    (SELECT count(*) FROM p WHERE z = class)::DOUBLE AS said, (SELECT count(*) FROM p WHERE y = class)::DOUBLE AS support
  FROM k)""", prelude=False)
def _(c):
    pairs = c.raw("labels").join(c.raw("documents"), "doc_id").select(
        "quality", (F.col("n_chars") % 3 > 0).cast("int").alias("guess")
    )
    report = models.classification_report(pairs, "quality", "guess")
    return report.select("class", *[F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")], "support")


@query("knn_classify", """
WITH near AS (
  SELECT q.vec_id AS query_id, t.label, row_number() OVER (PARTITION BY q.vec_id
    ORDER BY list_distance(q.embedding::DOUBLE[], t.embedding::DOUBLE[]), t.vec_id) AS r
  FROM embeddings q JOIN embeddings t ON q.vec_id <> t.vec_id
), votes AS (SELECT query_id, label, count(*) AS n FROM near WHERE r <= 5 GROUP BY ALL)
SELECT query_id, arg_min(label, struct_pack(n := -n, l := label)) AS label FROM votes GROUP BY query_id""", prelude=False)
def _(c):
    vectors = c.raw("embeddings")
    train = vectors.select(F.col("vec_id").alias("train_id"), F.col("embedding").alias("vector"), "label")
    queries = vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return knn_classify(queries, train, k=5)
