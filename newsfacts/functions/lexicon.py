"""Keywords, their inflected forms, number words and labels.

A lexicon is small and fixed before a job starts, so it travels inside expressions: membership is a
hashed set and no token ever has to be shuffled to meet it.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsfacts import vocab

# Irregular forms: base -> (past, participle).
_IRREGULAR = {
    "flee": ("fled", "fled"), "sweep": ("swept", "swept"), "stick": ("stuck", "stuck"),
    "leave": ("left", "left"), "become": ("became", "become"),
}
_IRREGULAR_PLURALS = {"person": "persons", "people": "people", "homeless": "homeless", "life": "lives"}

# Bases that are nouns as often as verbs: only their past and -ing forms count as reporting verbs.
_NOUN_LIKE = {
    "flood", "shelter", "damage", "force", "sack", "strand", "collapse", "wash", "sweep", "cross",
    "stick", "camp",
}
# Keywords that are never verbs; they report only behind "leave", "render", "become" and the like.
_NOT_VERBS = {"homeless", "relief", "camp", "refugee", "center", "eviction"}

# Bases of seed keywords that the suffix rules below would not find.
_BASES = {
    "displaced": "displace", "evacuated": "evacuate", "forced": "force", "sheltered": "shelter",
    "relocated": "relocate", "stranded": "strand", "stuck": "stick", "accommodated": "accommodate",
    "evicted": "evict", "sacked": "sack", "destroyed": "destroy", "damaged": "damage",
    "swept": "sweep", "collapsed": "collapse", "flooded": "flood", "washed": "wash",
    "inundated": "inundate", "crossed": "cross", "arrived": "arrive", "entered": "enter",
    "families": "family", "individuals": "individual", "locals": "local", "villagers": "villager",
    "residents": "resident", "occupants": "occupant", "citizens": "citizen",
    "households": "household",
}

_ONES = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten",
         "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen",
         "nineteen"]
_TENS = ["twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]
_POWERS = {"hundred": 100, "thousand": 1000, "million": 10**6, "billion": 10**9, "trillion": 10**12}


def number_words() -> dict[str, int]:
    """Number words with their values, hyphenated tens included."""
    words = {w: i for i, w in enumerate(_ONES)}
    for i, ten in enumerate(_TENS):
        words[ten] = 20 + 10 * i
        for j in range(1, 10):
            words[f"{ten}-{_ONES[j]}"] = 20 + 10 * i + j
    return words | _POWERS


NUMBER_WORDS = number_words()
VAGUE_NUMBERS = ["dozens", "hundreds", "thousands"]


def base_form(word: str) -> str:
    return _BASES.get(word.lower(), word.lower())


def verb_forms(base: str) -> list[str]:
    """Past, participle and -ing form."""
    stem = base[:-1] if base.endswith("e") and not base.endswith("ee") else base
    past = _IRREGULAR.get(base, (stem + "ed",) * 2)
    return sorted({*past, stem + "ing"})


def plural(base: str) -> str:
    if base in _IRREGULAR_PLURALS:
        return _IRREGULAR_PLURALS[base]
    if base.endswith("y") and base[-2:-1] not in "aeiou":
        return base[:-1] + "ies"
    return base + ("es" if base.endswith(("s", "sh", "ch", "x")) else "s")


@dataclass(frozen=True)
class Lexicon:
    """Keyword lists by kind. Multi-word keywords fall apart into single words."""

    keywords: dict[str, list[str]] = field(default_factory=lambda: vocab.SEED_KEYWORDS)

    def lemmas(self, kind: str) -> list[str]:
        words = [w for k in self.keywords.get(kind, []) for w in k.split(" ")]
        return list(dict.fromkeys(base_form(w) for w in words))

    @cached_property
    def surfaces(self) -> dict[str, str]:
        """Every inflected form with its base, for keywords and the helper verbs."""
        out: dict[str, str] = {}
        units = self.lemmas(vocab.PERSON_UNIT) + self.lemmas(vocab.STRUCTURE_UNIT)
        for lemma in [*units, *self.lemmas(vocab.ARTICLE_KEYWORD), *sorted(_NOT_VERBS), "life"]:
            out[plural(lemma)] = lemma
            out[lemma] = lemma
        for lemma in [*self.verbs, "leave", "render", "become", "affect", "fear", "assume", "claim",
                      "cross", "arrive", "enter"]:
            for form in verb_forms(lemma):
                out.setdefault(form, lemma)
            if lemma not in _NOUN_LIKE:
                out.setdefault(plural(lemma), lemma)
                out.setdefault(lemma, lemma)
        return out

    @cached_property
    def verbs(self) -> list[str]:
        terms = self.lemmas(vocab.PERSON_TERM) + self.lemmas(vocab.STRUCTURE_TERM)
        return [t for t in dict.fromkeys(terms) if t not in _NOT_VERBS]

    def joint_terms(self) -> list[str]:
        structure = set(self.lemmas(vocab.STRUCTURE_TERM))
        return [t for t in self.lemmas(vocab.PERSON_TERM) if t in structure]

    def rows(self) -> list[tuple[str, str, str]]:
        """(surface, lemma, keyword_type) for every form of every keyword."""
        kinds: dict[str, list[str]] = {}
        for kind in self.keywords:
            for lemma in self.lemmas(kind):
                kinds.setdefault(lemma, []).append(kind)
        return sorted(
            (form, lemma, kind)
            for form, lemma in self.surfaces.items()
            for kind in kinds.get(lemma, [])
        )


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(v) for pair in values.items() for v in pair])


def lemma(token: Column, lexicon: Lexicon) -> Column:
    """Base form of a known word, else the word in lower case. The map is searched for hits only."""
    lower = F.lower(token)
    return F.when(
        lower.isin(list(lexicon.surfaces)), F.element_at(literal_map(lexicon.surfaces), lower)
    ).otherwise(lower)


def number_like(token: Column) -> Column:
    """Digits (with separators or as a fraction), a number word, or a vague number."""
    bare = F.regexp_replace(F.regexp_replace(token, r"^[+\-~]", ""), "[,.]", "")
    lower = F.lower(token)
    # Most tokens have no digit, which is one cheap test.
    digit = F.regexp_like(token, F.lit("[0-9]"))
    return (
        (digit & F.regexp_like(bare, F.lit(r"^[0-9]+(?:/[0-9]+)?$")))
        | lower.isin(list(NUMBER_WORDS))
        | lower.isin(VAGUE_NUMBERS)
    )


def number_value(token: Column) -> Column:
    """Value of digits or a number word; NULL for vague numbers."""
    lower = F.lower(token)
    digits = F.replace(token, F.lit(","), F.lit("")).try_cast("long")
    word = F.when(
        lower.isin(list(NUMBER_WORDS)), F.element_at(literal_map(NUMBER_WORDS), lower).cast("long")
    )
    return F.coalesce(digits, word)


def unit_label(unit_lemma: Column, lexicon: Lexicon) -> Column:
    household = [*lexicon.lemmas(vocab.STRUCTURE_UNIT), "family", "household"]
    return F.when(unit_lemma.isin(household), vocab.HOUSEHOLD).otherwise(vocab.PERSON)


# First matching word of a reporting term decides its label.
TERM_LABELS = [
    ("Refugee", ["refugee", "cross"]),
    ("Displaced", ["displace"]),
    ("Evacuated", ["evacuate"]),
    ("Forced to Flee", ["flee"]),
    ("Homeless", ["homeless"]),
    ("In Relief Camp", ["camp"]),
    ("Sheltered", ["shelter", "accommodate"]),
    ("Relocated", ["relocate"]),
    ("Destroyed Housing", ["destroy"]),
    ("Partially Destroyed Housing", ["damage"]),
    ("Uninhabitable Housing", ["uninhabitable"]),
    ("Evicted", ["evict", "eviction", "evictions"]),
    ("Sacked", ["sack"]),
]


def term_label(term_lemmas: Column, unit_lemma: Column) -> Column:
    """Label of a reporting term; a refugee or asylum unit decides before the term does."""
    label = F.when(unit_lemma == "refugee", "Refugee").when(unit_lemma == "asylum", "Asylum Seeker")
    for name, words in TERM_LABELS:
        label = label.when(F.arrays_overlap(term_lemmas, F.array(*[F.lit(w) for w in words])), name)
    return label.otherwise("Displaced")


def category_label(prediction: Column) -> Column:
    return F.when(prediction == "disaster", "Disaster").when(prediction == "conflict", "Conflict").otherwise("Other")


def relevance_label(prediction: Column) -> Column:
    return F.when(prediction == 1, True).when(prediction == 0, False)
