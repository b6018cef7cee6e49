"""Date phrases of an article, resolved against its publication date."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
WEEKDAYS = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]

_MONTH = "(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"
_WEEKDAY = r"\b(mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)day\b"
_COUNT = "([0-9]+|an?|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve)"
_WORDS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve"]

# A phrase worth resolving, for finding phrases in running text.
PHRASE = (
    r"(?i)\b(?:today|yesterday|tomorrow"
    rf"|(?:last|next) (?:week|month|year)"
    rf"|{_COUNT} (?:day|week|month|year)s? ago"
    rf"|(?:last |next )?(?:mon|tues|wednes|thurs|fri|satur|sun)day"
    r"|(?:january|february|march|april|may|june|july|august|september|october|november|december)"
    r" [0-9]{1,2}(?:, [0-9]{4})?"
    r"|[0-9]{1,2} (?:january|february|march|april|may|june|july|august|september|october|november"
    r"|december)(?: [0-9]{4})?)\b"
)


def _number(word: Column) -> Column:
    value = F.when(word.isin("a", "an"), F.lit(1))
    for i, w in enumerate(_WORDS):
        value = value.when(word == w, F.lit(i + 1))
    return value.otherwise(word.try_cast("int"))


def _month_number(text: Column) -> Column:
    name = F.regexp_extract(text, _MONTH, 1)
    return F.array_position(F.array(*[F.lit(m) for m in MONTHS]), name).cast("int")


def parse_date_phrase(phrase: Column, published: Column) -> Column:
    """The date a phrase names, possibly in the future; NULL when it names none.

    A weekday is the next such day; a month and day without a year is the next such date.
    """
    text = F.lower(F.trim(phrase))
    pub = published.cast("date")

    count = _number(F.regexp_extract(text, rf"\b{_COUNT} (?:day|week|month|year)s? ago", 1))
    step = F.regexp_extract(text, rf"\b{_COUNT} (day|week|month|year)s? ago", 2)
    ago = (
        F.when(step == "day", F.date_sub(pub, count))
        .when(step == "week", F.date_sub(pub, count * 7))
        .when(step == "month", F.add_months(pub, -count))
        .when(step == "year", F.add_months(pub, -12 * count))
    )

    which = F.regexp_extract(text, r"\b(last|next) (?:week|month|year)", 1)
    span = F.regexp_extract(text, r"\b(?:last|next) (week|month|year)", 1)
    sign = F.when(which == "last", -1).otherwise(1)
    neighbour = (
        F.when(span == "week", F.date_add(pub, sign * 7))
        .when(span == "month", F.add_months(pub, sign))
        .when(span == "year", F.add_months(pub, sign * 12))
    )

    weekday = F.substring(F.regexp_extract(text, _WEEKDAY, 1), 1, 3)

    def next_weekday(after: Column) -> Column:
        return F.coalesce(*[F.when(weekday == d, F.next_day(after, d)) for d in WEEKDAYS])

    coming = next_weekday(pub)
    last_one = F.contains(text, F.lit("last "))
    # The latest such day before the publication date.
    past = F.date_sub(next_weekday(F.date_sub(pub, 1)), 7)
    day_of_week = F.when(last_one, past).otherwise(coming)

    month = _month_number(text)
    day_first = F.regexp_extract(text, rf"\b([0-9]{{1,2}})(?:st|nd|rd|th)? {_MONTH}", 1)
    day_last = F.regexp_extract(text, rf"{_MONTH} ([0-9]{{1,2}})(?:st|nd|rd|th)?(?![0-9])", 2)
    day = F.coalesce(
        F.nullif(day_first, F.lit("")).try_cast("int"), F.nullif(day_last, F.lit("")).try_cast("int"),
        F.lit(1),
    )
    year = F.nullif(F.regexp_extract(text, r"\b((?:19|20)[0-9]{2})\b", 1), F.lit("")).try_cast("int")

    def on(y: Column) -> Column:
        return F.to_date(
            F.try_to_timestamp(F.format_string("%04d-%02d-%02d", y, month, day), F.lit("yyyy-MM-dd"))
        )

    this_year = on(F.year(pub))
    named = F.when(year.isNotNull(), on(year)).when(this_year < pub, on(F.year(pub) + 1)).otherwise(this_year)

    return (
        F.when(step != "", ago)
        .when(span != "", neighbour)
        .when(F.regexp_like(text, F.lit(r"\byesterday\b")), F.date_sub(pub, 1))
        .when(F.regexp_like(text, F.lit(r"\btomorrow\b")), F.date_add(pub, 1))
        .when(F.regexp_like(text, F.lit(r"\btoday\b")), pub)
        .when(weekday != "", day_of_week)
        .when(month > 0, named)
    )


def roll_back(date: Column, published: Column, phrase: Column) -> Column:
    """A date after publication is moved to the past: by a year if the phrase names a month, else to the same weekday
    as many begun weeks before publication as it lies whole weeks after it (one more where it lies between two)."""
    ahead = F.datediff(date, published.cast("date"))
    weeks = (F.floor(ahead / 7) + F.ceil(ahead / 7)).cast("int")
    moved = F.when(
        F.regexp_like(F.lower(phrase), F.lit("|".join(MONTHS))), F.add_months(date, -12)
    ).otherwise(F.date_sub(date, weeks * 7))
    return F.when(ahead > 0, moved).otherwise(date)


def resolve_relative_date(phrase: Column, published: Column) -> Column:
    return roll_back(parse_date_phrase(phrase, published), published, phrase)


def date_likelihood(date: Column, published: Column) -> Column:
    """Not after publication and at most 366 days before it; true where publication is unknown."""
    back = F.datediff(published, date)
    return F.coalesce((back >= 0) & (back <= 366), published.isNull())
