"""Closed vocabularies. The values are fixed: stored data and user filters contain them."""

from __future__ import annotations

# Processing status of an article.
NEW = "new"
SCRAPING = "scraping"
SCRAPED = "scraped"
CLASSIFYING = "classifying"
CLASSIFIED = "classified"
EXTRACTING = "extracting"
EXTRACTED = "extracted"
GEOTAGGING = "geotagging"
GEOTAGGED = "geotagged"
SCRAPING_FAILED = "scraping failed"
CLASSIFYING_FAILED = "classifying failed"
EXTRACTING_FAILED = "extracting failed"
GEOTAGGING_FAILED = "geotagging failed"
EDITING = "editing"
EDITED = "edited"

# Displacement category.
CATEGORIES = ["Conflict", "Disaster", "Other"]

# Reporting unit of a fact.
PERSON = "Person"
HOUSEHOLD = "Household"

# Reporting term of a fact.
FACT_TERMS = [
    "Displaced", "Evacuated", "Forced to Flee", "Homeless", "In Relief Camp", "Sheltered",
    "Relocated", "Destroyed Housing", "Partially Destroyed Housing", "Uninhabitable Housing",
    "Multiple/Other", "Refugee", "Asylum Seeker", "Evicted", "Sacked",
]

# Kind of place.
ADDRESS = "address"
NEIGHBORHOOD = "neighborhood"
CITY = "city"
SUBDIVISION = "subdivision"
COUNTRY = "country"
UNKNOWN = "unknown"
UNKNOWN_ISO3 = "XXX"

# How many candidates a geocoder returned.
NO_RESULTS = "no-results"
SINGLE_RESULT = "single-result"
MULTIPLE_RESULTS = "multiple-results"

# Kind of keyword.
PERSON_TERM = "person_term"
PERSON_UNIT = "person_unit"
STRUCTURE_TERM = "structure_term"
STRUCTURE_UNIT = "structure_unit"
ARTICLE_KEYWORD = "article_keyword"

# Seed keywords, by kind.
SEED_KEYWORDS = {
    PERSON_TERM: [
        "displaced", "evacuated", "forced", "flee", "homeless", "relief camp", "sheltered",
        "relocated", "stranded", "stuck", "accommodated", "refugee camp", "refugee center",
        "evicted", "eviction", "sacked",
    ],
    STRUCTURE_TERM: [
        "destroyed", "damaged", "swept", "collapsed", "flooded", "washed", "inundated", "evacuate",
    ],
    PERSON_UNIT: [
        "families", "person", "people", "individuals", "locals", "villagers", "residents",
        "occupants", "citizens", "households", "refugee", "asylum seeker",
    ],
    STRUCTURE_UNIT: ["home", "house", "hut", "dwelling", "building"],
    ARTICLE_KEYWORD: ["Rainstorm", "hurricane", "tornado", "rain", "storm", "earthquake"],
}

# Keywords added to the seed lists later on.
ADDED_KEYWORDS = {PERSON_TERM: ["crossed", "arrived", "entered"]}
