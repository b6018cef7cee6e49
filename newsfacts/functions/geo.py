"""Place names, coordinates and kinds of place."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Place class -> kind of place, in order; the first list with the class decides.
OSM_PLACES = [
    ("address", ["address", "street", "locality", "building"]),
    ("neighborhood", [
        "neighbourhood", "borough", "localadmin", "quarter", "city_block", "plot", "hamlet",
        "isolated_dwelling", "farm", "allotments",
    ]),
    ("city", ["locality", "city", "municipality", "town", "village"]),
    ("subdivision", ["county", "region", "province", "district", "state"]),
    ("country", ["country"]),
]

# The same for the layers of another geocoder.
LAYER_PLACES = [
    ("address", ["address", "street"]),
    ("neighborhood", ["neighbourhood", "borough", "localadmin"]),
    ("city", ["locality", "city"]),
    ("subdivision", ["county", "region"]),
    ("country", ["country"]),
]

# Precomposed Latin letters that decompose into a plain letter and a combining mark.
_ACCENTED = (
    "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿĀāĂăĄąĆćĈĉĊċČčĎďĒēĔĕĖėĘęĚěĜĝĞğĠġĢģĤĥ"
    "ĨĩĪīĬĭĮįİĴĵĶķĹĺĻļĽľŃńŅņŇňŌōŎŏŐőŔŕŖŗŘřŚśŜŝŞşŠšŢţŤťŨũŪūŬŭŮůŰűŲųŴŵŶŷŸŹźŻżŽžƠơƯưǍǎǏǐǑǒǓǔȘșȚț"
)


def _plain_letters() -> str:
    import unicodedata

    return "".join(unicodedata.normalize("NFD", c)[0] for c in _ACCENTED)


def strip_accents(col: Column) -> Column:
    """Drop combining marks, and the marks of precomposed Latin letters."""
    plain = F.translate(col, _ACCENTED, _plain_letters())
    return F.when(
        F.regexp_like(plain, F.lit(r"\p{Mn}")), F.regexp_replace(plain, r"\p{Mn}+", "")
    ).otherwise(plain)


def fold_name(col: Column) -> Column:
    """Key under which names are equal regardless of accents and case."""
    return F.lower(strip_accents(col))


def same_place_name(a: Column, b: Column) -> Column:
    return fold_name(a) == fold_name(b)


def strip_place_words(col: Column) -> Column:
    """Drop common words of place names wherever they occur, also inside words, and title-case."""
    words = "the|province|county|district|city|township"
    return F.initcap(F.trim(F.regexp_replace(F.lower(col), words, "")))


def lat_lon(col: Column) -> tuple[Column, Column]:
    return F.split_part(col, F.lit(","), F.lit(1)), F.split_part(col, F.lit(","), F.lit(2))


def lon_lat_text(lon: Column, lat: Column) -> Column:
    return F.concat(lat.cast("string"), F.lit(","), lon.cast("string"))


def valid_coords(latlong: Column) -> Column:
    lat, lon = (part.try_cast("double") for part in lat_lon(latlong))
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def place_type(place: Column, classes: list[tuple[str, list[str]]] = OSM_PLACES) -> Column:
    kind = None
    for name, places in classes:
        found = place.isin(places)
        kind = F.when(found, name) if kind is None else kind.when(found, name)
    return kind.otherwise("unknown")


def best_place(extratag: Column, type_: Column, class_: Column) -> Column:
    """The most specific description a candidate carries."""
    return F.coalesce(extratag, type_, class_)
