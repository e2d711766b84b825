"""Text functions: address words, similarity, display formats."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Abbreviations of street types and directions, and state codes with their names.
STREET_TYPES = {"st": "street", "ave": "avenue", "blvd": "boulevard", "dr": "drive", "rd": "road", "ln": "lane", "ct": "court", "cir": "circle", "pl": "place", "way": "way", "pkwy": "parkway", "hwy": "highway", "trl": "trail", "ter": "terrace", "sq": "square"}
DIRECTIONS = {"n": "north", "s": "south", "e": "east", "w": "west", "ne": "northeast", "nw": "northwest", "se": "southeast", "sw": "southwest"}
STATES = {
    "AL": "alabama", "AK": "alaska", "AZ": "arizona", "AR": "arkansas", "CA": "california", "CO": "colorado", "CT": "connecticut", "DE": "delaware", "FL": "florida", "GA": "georgia", "HI": "hawaii", "ID": "idaho", "IL": "illinois", "IN": "indiana", "IA": "iowa", "KS": "kansas", "KY": "kentucky",
    "LA": "louisiana", "ME": "maine", "MD": "maryland", "MA": "massachusetts", "MI": "michigan", "MN": "minnesota", "MS": "mississippi", "MO": "missouri", "MT": "montana", "NE": "nebraska", "NV": "nevada", "NH": "new hampshire", "NJ": "new jersey", "NM": "new mexico", "NY": "new york", "NC": "north carolina",
    "ND": "north dakota", "OH": "ohio", "OK": "oklahoma", "OR": "oregon", "PA": "pennsylvania", "RI": "rhode island", "SC": "south carolina", "SD": "south dakota", "TN": "tennessee", "TX": "texas", "UT": "utah", "VT": "vermont", "VA": "virginia", "WA": "washington", "WV": "west virginia", "WI": "wisconsin", "WY": "wyoming", "DC": None,
}
ORDINAL = r"(?i)^\d+(st|nd|rd|th)$"
POI_KEYS = ("amenity", "shop", "tourism", "leisure", "office")
ROAD_WORDS = sorted({*STREET_TYPES, *STREET_TYPES.values(), "route", "rte", "pass"})


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def normalize(text: Column) -> Column:
    """Lower case, commas as spaces, runs of white space as one."""
    return F.trim(F.regexp_replace(F.translate(F.lower(F.trim(text)), ",", " "), r"\s+", " "))


def tokens(text: Column) -> Column:
    """Words of a text, commas as spaces."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), ",", " "), r"\s+"), lambda t: t != "")


def parse_coords(text: Column) -> Column:
    """``lat, lon`` -> struct, null unless both are numbers in range."""
    pattern = r"^\s*(-?\d+\.?\d*)\s*[,\s]\s*(-?\d+\.?\d*)\s*$"
    lat, lon = (F.regexp_extract(text, pattern, i).try_cast("double") for i in (1, 2))
    return F.when(lat.between(-90, 90) & lon.between(-180, 180), F.struct(lat.alias("lat"), lon.alias("lon")))


def expand_street(text: Column) -> Column:
    """Street-type abbreviations spelled out, ordinals left alone; lower case."""
    known = literal_map(STREET_TYPES)
    return F.array_join(F.transform(tokens(F.lower(text)), lambda t: F.when(F.rlike(t, F.lit(ORDINAL)), t).otherwise(F.coalesce(F.try_element_at(known, t), t))), " ")


def longest_common_subsequence(a: Column, b: Column) -> Column:
    """Length, by the row-by-row table folded over the characters of ``a``; for short texts such as names."""
    chars = lambda x: F.filter(F.split(x, ""), lambda c: c != "")
    other = chars(b)

    def row(above: Column, c: Column) -> Column:
        # Cell j needs cell j-1 of this row, so the row is folded too; `above` has a leading 0.
        start = F.struct(F.array(F.lit(0)).alias("cells"), F.lit(0).alias("last"))
        walked = F.aggregate(
            F.transform(other, lambda x, j: F.struct(x.alias("x"), F.get(above, j).alias("diagonal"), F.get(above, j + 1).alias("up"))),
            start,
            lambda s, p: F.transform(F.array(F.when(p["x"] == c, p["diagonal"] + 1).otherwise(F.greatest(p["up"], s["last"]))), lambda v: F.struct(F.concat(s["cells"], F.array(v)).alias("cells"), v.alias("last")))[0],
        )
        return walked["cells"]

    return F.element_at(F.aggregate(chars(a), F.transform(F.sequence(F.lit(0), F.size(other)), lambda _: F.lit(0)), row), -1)


def common_length(a: str, b: str) -> int:
    """Longest common subsequence by bit-parallel rows: one integer step a character of ``b``."""
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    full = free = (1 << len(a)) - 1
    for ch in b:
        hit = free & places.get(ch, 0)
        free = (free + hit | free - hit) & full
    return len(a) - free.bit_count()


def indel_ratio(a: Column, b: Column) -> Column:
    """100 * (1 - insertions and deletions / total length): 200 * LCS / (|a| + |b|); 100 for two empty texts.

    Arrow-batched: a pair that repeats inside a batch, as street names do, is worked out once.  The built-in form,
    :func:`longest_common_subsequence`, interprets a table cell at a time and is some ten times slower.
    """

    def ratios(left: pd.Series, right: pd.Series) -> pd.Series:
        seen: dict = {}
        out = []
        for pair in zip(left, right, strict=True):
            if pair not in seen:
                total = None if None in pair else len(pair[0]) + len(pair[1])
                seen[pair] = None if total is None else 200.0 * common_length(*pair) / total if total else 100.0
            out.append(seen[pair])
        return pd.Series(out, dtype=float)

    return F.pandas_udf(ratios, "double")(a, b)


def token_sort_ratio(a: Column, b: Column) -> Column:
    tidy = lambda x: F.array_join(F.array_sort(F.filter(F.split(x, r"\s+"), lambda t: t != "")), " ")
    return indel_ratio(tidy(a), tidy(b))


def token_coverage(query: Column, name: Column) -> Column:
    """Share of the query's distinct words that occur inside the name."""
    words = F.array_distinct(tokens(F.upper(query)))
    return F.when(F.size(words) == 0, F.lit(0.0)).otherwise(F.size(F.filter(words, lambda t: F.contains(F.upper(name), t))) / F.size(words))


def trigrams(text: Column) -> Column:
    """Distinct trigrams of each word, padded by two spaces before and one after."""
    words = F.filter(F.split(F.lower(text), r"[^0-9\p{L}]+"), lambda w: w != "")
    each = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(each))


def trigram_similarity(a: Column, b: Column) -> Column:
    ta, tb = trigrams(a), trigrams(b)
    union = F.size(F.array_union(ta, tb))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(ta, tb)) / union)


def confidence(score: Column) -> Column:
    return F.when(score >= 10, "exact").when(score >= 5, "high").when(score >= 2, "medium").otherwise("low")


def feature_type(osm_key: Column, osm_value: Column, kind: Column, house: Column) -> Column:
    return F.when(osm_key.isin(*POI_KEYS), "poi").when((F.coalesce(house, F.lit("")) != "") | osm_value.isin("house", "residential"), "street_address").when(kind.isin("city", "town", "village", "hamlet", "county", "state", "country"), "locality").otherwise("poi")


def display_name(house: Column, street: Column, name: Column, *places: Column) -> Column:
    """House and street, then the name if it says more, then places, none equal to the part before it."""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    head = F.when(has(house) & has(street), F.array(F.concat_ws(" ", house, street), F.when(has(name) & (name != street), name))).when(has(name), F.array(name)).when(has(street), F.array(street)).otherwise(F.array().cast("array<string>"))
    start = F.filter(head, lambda p: p.isNotNull())
    parts = F.aggregate(F.filter(F.array(*places), has), start, lambda s, p: F.when((F.size(s) > 0) & (F.element_at(s, -1) == p), s).otherwise(F.concat(s, F.array(p))))
    shown = F.array_join(parts, ", ")
    return F.when(shown == "", "Unknown").otherwise(shown)


def mask_key(value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) == "", None).when(F.length(value) <= 8, "****").otherwise(F.concat(F.left(value, F.lit(4)), F.lit("..."), F.right(value, F.lit(4))))


def format_distance(metres: Column) -> Column:
    """Feet below a mile, else miles to one decimal."""
    miles = metres * 0.000621371
    return F.when(miles < 1, F.concat(F.format_number(F.bround(metres * 3.28084), 0), F.lit(" ft"))).otherwise(F.concat(F.format_string("%.1f", miles), F.lit(" mi")))


def format_minutes(minutes: Column) -> Column:
    m = F.round(minutes).cast("int")
    return F.when(m < 60, F.format_string("%d min", m)).otherwise(F.format_string("%dh %dm", (m / 60).cast("int"), m % 60))


def leading_int(text: Column) -> Column:
    return F.regexp_extract(text, r"^\s*(\d+)", 1).try_cast("int")


def humanize(cls: Column, kind: Column, exact: dict, prefixes: dict) -> Column:
    """Label of a (class, type) pair: exact, by class, or generic title case."""
    cls, kind = F.lower(cls), F.lower(kind)
    nice = lambda c: F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))
    known = F.try_element_at(literal_map({f"{a}:{b}": v for (a, b), v in exact.items()}), F.concat_ws(":", cls, kind))
    prefix = F.try_element_at(literal_map(prefixes), cls)
    general = F.when(prefix.isNotNull(), F.when(prefix == nice(kind), prefix).otherwise(F.concat_ws(": ", prefix, nice(kind)))).otherwise(F.concat_ws(": ", nice(cls), nice(kind)))
    return F.when((F.coalesce(cls, F.lit("")) == "") | (F.coalesce(kind, F.lit("")) == ""), "Place").otherwise(F.coalesce(known, general))


def format_phone(text: Column) -> Column:
    """Ten digits (a leading 1 apart) in the US way, else as it is."""
    digits = F.regexp_replace(text, r"\D", "")
    ten = F.when((F.length(digits) == 11) & F.startswith(digits, F.lit("1")), F.substr(digits, F.lit(2), F.lit(10))).when(F.length(digits) == 10, digits)
    return F.coalesce(F.regexp_replace(ten, r"^(\d{3})(\d{3})(\d{4})$", "($1) $2-$3"), text)


def decode_code(code: Column, names: dict) -> Column:
    c = F.trim(code)
    return F.coalesce(F.try_element_at(literal_map(names), c), c, F.lit(""))


def build_address(house: Column, street: Column, city: Column, state: Column, zipcode: Column) -> Column:
    blank = lambda c: F.when(c != "", c)
    tail = F.concat_ws(" ", blank(state), blank(zipcode))
    return F.concat_ws(", ", blank(F.concat_ws(" ", blank(house), blank(street))), blank(city), blank(tail))
