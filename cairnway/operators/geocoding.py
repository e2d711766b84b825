"""Set-at-a-time geocoding: a table of queries meets tables of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, text
from ..sources.writers import rewritten
from . import retrieval
from .ranking import first_rows
from .spatial import first_within

C = F.col
#: What each signal weighs.
WEIGHTS = {"housenumber_exact": 6.0, "housenumber_mismatch": -5.0, "street_name_fuzz": 3.0, "token_coverage": 2.0, "street_type_match": 1.5, "locality_fuzz": 2.0, "source_authority": 2.0, "layer_rank": 1.0, "position": 1.0, "state_exact": 1.0, "poi_class_boost": 3.0, "highway_class_penalty": -4.0}
#: Classes of places that are businesses, and of ways.
BUSINESS, WAYS = ("amenity", "shop", "tourism", "leisure", "office", "craft"), ("highway", "route")
def _words(q: Column) -> Column:
    return F.filter(F.split(q, r"[,\s]+"), lambda t: t != "")


def parse_free(rows: DataFrame, column: str) -> DataFrame:
    """Free text -> zipcode, state, number, city, street: what trails is cut off first, then what leads."""
    q = F.trim(C(column))
    out = rows.withColumn("zipcode", F.nullif(F.regexp_extract(q, r"\b(\d{5})\s*$", 1), F.lit(""))).withColumn("w", _words(F.regexp_replace(q, r"\b\d{5}\s*$", "")))
    last = F.upper(F.try_element_at("w", F.lit(-1)))
    out = out.withColumn("state", F.when((F.size("w") >= 2) & last.isin(*text.STATES), last))
    drop_last = F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0)))
    out = out.withColumn("w", F.when(C("state").isNotNull(), drop_last).otherwise(C("w")))
    out = out.withColumn("number", F.when(F.rlike(F.get("w", F.lit(0)), F.lit(r"^\d")), F.get("w", F.lit(0))))
    out = out.withColumn("w", F.when(C("number").isNotNull(), F.slice("w", F.lit(2), F.size("w"))).otherwise(C("w")))
    has_city = C("state").isNotNull() & (F.size("w") >= 2)
    out = out.withColumn("city", F.when(has_city, F.try_element_at("w", F.lit(-1)))).withColumn("w", F.when(has_city, drop_last).otherwise(C("w")))
    return out.withColumn("street", F.nullif(F.array_join("w", " "), F.lit(""))).drop("w")


def classify(rows: DataFrame, column: str) -> DataFrame:
    """Parsed components with ``intent``: COORD, ADDRESS, POSTCODE, LOCALITY or UNKNOWN."""
    out = parse_free(rows, column)
    w = text.tokens(C(column))
    last, two = F.lower(F.try_element_at(w, F.lit(-1))), F.lower(F.concat_ws(" ", F.try_element_at(w, F.lit(-2)), F.try_element_at(w, F.lit(-1))))
    names = [n for n in text.STATES.values() if n]
    local = (F.size(w) >= 2) & (F.upper(last).isin(*text.STATES) | last.isin(*[n for n in names if " " not in n]) | ((F.size(w) >= 3) & two.isin(*[n for n in names if " " in n])))
    only_zip = C("zipcode").isNotNull() & C("number").isNull() & C("street").isNull()
    intent = F.when(text.parse_coords(C(column)).isNotNull(), "COORD").when(C("number").isNotNull() & C("street").isNotNull(), "ADDRESS").when(only_zip, "POSTCODE").when(local, "LOCALITY").otherwise("UNKNOWN")
    return out.withColumn("intent", intent)


def fix_directional(rows: DataFrame, column: str) -> DataFrame:
    """``214 N St Filer``: a short direction followed by a street type is the street's name; what follows is the city."""
    w = _words(F.trim(C(column)))
    types = [*text.STREET_TYPES, *text.STREET_TYPES.values()]
    turned = F.lower(F.get(w, F.lit(1))).isin(*text.DIRECTIONS) & F.lower(F.get(w, F.lit(2))).isin(*types) & (F.size(w) > 3)
    rest = lambda i: F.array_join(F.slice(w, F.lit(i), F.size(w)), " ")
    return rows.select("*", F.get(w, F.lit(0)).alias("number"), F.when(turned, F.concat_ws(" ", F.get(w, F.lit(1)), F.get(w, F.lit(2)))).otherwise(rest(2)).alias("street"), F.when(turned, rest(4)).alias("city"))


def exact_addresses(queries: DataFrame, addresses: DataFrame, limit: int, near: bool = False) -> DataFrame:
    """Number and street have to match; city, state and zip code where the query has them.  The limit comes after all of them.

    With ``near`` the addresses nearest to the query's own place (``lat``, ``lon``) come first, else those of least id.
    """
    if near:
        placed = C("lat").isNotNull() & C("lon").isNotNull()
        here, anywhere = queries.where(placed), queries.where(~placed)
        return _exact(here, addresses, limit, True).unionByName(_exact(anywhere, addresses, limit, False))
    return _exact(queries, addresses, limit, False)


def _exact(queries: DataFrame, addresses: DataFrame, limit: int, near: bool) -> DataFrame:
    q = queries.select("qid", F.upper(F.trim("number")).alias("number"), F.upper(F.trim("street")).alias("street"), F.upper("city").alias("qcity"), F.upper("state").alias("qstate"), C("zipcode").alias("qzip"), *[C(c).alias("q" + c) for c in ("lat", "lon") if near])
    if not near:  # of addresses that say the same only the first can be among the first
        addresses = first_rows(addresses, ["number", "street", "city", "state", "zipcode"], ["aid"], limit).drop("n")
    met = q.join(addresses, ["number", "street"])
    optional = lambda a, b: a.isNull() | (a == b)
    met = met.where(optional(C("qcity"), C("city")) & optional(C("qstate"), C("state")) & optional(C("qzip"), C("zipcode"))).drop("qcity", "qstate", "qzip")
    return first_rows(met, ["qid"], [*([squared_degrees().asc_nulls_last()] if near else []), "aid"], limit).drop("qlat", "qlon")


def squared_degrees() -> Column:
    return (C("lat") - C("qlat")) * (C("lat") - C("qlat")) + (C("lon") - C("qlon")) * (C("lon") - C("qlon"))


def by_zip(queries: DataFrame, addresses: DataFrame, limit: int, near: bool = False) -> DataFrame:
    """Addresses of the query's zip code.  Without a place of the query they are the same for all that ask for the code, so the
    first ``limit`` of each code are found before queries meet them."""
    if near:
        placed = C("lat").isNotNull() & C("lon").isNotNull()
        q = queries.where(C("zipcode").isNotNull() & placed).select("qid", "zipcode", C("lat").alias("qlat"), C("lon").alias("qlon"))
        here = first_rows(q.join(addresses, "zipcode"), ["qid"], [squared_degrees().asc_nulls_last(), "aid"], limit).drop("qlat", "qlon")
        return here.unionByName(by_zip(queries.where(~placed), addresses, limit))
    q = queries.where("zipcode is not null").select("qid", "zipcode")
    return first_rows(q.join(first_rows(addresses, ["zipcode"], ["aid"], limit, "nth").drop("nth"), "zipcode"), ["qid"], ["aid"], limit)


#: Columns of a candidate beside qid and what the query asked for.
FOUND = ("source", "id", "name", "type", "osm_key", "number", "street", "city", "state", "lat", "lon", "rank", "source_order", "position")


def of_addresses(rows: DataFrame) -> DataFrame:
    none = lambda c, kind="string": F.lit(None).cast(kind).alias(c)
    name = F.concat_ws(" ", "number", "street", "city", "state", "zipcode")
    return rows.select("qid", F.lit("addresses").alias("source"), C("aid").alias("id"), name.alias("name"), F.lit("street_address").alias("type"), none("osm_key"), "number", "street", "city", "state", "lat", "lon", none("rank", "int"), F.lit(1).alias("source_order"), (C("n") - 1).alias("position"))


def of_features(hits: DataFrame, features: DataFrame, source_order: int) -> DataFrame:
    """(qid, fid, position) with what the features say; a locality's name is its city."""
    kind = text.feature_type(C("osm_key"), C("osm_value"), C("type"), C("housenumber"))
    blank = lambda c: F.coalesce(c, F.lit(""))
    shown = text.display_name(C("housenumber"), C("street"), C("name"), C("city"), C("county"), C("state"), C("country"))
    f = features.select(C("fid").alias("id"), shown.alias("name"), kind.alias("type"), "osm_key", C("housenumber").alias("number"), "street", F.when((blank(C("city")) == "") & (kind == "locality"), C("name")).otherwise(C("city")).alias("city"), "state", "lat", "lon")
    return hits.select("qid", C("fid").alias("id"), C("position").alias("rank"), F.lit(source_order).alias("source_order"), "position").join(f, "id").select("qid", F.lit("features").alias("source"), *FOUND[1:])


def candidates(parsed: DataFrame, addresses: DataFrame, features: DataFrame, limit: int, index: retrieval.Index | None = None) -> DataFrame:
    """Candidates of parsed queries (qid, q, intent, number, street, city, state, zipcode, lat, lon, zoom) from each source.

    Addresses by number and street or by zip code, features by free text and by street; every limit is on results in order of
    what makes them fit, after all filters.  ``aid`` and ``fid`` are ids, ``rank`` is a feature's place in its list.
    """
    index = index or retrieval.Index.of(features)
    at = lambda *intents: C("intent").isin(*intents)
    exact = exact_addresses(parsed.where(at("ADDRESS")), addresses, limit, near=True)
    postal = by_zip(parsed.where(at("POSTCODE")), addresses, limit, near=True)
    columns = ["qid", "aid", "number", "street", "city", "state", "zipcode", "lat", "lon", "n"]
    text_hits = retrieval.free_text(parsed.where(~at("COORD")), index, limit)
    street_hits = retrieval.structured(parsed.where(at("ADDRESS")), features, 5)
    found = of_addresses(exact.select(columns).unionByName(postal.select(columns)))
    found = found.unionByName(of_features(text_hits, features, 2)).unionByName(of_features(street_hits, features, 3))
    asked = parsed.select("qid", "intent", C("q").alias("asked"), C("number").alias("qn"), C("street").alias("qs"), C("city").alias("qc"), C("state").alias("qst"))
    return found.join(asked, "qid")


def score(pairs: DataFrame, fuzzy: bool = True) -> DataFrame:
    """Sum of weighted signals; ``signals`` holds those that are not 0.

    What a source or a type is worth depends on the query's ``intent``; businesses gain and ways lose where the query
    names no kind of road.
    """
    w = WEIGHTS
    qs, cs = text.expand_street(C("qs")), text.expand_street(C("street"))
    types = F.array(*[F.lit(t) for t in sorted(set(text.STREET_TYPES.values()))])
    asked, upper = C("asked"), lambda c: F.nullif(F.upper(F.trim(c)), F.lit(""))
    qn, number, street = upper(C("qn")), upper(C("number")), C("street").isNotNull() & C("qs").isNotNull()
    addressed = (C("intent") == "ADDRESS") & qn.isNotNull()
    roads = F.array(*[F.lit(t) for t in text.ROAD_WORDS])
    business = ~C("intent").isin("LOCALITY", "POSTCODE", "COORD") & ~F.arrays_overlap(F.split(F.lower(asked), r"[,\s]+"), roads)
    of_kind = lambda intent, kind: (C("intent") == intent) & (C("type") == kind)
    signals = {
        "housenumber_exact": F.when(addressed & (qn == number), w["housenumber_exact"]),
        "housenumber_mismatch": F.when(addressed & (qn != number), w["housenumber_mismatch"]),
        "street_type_match": F.when(street & F.arrays_overlap(F.array_intersect(F.split(qs, " "), types), F.split(cs, " ")), w["street_type_match"]),
        "token_coverage": text.token_coverage(asked, C("name")) * w["token_coverage"],
        "state_exact": F.when(upper(C("qst")) == upper(C("state")), w["state_exact"]),
        "source_authority": F.when((C("source") == "addresses") & (C("intent") == "ADDRESS"), w["source_authority"]),
        "layer_rank": F.when(of_kind("ADDRESS", "street_address") | of_kind("LOCALITY", "locality") | of_kind("POI", "poi"), w["layer_rank"]),
        "poi_class_boost": F.when(business & C("osm_key").isin(*BUSINESS), w["poi_class_boost"]),
        "highway_class_penalty": F.when(business & C("osm_key").isin(*WAYS), w["highway_class_penalty"]),
        "position": F.when(C("rank").isNotNull(), F.greatest(F.lit(0.0), 1.0 - C("rank") / 10.0) * w["position"]),
    }
    if fuzzy:
        signals["street_name_fuzz"] = F.when(street, text.token_sort_ratio(qs, cs) / 100.0 * w["street_name_fuzz"])
        signals["locality_fuzz"] = text.indel_ratio(upper(C("qc")), upper(C("city"))) / 100.0 * w["locality_fuzz"]
    total = F.lit(0.0)
    for s in signals.values():
        total = total + F.coalesce(s, F.lit(0.0))
    shown_signals = F.map_filter(F.create_map(*[x for k, s in signals.items() for x in (F.lit(k), F.round(F.coalesce(s, F.lit(0.0)), 2))]), lambda _, v: v != 0)
    return pairs.withColumn("signals", shown_signals).withColumn("score", total)


def rerank(scored: DataFrame, limit: int) -> DataFrame:
    """Best scores first, ties as retrieved; with place and confidence."""
    rounded = scored.withColumn("score", F.round("score", 2))
    return first_rows(rounded, ["qid"], [F.desc("score"), "source_order", "position"], limit, "place").withColumn("confidence", text.confidence(C("score")))


def match_code(pairs: DataFrame) -> DataFrame:
    """matched, unmatched, or inferred where the candidate does not say; null where the query does not ask."""
    upper = lambda c: F.nullif(F.upper(F.trim(c)), F.lit(""))
    close = lambda r: F.when(r > 80.0, "matched").otherwise("unmatched")

    def code(asked: Column, found: Column, told: Column) -> Column:
        return F.when((C("intent") == "ADDRESS") & asked.isNotNull(), F.when(found.isNull(), "inferred").otherwise(told))

    qn, number, qs, street, qc, city = (upper(C(c)) for c in ("qn", "number", "qs", "street", "qc", "city"))
    street_ratio = text.token_sort_ratio(text.expand_street(C("qs")), text.expand_street(C("street")))
    out = pairs.withColumn("match_number", code(qn, number, F.when(qn == number, "matched").otherwise("unmatched")))
    return out.withColumn("match_street", code(qs, street, close(street_ratio))).withColumn("match_city", code(qc, city, close(text.indel_ratio(qc, city))))


def drop_close(pairs: DataFrame, metres: float) -> DataFrame:
    """Greedy: a candidate goes if one kept before it, of the same source, is nearer than ``metres``.

    Order matters and closeness is not transitive, so a query's candidates are folded in their order; a query's list is as
    long as what the sources' limits let through.  All columns go through the fold: nothing is joined again.
    """
    item = F.struct("source_order", "position", *[c for c in pairs.columns if c not in ("qid", "source_order", "position")])
    lists = pairs.groupBy("qid").agg(F.array_sort(F.collect_list(item)).alias("all"))
    near = lambda a, b: (a["source"] == b["source"]) & (geo.haversine(a["lat"], a["lon"], b["lat"], b["lon"]) < metres)
    kept = F.aggregate("all", F.filter("all", lambda _: F.lit(False)), lambda s, c: F.when(F.exists(s, lambda k: near(k, c)), s).otherwise(F.concat(s, F.array(c))))
    return lists.select("qid", F.explode(kept).alias("k")).select("qid", "k.*")


#: What geocoding returns for a query, in order of place.
RESULT = ("qid", "intent", "source", "id", "name", "type", "lat", "lon", "score", "place", "confidence", "match_number", "match_street", "match_city", "labeled_as")


def geocode(asked: DataFrame, addresses: DataFrame, features: DataFrame, limit: int, book: DataFrame | None = None, fuzzy: bool = True) -> DataFrame:
    """``asked`` (qid, q, and if wanted lat, lon, zoom) -> RESULT: at most ``limit`` ranked places of each query.

    Coordinates answer themselves; a single word that an address ``book`` (entry, name, forms, lat, lon) knows is that entry; other
    texts are parsed, retrieved from each source, cleared of doubles within 50 m, scored and ranked, and places within 75 m of a
    book's entry carry its name.  Equal questions are worked out once.
    """
    place = [C(c).cast(kind).alias(c) if c in asked.columns else F.lit(None).cast(kind).alias(c) for c, kind in (("lat", "double"), ("lon", "double"), ("zoom", "int"))]
    rows = rewritten(asked.select(C("qid").alias("of"), F.trim("q").alias("q"), *place), "asked")
    same = ["q", "lat", "lon", "zoom"]
    distinct = rewritten(rows.where("q <> ''").select(*same).distinct().select(F.monotonically_increasing_id().alias("qid"), *same), "distinct")
    parsed = rewritten(classify(distinct, "q"), "parsed")
    none = {"lat": "double", "lon": "double", "score": "double", **{f"match_{c}": "string" for c in ("number", "street", "city")}}
    filled = lambda df: df.select(*[C(c) if c in df.columns else F.lit(None).cast(none.get(c, "string")).alias(c) for c in RESULT[:-1]])
    spot = text.parse_coords(C("q"))
    fixed = parsed.where(C("intent") == "COORD").select("qid", "intent", F.lit("coordinates").alias("source"), F.lit(None).cast("long").alias("id"), C("q").alias("name"), F.lit("coordinates").alias("type"), spot["lat"].alias("lat"), spot["lon"].alias("lon"), F.lit(1).alias("place"), F.lit("exact").alias("confidence"))
    rest = parsed.where(C("intent") != "COORD")
    if book is not None:
        single = rest.select("qid", text.normalize(C("q")).alias("q")).where(~F.contains("q", F.lit(" ")))
        known = match_aliases(single, book, "qid").where("confidence = 'exact'").join(book.where("lat is not null and lon is not null").select("entry", "name", "lat", "lon"), "entry")
        known = rewritten(known, "nicknames")
        fixed = fixed.unionByName(known.join(parsed.select("qid", "intent"), "qid").select("qid", "intent", F.lit("address_book").alias("source"), C("entry").cast("long").alias("id"), "name", F.lit("nickname").alias("type"), "lat", "lon", F.lit(1).alias("place"), F.lit("exact").alias("confidence")))
        rest = rest.join(known.select("qid"), "qid", "left_anti")
    pairs = rewritten(candidates(rest, addresses, features, limit), "retrieved")
    ranked = match_code(rerank(score(drop_close(pairs, 50.0), fuzzy), limit))
    out = filled(ranked).unionByName(filled(fixed))
    if book is not None:
        out = rewritten(out, "ranked")
        out = out.join(labels(out, book), ["qid", "place"], "left")
    else:
        out = out.withColumn("labeled_as", F.lit(None).cast("string"))
    equal = [rows[c].eqNullSafe(distinct[c]) for c in same]
    back = rows.join(distinct, equal).select("of", "qid")
    return back.join(out, "qid").select(C("of").alias("qid"), *RESULT[1:])


def labels(found: DataFrame, book: DataFrame, metres: float = 75.0) -> DataFrame:
    """(qid, place) -> the name of the first entry of the book within ``metres``."""
    spots = found.where("lat is not null and lon is not null").select(F.struct("qid", "place").alias("pid"), "lat", "lon")
    entries = book.where("lat is not null and lon is not null").select(C("entry").alias("qid"), "lat", "lon")
    first = first_within(spots, entries, metres).select("pid", "entry")
    return first.join(book.select("entry", C("name").alias("labeled_as")), "entry").select("pid.qid", "pid.place", "labeled_as")


def match_aliases(asked: DataFrame, book: DataFrame, key: str) -> DataFrame:
    """``asked`` (key, q) against ``book`` (entry, forms): an equal form, then a form the query starts with, then the first
    form that starts with the query or stands inside it.  Words of the query are joined with forms, not every pair."""
    forms = book.select("entry", F.posexplode("forms").alias("form_no", "form")).where("form <> ''")
    w = text.tokens(C("q"))
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.size(w)), lambda i: F.transform(F.sequence(i, F.size(w)), lambda j: F.array_join(F.slice(w, i, j - i + 1), " "))))
    inside = asked.where("q <> ''").select(key, "q", F.explode(F.array_distinct(spans)).alias("form")).join(forms, "form")
    rule = F.when(C("q") == C("form"), 1).when(F.startswith("q", F.concat("form", F.lit(" "))), 2).otherwise(3)
    first = inside.select(key, rule.alias("rule"), "entry", "form_no")
    beginnings = forms.where(F.length("form") > 1).select("entry", "form_no", "form", F.explode(F.sequence(F.lit(1), F.length("form") - 1)).alias("n")).select("entry", "form_no", F.left("form", C("n")).alias("q"))
    second = asked.where("q <> ''").join(beginnings, "q").select(key, F.lit(3).alias("rule"), "entry", "form_no")
    best = first.unionByName(second).groupBy(key).agg(F.min(F.struct("rule", "entry", "form_no")).alias("b"))
    return best.select(key, "b.entry", F.when(C("b.rule") <= 2, "exact").otherwise("partial").alias("confidence"))
