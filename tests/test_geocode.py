"""Geocoding and retrieval against plain Python over all pairs, and cases that retrieval must not lose."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from cairnway.functions import text
from cairnway.operators import geocoding, retrieval

ADDRESSES = "aid long, number string, street string, city string, state string, zipcode string, lat double, lon double"
FEATURES = "fid long, name string, osm_key string, osm_value string, type string, housenumber string, street string, city string, county string, state string, country string, lat double, lon double"


def metres(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371000 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def expanded(s):
    return [t if re.match(r"^\d+(st|nd|rd|th)$", t) else text.STREET_TYPES.get(t, t) for t in s.lower().replace(",", " ").split()]


def words(s):
    return list(dict.fromkeys(t for t in expanded(s) if t not in retrieval.SKIPPED))


def one_out(w):
    return {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}


def worth(asked, found):
    if asked == found:
        return 1.0
    if len(asked) >= 3 and found.startswith(asked) and not re.fullmatch(r"[0-9]+", found):
        return 0.8
    return 0.6 if min(len(asked), len(found)) >= 4 and not re.search("[0-9]", asked + found) and one_out(asked) & one_out(found) else 0.0


def plain_free_text(asked, features, limit):
    """Every query against every feature."""
    held = {f["fid"]: words(" ".join(f[c] for c in ("name", "housenumber", "street", "city", "state", "osm_value") if f[c] is not None)) for f in features}
    df = {}
    for ws in held.values():
        for w in ws:
            df[w] = df.get(w, 0) + 1
    out = {}
    for qid, q, lat, lon in asked:
        ws, hits = words(q), []
        for f in features:
            best = [max((worth(w, v) * math.log(1 + len(features) / df[v]) for v in held[f["fid"]]), default=0.0) for w in ws]
            some = sorted(b for b in best if b > 0)
            if ws and len(some) >= len(ws) - len(ws) // 4:
                near = 0.0 if lat is None else math.exp(-metres(f["lat"], f["lon"], lat, lon) / 1000 / 64)
                hits.append((-round(sum(some) * (1 + 0.5 * near), 6), f["fid"]))
        out[qid] = [fid for _, fid in sorted(hits)[:limit]]
    return out


def some_features(rnd, n):
    rows = []
    for i in range(n):
        kind = rnd.randrange(4)
        street = rnd.choice(["Main Street", "Maine Avenue", "Oak Road", "Boisean Way"])
        city = rnd.choice(["Boise", "Nampa", None])
        name = [rnd.choice(["Blue", "Bluff", "Red"]) + " " + rnd.choice(["Coffee", "Cafe", "Market"]), None, street, rnd.choice(["Filer", "Buhl", "Boise"])][kind]
        rows.append((i, name, ["amenity", "place", "highway", "place"][kind], ["cafe", "house", "residential", "city"][kind], ["house", "house", "street", "city"][kind], str(rnd.randint(98, 104)) if kind == 1 else None, street if kind in (1, 2) else None, city, None, "ID", "United States", 43 + rnd.random(), -117 + rnd.random()))
    return rows


ASKED = ["100 Mian St", "coffee in Boise", "Boise Idaho", "blu cofee nampa", "101 main street, Boise ID", "filer", "xyz", "id", "99 oak rd boise id 83701", "Mane Avenue Nampa ID", "", "the of"]


def test_free_text_equals_every_query_against_every_feature(spark):
    rows = some_features(random.Random(1), 300)
    asked = [(i, q, *place) for i, q in enumerate(ASKED * 2) for place in [(None, None) if i < len(ASKED) else (43.5, -116.5)]]
    index = retrieval.Index.of(spark.createDataFrame(rows, FEATURES))
    got = retrieval.free_text(spark.createDataFrame([(*a, None) for a in asked], "qid long, q string, lat double, lon double, zoom int"), index, 10).collect()
    names = FEATURES.replace(",", "").split()[::2]
    want = plain_free_text(asked, [dict(zip(names, r, strict=True)) for r in rows], 10)
    assert {(r.qid, r.position): r.fid for r in got} == {(q, i): fid for q, hits in want.items() for i, fid in enumerate(hits)}
    assert want[0] and want[1] and want[3]  # a misspelt street, a kind of place in a city, two misspelt words


def test_nothing_is_lost_before_the_city_is_looked_at(spark):
    rows = [(i, "100", "MAIN ST", "BOISE" if i == 60 else "NAMPA", "ID", "83601", 43.0 + i / 100, -116.5) for i in range(1, 61)]
    none = spark.createDataFrame([], FEATURES)
    out = geocoding.geocode(spark.createDataFrame([(1, "100 Main St, Boise ID")], "qid long, q string"), spark.createDataFrame(rows, ADDRESSES), none, 5).collect()
    assert [(r.place, r.id, r.confidence) for r in out] == [(1, 60, "exact")]


def test_number_neighbours_are_found_and_told_apart(spark):
    features = [(1, None, "place", "house", "house", "102", "Main Street", "Boise", None, "ID", "United States", 43.1, -116.1), (2, "Main Street", "highway", "residential", "street", None, "Main Street", "Boise", None, "ID", "United States", 43.2, -116.2), (3, None, "place", "house", "house", "90", "Main Street", "Nampa", None, "ID", "United States", 43.3, -116.3)]
    out = geocoding.geocode(spark.createDataFrame([(1, "100 Main St, Boise ID")], "qid long, q string"), spark.createDataFrame([], ADDRESSES), spark.createDataFrame(features, FEATURES), 5).orderBy("place").collect()
    assert {(r.id, r.match_number, r.match_street, r.match_city) for r in out} == {(1, "unmatched", "matched", "matched"), (2, "inferred", "matched", "matched")}
    assert next(r.score for r in out if r.id == 1) < next(r.score for r in out if r.id == 2)


def test_every_kind_of_question_has_its_answer(spark):
    addresses = [(2, "100", "MAIN ST", "BOISE", "ID", "83601", 43.5, -116.5), (4, "100", "MAIN AVE", "NAMPA", "ID", "83602", 43.6, -116.6), (6, "100", "MAIN ST", "BOISE", "ID", "83601", 43.50001, -116.5), (8, "7", "OAK RD", "EAGLE", "ID", "83603", 43.7, -116.7)]
    features = [(1, "Nampa", "place", "city", "city", None, None, None, None, "ID", "United States", 43.54, -116.56), (2, "Blue Coffee", "amenity", "cafe", "house", None, None, "Boise", None, "ID", "United States", 43.61, -116.2), (3, "Coffee Road", "highway", "residential", "street", None, "Coffee Road", "Boise", None, "ID", "United States", 43.62, -116.21)]
    book = [(1, "Home", ["home", "casa"], 43.50002, -116.5), (2, "Shop", ["shop"], None, None)]
    asked = [(1, "100 Main St, Boise ID 83601"), (2, "83603"), (3, "Nampa ID"), (4, " 43.5, -116.2 "), (5, "coffee in boise"), (6, "Home"), (7, ""), (8, None), (9, "100 Main St, Boise ID 83601"), (10, "shop")]
    out = geocoding.geocode(spark.createDataFrame(asked, "qid long, q string"), spark.createDataFrame(addresses, ADDRESSES), spark.createDataFrame(features, FEATURES), 5, spark.createDataFrame(book, "entry int, name string, forms array<string>, lat double, lon double")).collect()
    got = {(r.qid, r.place): (r.source, r.id, r.type) for r in out}
    assert got == {
        (1, 1): ("addresses", 2, "street_address"),  # 6 stands within 50 m of 2, from the same source
        (9, 1): ("addresses", 2, "street_address"),
        (2, 1): ("addresses", 8, "street_address"),
        (3, 1): ("features", 1, "locality"),
        (4, 1): ("coordinates", None, "coordinates"),
        (5, 1): ("features", 2, "poi"),  # a business gains and a way loses where no road is asked for
        (5, 2): ("features", 3, "street_address"),
        (6, 1): ("address_book", 1, "nickname"),
    }
    assert {(r.qid, r.labeled_as) for r in out if r.labeled_as} == {(1, "Home"), (9, "Home"), (6, "Home")}
    assert next((r.lat, r.lon, r.confidence) for r in out if r.qid == 4) == (43.5, -116.2, "exact")


def plain_ratio(a, b):
    """Insertions and deletions only, as a share of both lengths."""
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    return 200.0 * rows[-1][-1] / (len(a) + len(b)) if a or b else 100.0


def test_ranking_of_the_whole_table_equals_plain_scores(spark):
    """geo_rank and fn_match_code over the smallest tables: all twelve signals worked out again, pair by pair."""
    from cairnway.plans import geocode as plans
    from cairnway.plans import registry

    sf = "/root/testdata/sf0.001"
    w = geocoding.WEIGHTS
    types, roads = set(text.STREET_TYPES.values()), set(text.ROAD_WORDS)
    queries = {r.qid: r for r in plans.parsed_queries(spark, sf).collect()}
    codes, plain = {}, {}
    for r in plans.retrieved(spark, sf).collect():
        q = queries[r.qid]
        qs, cs = expanded(q.street), expanded(r.street or "")
        ratio = plain_ratio(" ".join(sorted(qs)), " ".join(sorted(cs)))
        city = plain_ratio(q.city.upper(), r.city.upper()) if q.city and r.city else None
        asked = {t for t in q.q.upper().replace(",", " ").split()}
        total = w["housenumber_exact"] if r.number == q.number else w["housenumber_mismatch"] if r.number else 0
        total += (ratio / 100 * w["street_name_fuzz"] + (w["street_type_match"] if set(qs) & types & set(cs) else 0)) if r.street else 0
        total += sum(t in r.name.upper() for t in asked) / len(asked) * w["token_coverage"]
        total += city / 100 * w["locality_fuzz"] if city is not None else 0
        total += w["state_exact"] if q.state == r.state else 0
        total += w["source_authority"] if r.source == "addresses" else max(0, 1 - r.rank / 10) * w["position"]
        total += w["layer_rank"] if r.type == "street_address" else 0
        if not {t.lower() for t in asked} & roads:
            total += w["poi_class_boost"] if r.osm_key in geocoding.BUSINESS else w["highway_class_penalty"] if r.osm_key in geocoding.WAYS else 0
        plain.setdefault(r.qid, []).append((total, r.source_order, r.position, r.source, r.id))
        codes[r.qid, r.source, r.id, r.source_order] = (
            "inferred" if not r.number else "matched" if r.number == q.number else "unmatched",
            "inferred" if not r.street else "matched" if ratio > 80 else "unmatched",
            None if not q.city else "inferred" if not r.city else "matched" if city > 80 else "unmatched",
        )
    got = registry.queries()["geo_rank"](spark, sf).collect()
    want = {(qid, place): x for qid, xs in plain.items() for place, x in enumerate(sorted(xs, key=lambda x: (-round(x[0], 2), *x[1:3]))[:10], 1)}
    assert {(r.qid, r.place): (r.source, r.id) for r in got} == {k: x[3:] for k, x in want.items()}
    assert all(r.score == pytest.approx(want[r.qid, r.place][0], abs=0.0051) for r in got)
    told = registry.queries()["fn_match_code"](spark, sf).collect()
    assert {(r.qid, r.source, r.id, r.source_order): (r.match_number, r.match_street, r.match_city) for r in told} == codes


def test_equal_questions_are_worked_out_once(spark):
    """As many candidates are scored for a question that many ask as for one."""
    one = spark.createDataFrame([(1, "filer")], "qid long, q string")
    many = spark.range(500).select("id", F.lit("filer").alias("q")).withColumnRenamed("id", "qid")
    features = spark.createDataFrame(some_features(random.Random(2), 60), FEATURES)
    none = spark.createDataFrame([], ADDRESSES)
    single = sorted((r.place, r.id) for r in geocoding.geocode(one, none, features, 5).collect())
    got = geocoding.geocode(many, none, features, 5).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("place", "id"))).alias("x")).collect()
    assert single and len(got) == 500 and all([tuple(p) for p in r.x] == single for r in got)
