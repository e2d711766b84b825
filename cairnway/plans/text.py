"""Queries of the text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from .fixtures import view
from .registry import query

C = F.col
TYPES_SQL = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in text.STREET_TYPES.items()) + "}"
EXPAND = "array_to_string(list_transform(list_filter(regexp_split_to_array(lower(replace({x}, ',', ' ')), '\\s+'), lambda t: t <> ''), lambda t: CASE WHEN regexp_matches(t, '^\\d+(st|nd|rd|th)$') THEN t ELSE coalesce(TYPES[t], t) END), ' ')".replace("TYPES", TYPES_SQL)


def expand_sql(x: str) -> str:
    return EXPAND.replace("{x}", x)


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("fn_normalize", "SELECT o_orderkey, trim(regexp_replace(replace(lower(trim(t)), ',', ' '), '\\s+', ' ', 'g')) AS text FROM (SELECT o_orderkey, '  ' || o_orderpriority || ',  ' || o_orderstatus || '   X ' AS t FROM orders)")
def fn_normalize(spark, sf_dir):
    t = F.concat(F.lit("  "), C("o_orderpriority"), F.lit(",  "), C("o_orderstatus"), F.lit("   X "))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.normalize(t).alias("text"))


COORD = "SELECT pid, CASE pid % 4 WHEN 0 THEN round(lat, 3)::VARCHAR || ',' || round(lon, 3)::VARCHAR WHEN 1 THEN ' ' || round(lat, 3)::VARCHAR || '  ' || round(lon, 3)::VARCHAR WHEN 2 THEN '95.0,10' ELSE 'Boise ID' END AS q FROM fx_points"
PAT = "'^\\s*(-?\\d+\\.?\\d*)\\s*[,\\s]\\s*(-?\\d+\\.?\\d*)\\s*$'"


@query("fn_parse_coords", f"SELECT pid, CASE WHEN ok THEN a END AS lat, CASE WHEN ok THEN b END AS lon FROM (SELECT *, coalesce(a BETWEEN -90 AND 90 AND b BETWEEN -180 AND 180, false) AS ok FROM (SELECT pid, TRY_CAST(regexp_extract(q, {PAT}, 1) AS DOUBLE) AS a, TRY_CAST(regexp_extract(q, {PAT}, 2) AS DOUBLE) AS b FROM ({COORD})))")
def fn_parse_coords(spark, sf_dir):
    lat, lon = F.round("lat", 3).cast("string"), F.round("lon", 3).cast("string")
    q = F.when(C("pid") % 4 == 0, F.concat_ws(",", lat, lon)).when(C("pid") % 4 == 1, F.concat(F.lit(" "), lat, F.lit("  "), lon)).when(C("pid") % 4 == 2, "95.0,10").otherwise("Boise ID")
    at = text.parse_coords(q)
    return view(spark, sf_dir, "fx_points").select("pid", at["lat"].alias("lat"), at["lon"].alias("lon"))


@query("fn_expand_abbrev", f"SELECT aid, {expand_sql('street')} AS street FROM fx_addresses")
def fn_expand_abbrev(spark, sf_dir):
    return view(spark, sf_dir, "fx_addresses").select("aid", text.expand_street(C("street")).alias("street"))


@query("fn_indel_ratio")
def fn_indel_ratio(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select(C("n_nationkey").alias("k"), C("n_name").alias("a"))
    other = nations.select((C("k") + 1).alias("k"), C("a").alias("b"))
    return nations.join(other, "k").select("k", F.round(text.indel_ratio(C("a"), C("b")), 6).alias("ratio"))


@query("fn_token_sort_ratio")
def fn_token_sort_ratio(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    return parts.select("p_partkey", F.round(text.token_sort_ratio(F.lower("p_name"), F.lower("p_type")), 6).alias("ratio"))


@query("fn_token_coverage", "SELECT p_partkey, CASE WHEN len(w) = 0 THEN 0.0e0 ELSE len(list_filter(w, lambda t: contains(upper(p_type), t)))/len(w)::DOUBLE END AS coverage FROM (SELECT p_partkey, p_type, list_distinct(list_filter(regexp_split_to_array(upper(p_name || ', ' || p_brand || ' ' || substr(p_type, 1, 4)), '[,\\s]+'), lambda t: t <> '')) AS w FROM part)")
def fn_token_coverage(spark, sf_dir):
    q = F.concat(C("p_name"), F.lit(", "), C("p_brand"), F.lit(" "), F.substr(C("p_type"), F.lit(1), F.lit(4)))
    return table(spark, sf_dir, "part").select("p_partkey", text.token_coverage(q, C("p_type")).alias("coverage"))


TRI = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({x}), '[^0-9\\p{{L}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


def similarity_sql(a: str, b: str) -> str:
    x, y = TRI.format(x=a), TRI.format(x=b)
    return f"(CASE WHEN len(list_distinct(list_concat({x}, {y}))) = 0 THEN 0.0e0 ELSE len(list_intersect({x}, {y}))/len(list_distinct(list_concat({x}, {y})))::DOUBLE END)"


@query("fn_trgm_similarity", f"SELECT p_partkey, round({similarity_sql('p_name', 'p_type')}, 9) AS similarity FROM part")
def fn_trgm_similarity(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(text.trigram_similarity(C("p_name"), C("p_type")), 9).alias("similarity"))


@query("fn_confidence", "SELECT c_custkey, CASE WHEN c_acctbal >= 10 THEN 'exact' WHEN c_acctbal >= 5 THEN 'high' WHEN c_acctbal >= 2 THEN 'medium' ELSE 'low' END AS confidence FROM customer")
def fn_confidence(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", text.confidence(C("c_acctbal")).alias("confidence"))


FEATURE = "SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN 'amenity' WHEN 1 THEN 'place' WHEN 2 THEN 'building' ELSE 'shop' END AS osm_key, CASE p_size % 3 WHEN 0 THEN 'house' ELSE 'city' END AS osm_value, CASE p_size % 5 WHEN 0 THEN 'city' WHEN 1 THEN 'state' ELSE 'other' END AS kind, CASE WHEN p_partkey % 3 = 0 THEN (p_partkey % 900)::VARCHAR END AS house, CASE WHEN p_partkey % 4 <> 0 THEN 'Main St' END AS street, CASE p_partkey % 5 WHEN 0 THEN 'Main St' WHEN 1 THEN '' ELSE p_name END AS name, CASE WHEN p_partkey % 7 = 0 THEN p_name ELSE 'Boise' END AS city, CASE WHEN p_partkey % 2 = 0 THEN 'Boise' END AS county, 'Idaho' AS state FROM part"


def features(spark, sf_dir):
    k, s = C("p_partkey"), C("p_size")
    return table(spark, sf_dir, "part").select(
        k.alias("id"), F.when(s % 4 == 0, "amenity").when(s % 4 == 1, "place").when(s % 4 == 2, "building").otherwise("shop").alias("osm_key"), F.when(s % 3 == 0, "house").otherwise("city").alias("osm_value"), F.when(s % 5 == 0, "city").when(s % 5 == 1, "state").otherwise("other").alias("kind"),
        F.when(k % 3 == 0, (k % 900).cast("string")).alias("house"), F.when(k % 4 != 0, "Main St").alias("street"), F.when(k % 5 == 0, "Main St").when(k % 5 == 1, "").otherwise(C("p_name")).alias("name"), F.when(k % 7 == 0, C("p_name")).otherwise("Boise").alias("city"), F.when(k % 2 == 0, "Boise").alias("county"), F.lit("Idaho").alias("state"),
    )


@query("fn_feature_type", f"SELECT id, CASE WHEN osm_key IN ('amenity','shop','tourism','leisure','office') THEN 'poi' WHEN house IS NOT NULL OR osm_value IN ('house','residential') THEN 'street_address' WHEN kind IN ('city','town','village','hamlet','county','state','country') THEN 'locality' ELSE 'poi' END AS type FROM ({FEATURE})")
def fn_feature_type(spark, sf_dir):
    return features(spark, sf_dir).select("id", text.feature_type(C("osm_key"), C("osm_value"), C("kind"), C("house")).alias("type"))


@query(
    "fn_display_name",
    f"""SELECT id, array_to_string(list_filter([h1, h2, CASE WHEN city <> coalesce(h2, h1, '') THEN city END, CASE WHEN county IS NOT NULL AND county <> city THEN county END, state], lambda p: p IS NOT NULL), ', ') AS name
    FROM (SELECT *, CASE WHEN house IS NOT NULL AND street IS NOT NULL THEN house || ' ' || street WHEN name <> '' THEN name WHEN street IS NOT NULL THEN street END AS h1, CASE WHEN house IS NOT NULL AND street IS NOT NULL AND name <> '' AND name <> street THEN name END AS h2 FROM ({FEATURE}))""",
)
def fn_display_name(spark, sf_dir):
    return features(spark, sf_dir).select("id", text.display_name(C("house"), C("street"), C("name"), C("city"), C("county"), C("state")).alias("name"))


@query("fn_mask_key", "SELECT p_partkey, CASE WHEN k = '' THEN NULL WHEN length(k) <= 8 THEN '****' ELSE substr(k, 1, 4) || '...' || right(k, 4) END AS masked FROM (SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN '' ELSE substr(p_name || p_brand, 1, 4 + p_partkey::INT % 12) END AS k FROM part)")
def fn_mask_key(spark, sf_dir):
    k = F.when(C("p_partkey") % 10 == 0, "").otherwise(F.substr(F.concat("p_name", "p_brand"), F.lit(1), (4 + C("p_partkey") % 12).cast("int")))
    return table(spark, sf_dir, "part").select("p_partkey", text.mask_key(k).alias("masked"))


@query("fn_format_distance", "SELECT l_orderkey, l_linenumber, CASE WHEN m*0.000621371e0 < 1 THEN format('{:,}', CAST(round_even(m*3.28084e0, 0) AS BIGINT)) || ' ft' ELSE printf('%.1f', m*0.000621371e0) || ' mi' END AS shown FROM (SELECT l_orderkey, l_linenumber, l_quantity*61.7e0 AS m FROM lineitem)")
def fn_format_distance(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.format_distance(C("l_quantity") * 61.7).alias("shown"))


@query("fn_format_time", "SELECT l_orderkey, l_linenumber, CASE WHEN m < 60 THEN printf('%d min', m) ELSE printf('%dh %dm', m // 60, m % 60) END AS shown FROM (SELECT l_orderkey, l_linenumber, CAST(round(l_quantity*3.7e0) AS INT) AS m FROM lineitem)")
def fn_format_time(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.format_minutes(C("l_quantity") * 3.7).alias("shown"))


@query("fn_format_fe", "SELECT pid, CASE WHEN pid % 3 = 0 THEN t ELSE '(' || substr(d, 1, 3) || ') ' || substr(d, 4, 3) || '-' || substr(d, 7, 4) END AS phone FROM (SELECT pid, d, CASE pid % 3 WHEN 0 THEN 'ext. ' || d || '00' WHEN 1 THEN '+1 ' || d ELSE substr(d, 1, 3) || '.' || substr(d, 4) END AS t FROM (SELECT pid, (2081000000 + pid*7919)::VARCHAR AS d FROM fx_points))")
def fn_format_fe(spark, sf_dir):
    d = (F.lit(2081000000) + C("pid") * 7919).cast("string")
    t = F.when(C("pid") % 3 == 0, F.concat(F.lit("ext. "), d, F.lit("00"))).when(C("pid") % 3 == 1, F.concat(F.lit("+1 "), d)).otherwise(F.concat(F.substr(d, F.lit(1), F.lit(3)), F.lit("."), F.substr(d, F.lit(4))))
    return view(spark, sf_dir, "fx_points").select("pid", text.format_phone(t).alias("phone"))


@query("fn_leading_int", "SELECT pid, TRY_CAST(regexp_extract(t, '^\\s*(\\d+)', 1) AS INT) AS capacity FROM (SELECT pid, CASE pid % 4 WHEN 0 THEN (pid % 300)::VARCHAR || ' spaces' WHEN 1 THEN 'about 20' WHEN 2 THEN (pid % 50)::VARCHAR END AS t FROM fx_points)")
def fn_leading_int(spark, sf_dir):
    t = F.when(C("pid") % 4 == 0, F.concat((C("pid") % 300).cast("string"), F.lit(" spaces"))).when(C("pid") % 4 == 1, "about 20").when(C("pid") % 4 == 2, (C("pid") % 50).cast("string"))
    return view(spark, sf_dir, "fx_points").select("pid", text.leading_int(t).alias("capacity"))


@query(
    "fn_decode_code",
    """SELECT unit_id, coalesce(MAP {'NPS': 'National Park Service', 'BLM': 'Bureau of Land Management'}[mang_name], mang_name, '') AS agency, coalesce(MAP {'OA': 'Open Access', 'RA': 'Restricted Access', 'XA': 'Closed', 'UK': 'Unknown'}[pub_access], pub_access, '') AS access,
    CASE trim(des_tp) WHEN 'WSA' THEN 'Wilderness Study Area' WHEN 'NLS' THEN 'National Lakeshore or Seashore' WHEN 'FOTH' THEN 'Federal Other or Unknown' ELSE coalesce(des_tp, '') END AS designation,
    CASE gap_sts WHEN '1' THEN 'Managed for biodiversity (disturbance events proceed)' WHEN '2' THEN 'Managed for biodiversity (disturbance suppressed)' WHEN '3' THEN 'Multiple uses (extractive/OHV)' WHEN '4' THEN 'No known mandate for biodiversity protection' ELSE gap_sts END AS gap,
    CASE category WHEN 'Marine' THEN 'Marine Area' WHEN 'Proclamation' THEN 'Approved, Proclamation or Extent Boundary' ELSE category END AS category, CASE state_nm WHEN 'NM' THEN 'New Mexico' WHEN 'DC' THEN 'District of Columbia' ELSE coalesce(state_nm, '') END AS state FROM fx_units""",
)
def fn_decode_code(spark, sf_dir):
    from ..functions import codes

    tables = {"agency": ("mang_name", codes.AGENCIES), "access": ("pub_access", codes.ACCESS), "designation": ("des_tp", codes.DESIGNATIONS), "gap": ("gap_sts", codes.GAP_STATUS), "category": ("category", codes.UNIT_CATEGORIES), "state": ("state_nm", codes.state_names())}
    return view(spark, sf_dir, "fx_units").select("unit_id", *[text.decode_code(C(c), names).alias(k) for k, (c, names) in tables.items()])


@query("fn_humanize_features", "SELECT fid, CASE osm_value WHEN 'cafe' THEN 'Coffee shop' WHEN 'supermarket' THEN 'Supermarket' WHEN 'residential' THEN 'Highway: Residential' WHEN 'house' THEN 'Place: House' ELSE 'Hamlet' END AS label FROM fx_features")
def fn_humanize_features(spark, sf_dir):
    from ..functions.codes import CATEGORIES, CLASS_LABELS

    return view(spark, sf_dir, "fx_features").select("fid", text.humanize(C("osm_key"), C("osm_value"), CATEGORIES, CLASS_LABELS).alias("label"))


CATEGORY = "SELECT pid, CASE pid % 6 WHEN 0 THEN 'amenity' WHEN 1 THEN 'shop' WHEN 2 THEN 'Amenity' WHEN 3 THEN 'man_made' WHEN 4 THEN 'amenity' END AS cls, CASE pid % 6 WHEN 0 THEN 'cafe' WHEN 1 THEN 'bicycle_repair' WHEN 2 THEN 'Pub' WHEN 3 THEN 'water_tower' WHEN 4 THEN 'fuel' ELSE 'x' END AS kind FROM fx_points"


@query("fn_humanize_category", f"SELECT pid, CASE pid % 6 WHEN 0 THEN 'Coffee shop' WHEN 1 THEN 'Shop: Bicycle Repair' WHEN 2 THEN 'Pub' WHEN 3 THEN 'Man Made: Water Tower' WHEN 4 THEN 'Gas station' ELSE 'Place' END AS label FROM ({CATEGORY})")
def fn_humanize_category(spark, sf_dir):
    from ..functions.codes import CATEGORIES, CLASS_LABELS

    m = C("pid") % 6
    cls = F.when(m == 0, "amenity").when(m == 1, "shop").when(m == 2, "Amenity").when(m == 3, "man_made").when(m == 4, "amenity")
    kind = F.when(m == 0, "cafe").when(m == 1, "bicycle_repair").when(m == 2, "Pub").when(m == 3, "water_tower").when(m == 4, "fuel").otherwise("x")
    return view(spark, sf_dir, "fx_points").select("pid", text.humanize(cls, kind, CATEGORIES, CLASS_LABELS).alias("label"))


@query("fn_build_address", "SELECT qid, array_to_string(list_filter([number || ' ' || street, city, CASE WHEN state IS NOT NULL AND zipcode IS NOT NULL THEN state || ' ' || zipcode ELSE coalesce(state, zipcode) END], lambda x: x IS NOT NULL AND x <> ''), ', ') AS address FROM fx_queries")
def fn_build_address(spark, sf_dir):
    return view(spark, sf_dir, "fx_queries").select("qid", text.build_address(C("number"), C("street"), C("city"), C("state"), C("zipcode")).alias("address"))


@query("fn_label_maps_fe", "SELECT pid, CASE pid % 4 WHEN 0 THEN 'Wheelchair accessible' WHEN 1 THEN 'Limited wheelchair access' WHEN 2 THEN 'Not wheelchair accessible' END AS wheelchair, 'Some place ' || (pid % 10)::VARCHAR AS wiki FROM fx_points")
def fn_label_maps_fe(spark, sf_dir):
    value = F.when(C("pid") % 4 == 0, "yes").when(C("pid") % 4 == 1, "limited").when(C("pid") % 4 == 2, "no").otherwise("designated")
    tag = F.concat(F.lit("en:Some_place_"), (C("pid") % 10).cast("string"))
    known = text.literal_map({"yes": "Wheelchair accessible", "limited": "Limited wheelchair access", "no": "Not wheelchair accessible"})
    return view(spark, sf_dir, "fx_points").select("pid", F.try_element_at(known, value).alias("wheelchair"), F.replace(F.substring_index(tag, ":", -1), F.lit("_"), F.lit(" ")).alias("wiki"))


@query("fn_json_cast", "SELECT event_id, TRY_CAST(json_extract_string(TRY_CAST(props AS JSON), '$.k') AS VARCHAR) AS k, TRY_CAST(props AS JSON) IS NOT NULL AS valid FROM events")
def fn_json_cast(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.try_parse_json("props").isNotNull().alias("valid"))


@query("fn_utc_iso", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events")
def fn_utc_iso(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"))


@query("fn_git_dem_hash", "SELECT p_brand, sha256(string_agg(DISTINCT p_type, '|' ORDER BY p_type)) AS hash FROM part GROUP BY p_brand")
def fn_git_dem_hash(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.sha2(F.array_join(F.array_sort(F.collect_set("p_type")), "|"), 256).alias("hash"))


@query("fn_polyline")
def fn_polyline(spark, sf_dir):
    """Encode every route as polyline6 and decode it again; ``same`` says whether it came back."""
    from ..functions.polyline import decode_polyline, encode_polyline

    points = view(spark, sf_dir, "fx_path").groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("i", "lat", "lon"))).alias("p"))
    coded = points.select("route_id", F.transform("p", lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon"))).alias("line")).withColumn("encoded", encode_polyline("line"))
    back = decode_polyline("encoded")
    same = F.forall(F.arrays_zip(C("line").alias("a"), back.alias("b")), lambda z: (F.abs(z["a"]["lat"] - z["b"]["lat"]) < 1e-6) & (F.abs(z["a"]["lon"] - z["b"]["lon"]) < 1e-6))
    return coded.select("route_id", "encoded", same.alias("same"))
