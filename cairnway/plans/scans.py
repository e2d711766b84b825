"""Queries of readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import readers
from .fixtures import view
from .geocode import FOUND, retrieved
from .registry import query

C = F.col


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("scan_parquet_nested", "SELECT p_partkey AS id, p_name AS name, p_retailprice AS price FROM part WHERE p_retailprice BETWEEN 900 AND 1500 AND p_size BETWEEN 5 AND 30")
def scan_parquet_nested(spark, sf_dir):
    return readers.nested_parquet(spark, f"{sf_dir}/part.parquet", {"id": "p_partkey", "name": "p_name", "price": "p_retailprice"}, (900, 1500, 5, 30), ("p_retailprice", "p_size"))


def blobs(spark, sf_dir):
    """Lines of fx_mvum as binary geometries; every eleventh is cut off, every thirteenth missing."""
    from ..sources import wkb

    end = lambda k: F.struct(C(f"lon{k}").alias("lon"), C(f"lat{k}").alias("lat"))
    rows = view(spark, sf_dir, "fx_mvum").withColumn("whole", wkb.blob("LineString", F.array(F.array(end(1), end(2)))))
    k = C("ogc_fid")
    return rows.select("ogc_fid", "atv", F.when(k % 13 == 1, None).when(k % 11 == 1, F.substring("whole", 1, 30)).otherwise(C("whole")).alias("shape"))


@query(
    "scan_sqlite_table",
    """SELECT count(*) FILTER (ok)::BIGINT AS kept, count(*) FILTER (NOT ok AND ogc_fid % 13 <> 1)::BIGINT AS unreadable, count(*) FILTER (ogc_fid % 13 = 1)::BIGINT AS missing, min(least(lat1, lat2)) FILTER (ok) AS ymin, max(greatest(lat1, lat2)) FILTER (ok) AS ymax,
    min(least(lon1, lon2)) FILTER (ok) AS xmin, max(greatest(lon1, lon2)) FILTER (ok) AS xmax FROM (SELECT *, ogc_fid % 13 <> 1 AND ogc_fid % 11 <> 1 AS ok FROM fx_mvum)""",
)
def scan_sqlite_table(spark, sf_dir):
    """Rows of a feature table whose geometries are blobs: parsed, counted where they are bad, and their extent."""
    from ..sources import wkb

    rows = wkb.with_geometry(blobs(spark, sf_dir), "shape")
    fine, end = C("problem").isNull(), lambda f, c: f(F.when(C("problem").isNull(), C(c))).alias(c)
    return rows.agg(F.count_if(fine).alias("kept"), F.count_if(C("problem") == "unreadable").alias("unreadable"), F.count_if(C("problem") == "missing").alias("missing"), end(F.min, "ymin"), end(F.max, "ymax"), end(F.min, "xmin"), end(F.max, "xmax"))


@query("scan_geojsonseq", "SELECT id % 4 <> 0 AS ok, count(*)::BIGINT AS records FROM fx_parking GROUP BY 1")
def scan_geojsonseq(spark, sf_dir):
    record = F.to_json(F.struct(F.lit("Feature").alias("type"), F.create_map(F.lit("id"), C("id").cast("string")).alias("properties"), F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry")))
    lines = view(spark, sf_dir, "fx_parking").select(F.when(C("id") % 4 == 0, F.concat(F.lit("\x1e{broken"), C("id").cast("string"))).otherwise(F.concat(F.lit("\x1e"), record)).alias("value"))
    return readers.geojson_lines(lines).groupBy("ok").agg(F.count("*").alias("records"))


@query("scan_geojson_fc", "SELECT user_id, count(*) FILTER (id % 3 = 0)::BIGINT AS lines FROM fx_contacts GROUP BY user_id HAVING count(*) FILTER (id % 3 = 0) > 0")
def scan_geojson_fc(spark, sf_dir):
    feature = F.struct(F.lit("Feature").alias("type"), F.create_map(F.lit("id"), C("id").cast("string")).alias("properties"), F.struct(F.when(C("id") % 3 == 0, "LineString").otherwise("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"))
    docs = view(spark, sf_dir, "fx_contacts").groupBy("user_id").agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(feature).alias("features"))).alias("doc"))
    return readers.feature_collection(docs, "doc").groupBy("user_id").agg(F.count("*").alias("lines"))


@query("src_wikidata", "SELECT n_nationkey, 'Q' || n_nationkey::VARCHAR AS entity, n_name AS label, CASE WHEN n_nationkey % 3 <> 0 THEN n_nationkey*1000 END::BIGINT AS population FROM nation")
def src_wikidata(spark, sf_dir):
    k = C("n_nationkey")
    value = lambda v: F.struct(F.struct(F.struct(v.alias("value")).alias("datavalue")).alias("mainsnak"))
    population = F.array(value(F.lit("unknown")), value(F.when(k % 3 != 0, F.concat(F.lit("+"), (k * 1000).cast("string"))).otherwise("n/a")))
    doc = F.to_json(F.struct(F.concat(F.lit("Q"), k.cast("string")).alias("id"), F.create_map(F.lit("en"), F.struct(C("n_name").alias("value"))).alias("labels"), F.create_map(F.lit("P1082"), population).alias("claims")))
    return readers.entity_fields(table(spark, sf_dir, "nation").select("n_nationkey", doc.alias("doc")), "doc").select("n_nationkey", "entity", "label", "population")


@query(
    "scan_opds_catalog",
    """SELECT n_regionkey, n || '_all' AS name, CASE WHEN starts_with(n, 'nation_1') THEN 'one' WHEN starts_with(n, 'nation') THEN 'any' END AS source, n || '_2024' AS path
    FROM (SELECT n_regionkey, n_name, lower(replace(n_name, ' ', '_')) AS n FROM nation) WHERE NOT regexp_matches(n_name, '[37]$') AND starts_with(n, 'nation')""",
)
def scan_opds_catalog(spark, sf_dir):
    entries = F.concat_ws("", F.transform(F.collect_list("n_name"), lambda n: F.concat(F.lit("<entry><name>"), F.lower(F.replace(n, F.lit(" "), F.lit("_"))), F.lit("_all</name>"), F.when(~F.rlike(n, F.lit("[37]$")), F.concat(F.lit('<link type="image/png" href="/content/x"/><link type="text/html" href="/content/'), F.lower(F.replace(n, F.lit(" "), F.lit("_"))), F.lit('_2024"/>'))).otherwise(F.lit("")), F.lit("</entry>"))))
    docs = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.concat(F.lit("<feed>"), entries, F.lit("</feed>")).alias("doc"))
    return readers.catalog_entries(docs, "doc", [("nation_1", "one"), ("nation", "any")]).select("n_regionkey", "name", "source", "path")


@query(
    "scan_manifest",
    """SELECT r_regionkey, problem, ord::INTEGER AS ord, name, path, min_x, max_x FROM (
      SELECT n_regionkey AS r_regionkey, NULL AS problem, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS ord, n_name AS name, CASE WHEN n_nationkey % 3 = 0 THEN '/maps/' ELSE 'at/' || n_regionkey || '/' END || n_nationkey || '.parquet' AS path,
        CASE WHEN n_nationkey % 4 > 0 THEN -8659 + n_nationkey END::BIGINT AS min_x, CASE WHEN n_nationkey % 4 > 0 THEN -8620 + n_nationkey END::BIGINT AS max_x FROM nation WHERE n_regionkey NOT IN (2, 3, 4)
      UNION ALL SELECT 2, NULL, 0, 'legacy', 'at/2/old.parquet', NULL, NULL FROM region WHERE r_regionkey = 2 UNION ALL SELECT 3, 'unknown version', NULL, NULL, NULL, NULL, NULL FROM region WHERE r_regionkey = 3
      UNION ALL SELECT 4, 'no manifest', NULL, NULL, NULL, NULL, NULL FROM region WHERE r_regionkey = 4)""",
)
def scan_manifest(spark, sf_dir):
    """A manifest of each region: its nations' tables, one of the legacy kind, one of a later version and one broken."""
    n = C("n_nationkey")
    bounds = F.when(n % 4 > 0, F.struct((n - 8659).alias("min_x"), (n - 8620).alias("max_x")))
    path = F.concat(F.when(n % 3 == 0, "/maps/").otherwise(""), n.cast("string"), F.lit(".parquet"))
    listed = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", C("n_name").alias("name"), path.alias("path"), bounds.alias("chunk_bounds")))).alias("tile_dbs"))
    key = C("n_regionkey")
    text = F.when(key == 2, '{"path": "old.parquet"}').when(key == 3, '{"version": 2, "tile_dbs": []}').when(key == 4, "{broken").otherwise(F.to_json(F.struct(F.lit(1).alias("version"), "tile_dbs")))
    documents = listed.select(key.alias("r_regionkey"), F.concat(F.lit("at/"), key.cast("string")).alias("folder"), text.alias("text"))
    return readers.manifest(documents, "text").select("r_regionkey", "problem", "ord", "name", "path", "min_x", "max_x")


@query("src_nominatim_overpass", "SELECT id, CASE WHEN category = 'BUILDING' THEN 'primary' WHEN category IN ('MACHINERY', 'FURNITURE') AND phone <> '' THEN 'fallback' END AS source FROM fx_contacts")
def src_nominatim_overpass(spark, sf_dir):
    """Details from the first source that has an answer for a place; both are input tables."""
    places = view(spark, sf_dir, "fx_contacts").select("id", "category", "phone")
    first = places.where("category = 'BUILDING'").select("id", F.lit("primary").alias("one"))
    second = places.where("category in ('BUILDING', 'MACHINERY', 'FURNITURE') and phone <> ''").select("id", F.lit("fallback").alias("two"))
    return places.select("id").join(first, "id", "left").join(second, "id", "left").select("id", F.coalesce("one", "two").alias("source"))


@query("src_photon", f"WITH {FOUND} SELECT qid, id, source_order, name, type, rank::INTEGER AS rank FROM found WHERE source = 'features'")
def src_photon(spark, sf_dir):
    """Free-text retrieval with location bias, and structured retrieval, as features with their display names and types."""
    return retrieved(spark, sf_dir).where("source = 'features'").select("qid", "id", "source_order", "name", "type", "rank")


@query("fn_spatialite_wkb", "SELECT pid, '01' || lpad(hex(pid % 65536), 8, '0') AS wkb FROM fx_points")
def fn_spatialite_wkb(spark, sf_dir):
    """Cut the geometry out of a framed blob: its header and end marker go."""
    body = F.unhex(F.concat(F.lit("01"), F.lpad(F.hex(C("pid") % 65536), 8, "0")))
    blob = F.concat(F.unhex(F.lit("0001" + "00" * 36 + "7C")), body, F.unhex(F.lit("FE")))
    cut = F.substring(blob, 40, 5)
    return view(spark, sf_dir, "fx_points").select("pid", F.hex(cut).alias("wkb"))


@query("fn_osm_xref", "SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN ['n','w','r'][1 + p_size % 3] END AS osm_type, CASE WHEN p_size % 3 <> 0 THEN p_partkey * 10 END::BIGINT AS osm_id FROM part")
def fn_osm_xref(spark, sf_dir):
    kind = F.element_at(F.array(F.lit("n"), F.lit("w"), F.lit("r")), C("p_size") % 3 + 1)
    ref = F.concat(kind, (C("p_partkey") * 10).cast("string"), F.lit("@3"))
    sources = F.array(F.struct(F.lit("meta").alias("dataset"), F.lit("x").alias("record_id")), F.struct(F.lit("osm").alias("dataset"), F.when(C("p_size") % 3 != 0, ref).otherwise("none").alias("record_id")))
    hit = F.get(F.filter(sources, lambda s: F.rlike(s["record_id"], F.lit(r"^[nwr]\d+@\d+$"))), 0)["record_id"]
    return table(spark, sf_dir, "part").select("p_partkey", F.nullif(F.regexp_extract(hit, r"^([nwr])", 1), F.lit("")).alias("osm_type"), F.regexp_extract(hit, r"^[nwr](\d+)@", 1).try_cast("long").alias("osm_id"))


@query("fn_first_array", "SELECT p_partkey, CASE WHEN p_size % 4 > 0 THEN p_brand END AS phone, CASE WHEN p_size % 3 = 0 THEN '[\"' || p_type || '\"]' END AS socials FROM part")
def fn_first_array(spark, sf_dir):
    phones = F.when(C("p_size") % 4 > 0, F.array("p_brand", F.lit("other"))).otherwise(F.array().cast("array<string>"))
    socials = F.filter(F.array(F.lit(""), F.when(C("p_size") % 3 == 0, C("p_type"))), lambda s: F.coalesce(s, F.lit("")) != "")
    return table(spark, sf_dir, "part").select("p_partkey", F.get(phones, 0).alias("phone"), F.when(F.size(socials) > 0, F.to_json(socials)).alias("socials"))


@query("scan_dem_tiles", "SELECT r, c, floor((elev_m + 32768.0e0)*256.0e0)/256.0e0 - 32768.0e0 AS elevation FROM fx_cells WHERE elev_m IS NOT NULL")
def scan_dem_tiles(spark, sf_dir):
    """Terrarium pixels of a tile table decoded to elevations; a missing pixel is no data."""
    from ..functions.geo import terrarium

    steps = F.floor((C("elev_m") + 32768.0) * 256.0)
    pixels = view(spark, sf_dir, "fx_cells").where("elev_m is not null").select("r", "c", F.floor(steps / 65536).alias("red"), (F.floor(steps / 256) % 256).alias("green"), (steps % 256).alias("blue"))
    return pixels.select("r", "c", terrarium(C("red"), C("green"), C("blue")).alias("elevation"))


@query("src_valhalla", "SELECT route_id, count(*)::BIGINT AS edges, round(sum(length_m), 3) AS metres FROM fx_trace_edges GROUP BY route_id")
def src_valhalla(spark, sf_dir):
    """Traced edges of a router are an input table (route, edge): nothing is fetched from executors."""
    return view(spark, sf_dir, "fx_trace_edges").groupBy("route_id").agg(F.count("*").alias("edges"), F.round(F.sum("length_m"), 3).alias("metres"))


@query("src_google", "SELECT day, calls, CASE WHEN limited > 0 THEN greatest(calls, 50) ELSE calls END AS counted FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*)::BIGINT AS calls, count(*) FILTER (event_id % 997 = 0) AS limited FROM events GROUP BY 1)")
def src_google(spark, sf_dir):
    """Logged calls of a paid lookup: a refused call puts the day's counter at its cap."""
    days = table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("calls"), F.count_if(C("event_id") % 997 == 0).alias("limited"))
    return days.select("day", "calls", F.when(C("limited") > 0, F.greatest("calls", F.lit(50).cast("long"))).otherwise(C("calls")).alias("counted"))


@query(
    "scan_yaml_book",
    """SELECT c_nationkey AS book, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1)::INTEGER AS entry, CASE WHEN c_custkey % 10 <> 3 THEN c_name END AS name, CASE WHEN c_custkey % 10 = 3 THEN NULL WHEN c_custkey % 4 = 0 THEN lower(c_mktsegment) ELSE '' END AS aliases,
    CASE WHEN c_custkey % 10 <> 3 AND c_custkey % 3 > 0 THEN c_custkey / 100.0e0 END AS lat, CASE WHEN c_custkey % 10 = 3 THEN 'no name' END AS problem FROM customer WHERE c_nationkey <> 7
    UNION ALL SELECT DISTINCT c_nationkey, 0, NULL, NULL, NULL::DOUBLE, 'no book' FROM customer WHERE c_nationkey = 7""",
)
def scan_yaml_book(spark, sf_dir):
    """A book of each nation's customers as a YAML text; one text is broken, some entries have no name."""
    k = C("c_custkey")
    line = F.concat(
        F.lit("- {id: "), k.cast("string"), F.when(k % 10 != 3, F.concat(F.lit(', name: "'), C("c_name"), F.lit('"'))).otherwise(""), F.when(k % 4 == 0, F.concat(F.lit(", aliases: ["), C("c_mktsegment"), F.lit("]"))).otherwise(""),
        F.when(k % 3 > 0, F.concat(F.lit(", lat: "), F.format_string("%.2f", k / F.lit(100.0)))).otherwise(""), F.lit("}"),
    )
    lines = F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), line.alias("line")))), lambda e: e["line"])
    books = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(lines.alias("lines")).select(C("c_nationkey").alias("book"), F.when(C("c_nationkey") == 7, "entries: [{").otherwise(F.concat(F.lit("entries:\n"), F.array_join("lines", "\n"))).alias("text"))
    return readers.yaml_books(books, "text").select("book", "entry", "name", F.array_join("aliases", ",").alias("aliases"), "lat", "problem")

