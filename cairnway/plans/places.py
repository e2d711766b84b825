"""Queries of place enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import enrichment, hours, upsert
from .fixtures import view
from .registry import query

C = F.col


def parts(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet")


@query("join_xref_eq", "SELECT c.c_custkey, p.p_name AS name FROM customer c LEFT JOIN part p ON p.p_partkey = c.c_custkey * 2")
def join_xref_eq(spark, sf_dir):
    places = parts(spark, sf_dir).select(C("p_partkey").alias("osm_id"), C("p_name").alias("name"))
    asked = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", (C("c_custkey") * 2).alias("osm_id"))
    return asked.join(places, "osm_id", "left").select("c_custkey", "name")


GAPS = "SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END AS phone, CASE WHEN p_size % 3 = 0 THEN p_type END AS website FROM part"


@query("merge_gap_fill", f"SELECT b.id, CASE WHEN b.phone = '' THEN d.phone ELSE b.phone END AS phone, coalesce(b.website, d.website) AS website, list_filter([CASE WHEN b.phone = '' AND d.phone IS NOT NULL THEN 'phone:donor' END, CASE WHEN b.website IS NULL AND d.website IS NOT NULL THEN 'website:donor' END], lambda x: x IS NOT NULL) AS filled FROM ({GAPS}) b LEFT JOIN (SELECT p_partkey AS id, p_type AS phone, p_name AS website FROM part WHERE p_partkey % 3 = 0) d USING (id)")
def merge_gap_fill(spark, sf_dir):
    rows = parts(spark, sf_dir)
    base = rows.select(C("p_partkey").alias("id"), F.when(C("p_size") % 2 == 0, C("p_brand")).otherwise("").alias("phone"), F.when(C("p_size") % 3 == 0, C("p_type")).alias("website"))
    donor = rows.where("p_partkey % 3 = 0").select(C("p_partkey").alias("id"), C("p_type").alias("phone"), C("p_name").alias("website"))
    return upsert.gap_fill(base, donor, ["id"], ["phone", "website"], "donor")


@query(
    "enrich_paid_gate",
    """WITH r AS (SELECT rid, day, user_id, d.* FROM fx_requests JOIN fx_details d USING (fid)),
    b AS (SELECT *, CASE WHEN class IS NULL OR class NOT IN ('amenity', 'shop', 'tourism', 'leisure', 'office', 'craft') THEN 'not_business' WHEN phone <> '' AND website IS NOT NULL THEN 'complete' WHEN place_id IS NOT NULL AND data IS NOT NULL THEN 'cache_hit'
      WHEN place_id IS NOT NULL THEN 'known_miss' WHEN user_id IS NULL THEN 'guest' WHEN name IS NULL THEN 'unnamed' END AS before FROM r)
    SELECT rid, coalesce(before, CASE WHEN row_number() OVER (PARTITION BY day, before ORDER BY rid) <= 25 THEN 'lookup' ELSE 'capped' END) AS decision, array_to_string(list_filter([CASE WHEN phone = '' THEN 'phone' END, CASE WHEN website IS NULL THEN 'website' END], lambda x: x IS NOT NULL), ',') AS gaps FROM b""",
)
def enrich_paid_gate(spark, sf_dir):
    """Every request of a place's details: from the cache, looked up, or why not."""
    requests = view(spark, sf_dir, "fx_requests").join(view(spark, sf_dir, "fx_details"), "fid")
    return enrichment.paid_gate(requests, ("phone", "website"), 25).select("rid", "decision", F.array_join("gaps", ",").alias("gaps"))


@query("fn_opening_hours")
def fn_opening_hours(spark, sf_dir):
    """Periods by day to an opening-hours text."""
    day = lambda d: F.struct(F.lit(d).alias("day"), F.concat(F.lit("0"), (8 + C("pid") % 2).cast("string"), F.lit(":00")).alias("open"), F.when((C("pid") % 3 == 0) & F.lit(d in (0, 6)), "00:00").otherwise("17:30").alias("close"))
    periods = F.explode(F.filter(F.array(*[day(d) for d in range(7)]), lambda p: ~((C("pid") % 5 == 0) & (p["day"] == 2))))
    return hours.opening_hours(view(spark, sf_dir, "fx_points").select("pid", periods.alias("p")).select("pid", "p.day", "p.open", "p.close"), "pid")


@query("fn_hours_eval_fe")
def fn_hours_eval_fe(spark, sf_dir):
    text = fn_opening_hours(spark, sf_dir)
    return text.select("pid", hours.is_open(C("hours"), "Mo", "12:00").alias("open_at_noon"), hours.is_open(C("hours"), "Su", "23:00").alias("open_late"))


ADDRESS = "SELECT c_custkey AS id, n_name AS country, r_name AS region, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS city FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


@query("fn_nominatim_addr", f"SELECT id, coalesce(city, region) AS locality, country FROM ({ADDRESS})")
def fn_nominatim_addr(spark, sf_dir):
    c, n, r = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "nation", "region"))
    rows = c.join(n, C("c_nationkey") == C("n_nationkey")).join(r, C("n_regionkey") == C("r_regionkey"))
    part = lambda kind, v: F.struct(F.lit(kind).alias("type"), v.alias("localname"))
    address = F.filter(F.array(F.when(C("c_custkey") % 2 == 0, part("city", C("c_mktsegment"))), part("town", C("r_name")), part("country", C("n_name"))), lambda p: p.isNotNull())
    first = lambda *kinds: F.get(F.filter(address, lambda p: p["type"].isin(*kinds)), 0)["localname"]
    return rows.select(C("c_custkey").alias("id"), first("city", "town").alias("locality"), first("country").alias("country"))


@query("fn_nominatim_doc", "SELECT p_partkey AS id, coalesce(CASE WHEN p_size % 2 = 0 THEN p_brand END, p_type) AS phone, p_size % 3 = 0 AS has_boundary FROM part")
def fn_nominatim_doc(spark, sf_dir):
    tags = F.map_from_entries(F.filter(F.array(F.when(C("p_size") % 2 == 0, F.struct(F.lit("phone").alias("k"), C("p_brand").alias("v"))), F.struct(F.lit("contact:phone").alias("k"), C("p_type").alias("v"))), lambda e: e.isNotNull()))
    doc = F.to_json(F.struct(tags.alias("extratags"), F.struct(F.when(C("p_size") % 3 == 0, "Polygon").otherwise("Point").alias("type")).alias("geometry")))
    parsed = F.from_json(doc, "extratags map<string,string>, geometry struct<type:string>")
    tag = lambda k: F.try_element_at(parsed["extratags"], F.lit(k))
    return parts(spark, sf_dir).select(C("p_partkey").alias("id"), F.coalesce(tag("phone"), tag("contact:phone")).alias("phone"), parsed["geometry"]["type"].isin("Polygon", "MultiPolygon").alias("has_boundary"))


@query("fn_overpass_doc", "SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 'amenity' WHEN 1 THEN 'shop' ELSE 'highway' END AS class, p_brand AS street FROM part")
def fn_overpass_doc(spark, sf_dir):
    #: The keys that name a class, in order.
    keys = ("amenity", "shop", "tourism", "leisure", "office", "natural", "highway")
    entry = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    kind = F.when(C("p_size") % 3 == 0, F.array(entry("highway", F.lit("x")), entry("amenity", F.lit("y")))).when(C("p_size") % 3 == 1, F.array(entry("shop", F.lit("z")))).otherwise(F.array(entry("highway", F.lit("w"))))
    tags = F.map_from_entries(F.concat(kind, F.array(entry("addr:street", C("p_brand")))))
    cls = F.get(F.filter(F.array(*[F.lit(k) for k in keys]), lambda k: F.map_contains_key(tags, k)), 0)
    return parts(spark, sf_dir).select(C("p_partkey").alias("id"), cls.alias("class"), F.try_element_at(tags, F.lit("addr:street")).alias("street"))


@query("fn_overpass_query", "SELECT pid, '[out:json];' || CASE pid % 3 WHEN 0 THEN 'node' WHEN 1 THEN 'way' ELSE 'relation' END || '(' || pid::VARCHAR || ');out tags center;' AS q FROM fx_points")
def fn_overpass_query(spark, sf_dir):
    kind = F.when(C("pid") % 3 == 0, "node").when(C("pid") % 3 == 1, "way").otherwise("relation")
    return view(spark, sf_dir, "fx_points").select("pid", F.format_string("[out:json];%s(%d);out tags center;", kind, C("pid")).alias("q"))
