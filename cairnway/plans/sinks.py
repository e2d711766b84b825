"""Queries of upserts and writes: what a table holds afterwards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import upsert
from .fixtures import view
from .registry import query

C = F.col
CACHE = "SELECT pid AS id, 'doc' || pid::VARCHAR AS data, 'old' AS source, pid AS cached_at, CASE WHEN pid % 5 = 0 THEN 'g' || pid::VARCHAR END AS google_id FROM fx_points WHERE pid % 3 <> 0"
DELTA = "SELECT pid AS id, 'new' || pid::VARCHAR AS data, 'fresh' AS source, 1000000 + pid AS cached_at FROM fx_points WHERE pid % 4 = 0"


def cache(spark, sf_dir):
    p = C("pid")
    return view(spark, sf_dir, "fx_points").where("pid % 3 <> 0").select(p.alias("id"), F.concat(F.lit("doc"), p.cast("string")).alias("data"), F.lit("old").alias("source"), p.alias("cached_at"), F.when(p % 5 == 0, F.concat(F.lit("g"), p.cast("string"))).alias("google_id"))


@query("upsert_places", "SELECT k AS id, arg_max(nm, seq) AS name FROM (SELECT p_partkey % 700 AS k, p_name AS nm, p_partkey AS seq FROM part) GROUP BY k")
def upsert_places(spark, sf_dir):
    loads = spark.read.parquet(f"{sf_dir}/part.parquet").select((C("p_partkey") % 700).alias("id"), C("p_name").alias("name"), C("p_partkey").alias("load_seq"))
    return upsert.latest(loads, ["id"], "load_seq").select("id", "name")


@query("upsert_cache", f"SELECT coalesce(b.id, d.id) AS id, coalesce(d.data, b.data) AS data, coalesce(d.source, b.source) AS source, coalesce(d.cached_at, b.cached_at) AS cached_at, google_id FROM ({CACHE}) b FULL JOIN ({DELTA}) d ON b.id = d.id")
def upsert_cache(spark, sf_dir):
    p = C("pid")
    delta = view(spark, sf_dir, "fx_points").where("pid % 4 = 0").select(p.alias("id"), F.concat(F.lit("new"), p.cast("string")).alias("data"), F.lit("fresh").alias("source"), (1000000 + p).alias("cached_at"))
    return upsert.upsert(cache(spark, sf_dir), delta, ["id"], ["data", "source", "cached_at"])


@query("upsert_google", f"SELECT coalesce(b.id, d.id) AS id, coalesce(b.source, 'placeholder') AS source, coalesce(d.g, b.google_id) AS google_id FROM ({CACHE}) b FULL JOIN (SELECT pid AS id, 'G' || pid::VARCHAR AS g FROM fx_points WHERE pid % 7 = 0) d ON b.id = d.id")
def upsert_google(spark, sf_dir):
    p = C("pid")
    delta = view(spark, sf_dir, "fx_points").where("pid % 7 = 0").select(p.alias("id"), F.concat(F.lit("G"), p.cast("string")).alias("google_id"))
    return upsert.upsert(cache(spark, sf_dir), delta, ["id"], ["google_id"]).select("id", F.coalesce("source", F.lit("placeholder")).alias("source"), "google_id")


@query("upsert_counter", "SELECT CAST(ts AS DATE)::VARCHAR AS call_date, least(count(*), 40)::BIGINT AS call_count, count(*) >= 40 AS capped FROM events GROUP BY 1")
def upsert_counter(spark, sf_dir):
    days = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("call_date")).agg(F.count("*").alias("n"))
    return days.select("call_date", F.least("n", F.lit(40).cast("long")).alias("call_count"), (C("n") >= 40).alias("capped"))


@query("write_wkb_backfill", "SELECT m.ogc_fid, CASE WHEN m.ogc_fid % 13 <> 1 AND m.ogc_fid % 11 <> 1 THEN 'LineString' WHEN d.id IS NOT NULL THEN 'Point' END AS kind, CASE WHEN m.ogc_fid % 13 <> 1 AND m.ogc_fid % 11 <> 1 THEN lat1 ELSE d.lat END AS lat, CASE WHEN m.ogc_fid % 13 <> 1 AND m.ogc_fid % 11 <> 1 THEN lon1 ELSE d.lon END AS lon FROM fx_mvum m LEFT JOIN (SELECT * FROM fx_parking WHERE access IS NOT NULL) d ON d.id = m.ogc_fid")
def write_wkb_backfill(spark, sf_dir):
    """Geometries that are missing or unreadable are taken from a donor of the same id, as blobs; the table is written and read again."""
    from ..sources import wkb
    from ..sources.writers import rewritten
    from .scans import blobs

    point = wkb.blob("Point", F.array(F.array(F.struct("lon", "lat"))))
    donor = view(spark, sf_dir, "fx_parking").where("access is not null").select(C("id").alias("ogc_fid"), point.alias("donated"))
    own = wkb.with_geometry(blobs(spark, sf_dir), "shape").select("ogc_fid", F.when(C("problem").isNull(), C("shape")).alias("shape"))
    filled = rewritten(own.join(donor, "ogc_fid", "left").select("ogc_fid", F.coalesce("shape", "donated").alias("shape")), "shapes")
    first = F.get(F.flatten("parts"), F.lit(0))
    return wkb.with_geometry(filled, "shape").select("ogc_fid", "kind", first["lat"].alias("lat"), first["lon"].alias("lon"))


@query("create_parking", "SELECT id, access, round(lat, 4) AS lat, round(lon, 4) AS lon FROM fx_parking WHERE access IS NULL OR access <> 'no'")
def create_parking(spark, sf_dir):
    from ..sources.writers import rewritten

    rows = view(spark, sf_dir, "fx_parking").where("access is null or access <> 'no'").select("id", "access", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"))
    return rewritten(rows, "parking")


@query("truncate_load_points", "SELECT e.id, e.highway_class, EXISTS (SELECT 1 FROM fx_units u WHERE lon >= xmin AND lon <= xmax AND lat >= ymin AND lat <= ymax AND pub_access = 'XA') AS closed FROM fx_entry_points e")
def truncate_load_points(spark, sf_dir):
    from ..operators.spatial import in_rectangles

    points = view(spark, sf_dir, "fx_entry_points")
    hit = in_rectangles(points.select("id", "lat", "lon"), view(spark, sf_dir, "fx_units").where("pub_access = 'XA'"), 0.1).select("id").distinct().withColumn("hit", F.lit(True))
    return points.join(hit, "id", "left").select("id", "highway_class", F.coalesce("hit", F.lit(False)).alias("closed"))


@query("write_chunk_costs")
def write_chunk_costs(spark, sf_dir):
    from ..sources.writers import rewritten
    from .routing import CHUNK, chunked
    from ..operators.routing import build_chunks

    return rewritten(build_chunks(chunked(spark, sf_dir), CHUNK), "chunk_costs", partition_by=["mode"]).groupBy("mode").agg(F.count("*").alias("rows"))


@query("write_tile_meta", "WITH c AS (SELECT count(*) AS cells, count(DISTINCT (r // 16, c // 16)) AS chunks FROM fx_cells) SELECT key, value FROM (SELECT unnest(['chunk_size', 'entrances', 'chunks', 'cells', 'region']) AS key, unnest(['16', '20', chunks::VARCHAR, cells::VARCHAR, 'orders']) AS value FROM c)")
def write_tile_meta(spark, sf_dir):
    """What a set of chunk costs was made of, written beside it and read again."""
    from ..operators.routing import entrances
    from ..sources.writers import rewritten
    from .routing import CHUNK

    counts = view(spark, sf_dir, "fx_cells").agg(F.count("*").alias("cells"), F.countDistinct(F.floor(C("r") / CHUNK), F.floor(C("c") / CHUNK)).alias("chunks"))
    facts = {"chunk_size": F.lit(CHUNK), "entrances": F.lit(len(entrances(CHUNK))), "chunks": C("chunks"), "cells": C("cells"), "region": F.lit("orders")}
    return rewritten(counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in facts.items()])).alias("m")).select("m.key", "m.value"), "tile_meta")


@query("ttl_filter", f"SELECT id FROM ({CACHE}) WHERE cached_at IS NOT NULL AND cached_at <> 0 AND 1200 - cached_at <= 600")
def ttl_filter(spark, sf_dir):
    return cache(spark, sf_dir).where("cached_at is not null and cached_at <> 0 and 1200 - cached_at <= 600").select("id")
