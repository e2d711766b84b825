"""Queries of the service surface."""

from __future__ import annotations

from pyspark.sql import functions as F

from .fixtures import view
from .registry import query

C = F.col


@query("fleet_merge", "SELECT n_name AS service, coalesce(p.status, 'degraded') AS status, coalesce(p.latency, -1)::BIGINT AS latency FROM nation LEFT JOIN (SELECT s_nationkey AS k, 'ok' AS status, max(s_suppkey) AS latency FROM supplier WHERE s_acctbal > 0 GROUP BY 1) p ON p.k = n_nationkey")
def fleet_merge(spark, sf_dir):
    probes = spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_acctbal > 0").groupBy("s_nationkey").agg(F.max("s_suppkey").alias("latency"))
    services = spark.read.parquet(f"{sf_dir}/nation.parquet").select(C("n_name").alias("service"), C("n_nationkey").alias("s_nationkey"))
    joined = services.join(probes, "s_nationkey", "left")
    return joined.select("service", F.when(C("latency").isNotNull(), "ok").otherwise("degraded").alias("status"), F.coalesce("latency", F.lit(-1).cast("long")).alias("latency"))


@query("landclass_is_private", "SELECT p.pid, count(u.unit_id) = 0 AS is_private FROM fx_points p LEFT JOIN fx_units u ON lon >= xmin AND lon <= xmax AND lat >= ymin AND lat <= ymax GROUP BY p.pid")
def landclass_is_private(spark, sf_dir):
    from ..operators.spatial import in_rectangles

    points = view(spark, sf_dir, "fx_points")
    hit = in_rectangles(points, view(spark, sf_dir, "fx_units"), 0.1).select("pid").distinct().withColumn("hit", F.lit(True))
    return points.select("pid").join(hit, "pid", "left").select("pid", C("hit").isNull().alias("is_private"))


@query("fn_parse_coords_fe", "SELECT pid, round(lat, 6) AS lat, round(lon, 6) AS lon FROM fx_points")
def fn_parse_coords_fe(spark, sf_dir):
    from ..functions.text import parse_coords

    shown = F.concat(F.lit("  "), C("lat").cast("string"), F.lit(", "), C("lon").cast("string"))
    at = parse_coords(shown)
    return view(spark, sf_dir, "fx_points").select("pid", F.round(at["lat"], 6).alias("lat"), F.round(at["lon"], 6).alias("lon"))
