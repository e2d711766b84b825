"""Queries of window-shaped operators along routes."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import runs
from ..operators.lines import islands, steps
from .fixtures import view
from .geodesy import sql_haversine
from .registry import query

C = F.col
STEP = f"SELECT *, coalesce({sql_haversine('plat', 'plon', 'lat', 'lon')}, 0) AS d FROM (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM fx_path WINDOW w AS (PARTITION BY route_id ORDER BY i))"
SURFACE = "CASE WHEN use_tag = 'path' THEN 'TRAIL' WHEN use_tag = 'track' OR (surface = 'dirt' AND use_tag = 'road') THEN 'TRACK' WHEN surface IN ('gravel','dirt') THEN 'UNPAVED' WHEN surface IN ('paved','asphalt') THEN 'PAVED' END"
RUNS = f"SELECT route_id, edge_no, length_m, cat, sum(CASE WHEN first OR cat IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY route_id ORDER BY edge_no) AS run FROM (SELECT *, lag(cat) OVER w AS before, row_number() OVER w = 1 AS first FROM (SELECT *, {SURFACE} AS cat FROM fx_trace_edges) WINDOW w AS (PARTITION BY route_id ORDER BY edge_no))"


def edges(spark, sf_dir):
    return view(spark, sf_dir, "fx_trace_edges").withColumn("category", runs.surface_class(C("surface"), C("use_tag")))


@query("fn_classify_surface", f"SELECT route_id, edge_no, {SURFACE} AS category FROM fx_trace_edges")
def fn_classify_surface(spark, sf_dir):
    return edges(spark, sf_dir).select("route_id", "edge_no", "category")


@query("win_cumdist", f"SELECT route_id, i, round(sum(d) OVER (PARTITION BY route_id ORDER BY i ROWS UNBOUNDED PRECEDING), 3) AS along_m FROM ({STEP})")
def win_cumdist(spark, sf_dir):
    return steps(view(spark, sf_dir, "fx_path")).select("route_id", "i", F.round("along_m", 3).alias("along_m"))


@query("win_runs", f"SELECT route_id, run::BIGINT AS run, any_value(cat) AS category, count(*)::BIGINT AS edges, round(sum(length_m), 3) AS metres FROM ({RUNS}) GROUP BY route_id, run")
def win_runs(spark, sf_dir):
    out = islands(edges(spark, sf_dir), "category", "route_id", "edge_no")
    return out.groupBy("route_id", "run").agg(F.first("category").alias("category"), F.count("*").alias("edges"), F.round(F.sum("length_m"), 3).alias("metres"))


@query("win_boundaries", f"SELECT route_id, n::INTEGER AS n, from_category, to_category FROM (SELECT route_id, run, cat AS to_category, before AS from_category, row_number() OVER (PARTITION BY route_id ORDER BY run) AS n FROM (SELECT route_id, run, cat, lag(cat) OVER (PARTITION BY route_id ORDER BY run) AS before FROM (SELECT route_id, run, any_value(cat) AS cat FROM ({RUNS}) GROUP BY 1, 2)) WHERE cat IS NOT NULL AND before IS NOT NULL) WHERE n <= 10")
def win_boundaries(spark, sf_dir):
    each = islands(edges(spark, sf_dir), "category", "route_id", "edge_no").groupBy("route_id", "run").agg(F.first("category").alias("to_category"))
    order = Window.partitionBy("route_id").orderBy("run")
    changed = each.withColumn("from_category", F.lag("to_category").over(order)).where("to_category is not null and from_category is not null")
    return changed.withColumn("n", F.row_number().over(order)).where("n <= 10").select("route_id", "n", "from_category", "to_category")


@query("win_collapse_short")
def win_collapse_short(spark, sf_dir):
    return runs.collapsed(edges(spark, sf_dir)).select("route_id", "run", "category", F.round("metres", 3).alias("metres"))


@query("win_maneuvers")
def win_maneuvers(spark, sf_dir):
    return runs.maneuvers(view(spark, sf_dir, "fx_path")).select("route_id", "n", F.round("metres", 3).alias("metres"), "grade", "instruction")


MODES = "SELECT *, sum(CASE WHEN first OR mode <> before THEN 1 ELSE 0 END) OVER (PARTITION BY route_id ORDER BY i) AS run FROM (SELECT *, lag(mode) OVER w AS before, row_number() OVER w = 1 AS first FROM fx_path WINDOW w AS (PARTITION BY route_id ORDER BY i))"


@query("win_mode_segments", f"SELECT route_id, run::BIGINT AS run, any_value(mode) AS mode, count(*)::BIGINT AS points FROM ({MODES}) GROUP BY 1, 2 HAVING count(*) > 1")
def win_mode_segments(spark, sf_dir):
    out = islands(view(spark, sf_dir, "fx_path"), "mode").groupBy("route_id", "run").agg(F.first("mode").alias("mode"), F.count("*").alias("points"))
    return out.where("points > 1")


@query("win_dedupe_consecutive", "SELECT route_id, count(*)::BIGINT AS kept FROM (SELECT route_id, floor(lat*100 + 0.25e0) AS a, lag(floor(lat*100 + 0.25e0)) OVER (PARTITION BY route_id ORDER BY i) AS b FROM fx_path) WHERE b IS NULL OR a <> b GROUP BY route_id")
def win_dedupe_consecutive(spark, sf_dir):
    rough = view(spark, sf_dir, "fx_path").withColumn("a", F.floor(C("lat") * 100 + 0.25))
    kept = rough.withColumn("b", F.lag("a").over(Window.partitionBy("route_id").orderBy("i"))).where("b is null or a <> b")
    return kept.groupBy("route_id").agg(F.count("*").alias("kept"))


@query("win_stitch", "SELECT o_custkey AS trip, sum(n)::BIGINT - count(*)::BIGINT + 1 AS vertices FROM (SELECT route_id, count(*) AS n FROM fx_path GROUP BY route_id) JOIN orders ON o_orderkey = route_id GROUP BY o_custkey")
def win_stitch(spark, sf_dir):
    legs = view(spark, sf_dir, "fx_path").groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("i", "lat", "lon"))).alias("line"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(C("o_orderkey").alias("route_id"), C("o_custkey").alias("trip"))
    trips = legs.join(orders, "route_id").groupBy("trip").agg(F.array_sort(F.collect_list(F.struct("route_id", "line"))).alias("legs"))
    whole = F.concat(C("legs")[0]["line"], F.flatten(F.transform(F.slice("legs", 2, F.size("legs")), lambda leg: F.slice(leg["line"], 2, F.size(leg["line"])))))
    return trips.select("trip", F.size(whole).cast("long").alias("vertices"))


@query("agg_path_stats", f"SELECT route_id, round(sum(d)/1000, 5) AS distance_km, sum(greatest(coalesce(dz, 0), 0)) AS gain_m, sum(greatest(coalesce(-dz, 0), 0)) AS loss_m, round(100.0e0*count(*) FILTER (on_trail)/count(*), 6) AS on_trail_pct, count(*) FILTER (barrier)::BIGINT AS barrier_crossings, count(*)::BIGINT AS cells FROM (SELECT *, elev_m - lag(elev_m) OVER (PARTITION BY route_id ORDER BY i) AS dz FROM ({STEP})) GROUP BY route_id")
def agg_path_stats(spark, sf_dir):
    along = steps(view(spark, sf_dir, "fx_path")).withColumn("dz", C("elev_m") - F.lag("elev_m").over(Window.partitionBy("route_id").orderBy("i")))
    positive = lambda c: F.sum(F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0)))
    return along.groupBy("route_id").agg(F.round(F.sum(F.coalesce("step_m", F.lit(0.0))) / 1000, 5).alias("distance_km"), positive(C("dz")).alias("gain_m"), positive(-C("dz")).alias("loss_m"), F.round(100.0 * F.count_if("on_trail") / F.count("*"), 6).alias("on_trail_pct"), F.count_if("barrier").alias("barrier_crossings"), F.count("*").alias("cells"))


@query("agg_distinct_modes", "SELECT route_id, list_sort(list(DISTINCT mode)) AS modes, CASE WHEN count(DISTINCT mode) > 1 THEN 'hybrid' ELSE min(mode) END AS label FROM fx_path GROUP BY route_id")
def agg_distinct_modes(spark, sf_dir):
    out = view(spark, sf_dir, "fx_path").groupBy("route_id").agg(F.array_sort(F.collect_set("mode")).alias("modes"))
    return out.withColumn("label", F.when(F.size("modes") > 1, "hybrid").otherwise(C("modes")[0]))


@query("agg_multileg", "SELECT o_custkey AS trip, count(*)::BIGINT AS legs, sum(n)::BIGINT AS points, round(sum(effort), 3) AS effort FROM (SELECT route_id, count(*) AS n, sum(elev_m) AS effort FROM fx_path GROUP BY route_id) JOIN orders ON o_orderkey = route_id GROUP BY o_custkey")
def agg_multileg(spark, sf_dir):
    legs = view(spark, sf_dir, "fx_path").groupBy("route_id").agg(F.count("*").alias("n"), F.sum("elev_m").alias("effort"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(C("o_orderkey").alias("route_id"), C("o_custkey").alias("trip"))
    return legs.join(orders, "route_id").groupBy("trip").agg(F.count("*").alias("legs"), F.sum("n").alias("points"), F.round(F.sum("effort"), 3).alias("effort"))


@query("agg_route_totals", "SELECT route_id, round(sum(length_m) FILTER (use_tag = 'road')/1000, 5) AS network_km, round(sum(length_m) FILTER (use_tag <> 'road')/1000, 5) AS wild_km, round(avg(CASE WHEN use_tag = 'path' THEN 100.0e0 WHEN use_tag = 'track' THEN 50.0e0 END), 6) AS on_trail_pct FROM fx_trace_edges GROUP BY route_id")
def agg_route_totals(spark, sf_dir):
    road = C("use_tag") == "road"
    share = F.when(C("use_tag") == "path", 100.0).when(C("use_tag") == "track", 50.0)
    return view(spark, sf_dir, "fx_trace_edges").groupBy("route_id").agg(F.round(F.sum(F.when(road, C("length_m"))) / 1000, 5).alias("network_km"), F.round(F.sum(F.when(~road, C("length_m"))) / 1000, 5).alias("wild_km"), F.round(F.avg(share), 6).alias("on_trail_pct"))
