"""Queries of the geodesy functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from .fixtures import view
from .registry import query

C = F.col
PAIRS = "SELECT p.pid, p.lat, p.lon, q.lat AS qlat, q.lon AS qlon FROM fx_points p JOIN fx_probe q ON p.pid % 100 + 1 = q.qid"
HAV = "2*6371000.0e0*atan2(sqrt(h), sqrt(1-h))"
H = "pow(sin((radians({c})-radians({a}))/2),2)+cos(radians({a}))*cos(radians({c}))*pow(sin((radians({d})-radians({b}))/2),2)"
BEAR = "(((degrees(atan2(sin(radians(({d})-({b})))*cos(radians({c})), cos(radians({a}))*sin(radians({c}))-sin(radians({a}))*cos(radians({c}))*cos(radians(({d})-({b})))))+360.0e0) % 360.0e0) + 360.0e0) % 360.0e0"


def sql_haversine(a: str, b: str, c: str, d: str) -> str:
    h = H.format(a=a, b=b, c=c, d=d)
    return f"(2*6371000.0e0*atan2(sqrt({h}), sqrt(1-({h}))))"


def sql_bearing(a: str, b: str, c: str, d: str) -> str:
    return "(" + BEAR.format(a=a, b=b, c=c, d=d) + ")"


def pairs(spark, sf_dir):
    """Points with one probe each."""
    q = view(spark, sf_dir, "fx_probe").select("qid", C("lat").alias("qlat"), C("lon").alias("qlon"))
    return view(spark, sf_dir, "fx_points").join(q, C("pid") % 100 + 1 == C("qid")).drop("qid")


@query("fn_haversine", f"SELECT pid, round({sql_haversine('lat', 'lon', 'qlat', 'qlon')}, 6) AS metres FROM ({PAIRS})")
def fn_haversine(spark, sf_dir):
    return pairs(spark, sf_dir).select("pid", F.round(geo.haversine(C("lat"), C("lon"), C("qlat"), C("qlon")), 6).alias("metres"))


@query("fn_bearing", f"SELECT pid, round({sql_bearing('lat', 'lon', 'qlat', 'qlon')}, 6) AS bearing FROM ({PAIRS})")
def fn_bearing(spark, sf_dir):
    return pairs(spark, sf_dir).select("pid", F.round(geo.bearing(C("lat"), C("lon"), C("qlat"), C("qlon")), 6).alias("bearing"))


@query("fn_acute_angle", "SELECT pid, least(abs(pid*37 % 360 - pid*101 % 360) % 180.0e0, 180.0e0 - abs(pid*37 % 360 - pid*101 % 360) % 180.0e0) AS angle FROM fx_points")
def fn_acute_angle(spark, sf_dir):
    return view(spark, sf_dir, "fx_points").select("pid", geo.acute_angle(C("pid") * 37 % 360, (C("pid") * 101 % 360).cast("double")).alias("angle"))


@query(
    "fn_cross_track",
    f"""SELECT pid, round(CASE WHEN qlat = 43.5e0 AND qlon = -116.5e0 THEN d ELSE abs(asin(greatest(-1.0e0, least(1.0e0, sin(d/6371000.0e0)*sin(radians(b1)-radians(b2))))))*6371000.0e0 END, 3) AS metres
    FROM (SELECT *, 2*6371000.0e0*asin(least(1.0e0, sqrt({H.format(a="43.5e0", b="-116.5e0", c="lat", d="lon")}))) AS d, {sql_bearing("43.5e0", "-116.5e0", "lat", "lon")} AS b1, {sql_bearing("43.5e0", "-116.5e0", "qlat", "qlon")} AS b2 FROM ({PAIRS}))""",
)
def fn_cross_track(spark, sf_dir):
    a, b = F.lit(43.5), F.lit(-116.5)
    return pairs(spark, sf_dir).select("pid", F.round(geo.cross_track(C("lat"), C("lon"), a, b, C("qlat"), C("qlon")), 3).alias("metres"))


@query("fn_cardinal16", "SELECT pid, ['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSW','SW','WSW','W','WNW','NW','NNW'][CAST(round_even((pid*37 % 1440)/4.0e0/22.5e0, 0) AS INT) % 16 + 1] AS point FROM fx_points")
def fn_cardinal16(spark, sf_dir):
    return view(spark, sf_dir, "fx_points").select("pid", geo.cardinal16((C("pid") * 37 % 1440) / 4.0).alias("point"))


@query("fn_grade_category", "SELECT pid, CASE WHEN abs(g) < 2 THEN 'flat' WHEN abs(g) < 5 THEN 'gentle' WHEN abs(g) < 10 THEN 'moderate' WHEN abs(g) < 15 THEN 'steep' ELSE 'very steep' END AS category FROM (SELECT pid, (pid % 41) - 20.0e0 AS g FROM fx_points)")
def fn_grade_category(spark, sf_dir):
    return view(spark, sf_dir, "fx_points").select("pid", geo.grade_category((C("pid") % 41) - 20.0).alias("category"))


@query("fn_buffer_degrees", "SELECT pid, round(greatest(75/111320.0e0, 75/(111320.0e0*greatest(0.01e0, cos(radians(lat))))), 12) AS degrees FROM fx_points")
def fn_buffer_degrees(spark, sf_dir):
    return view(spark, sf_dir, "fx_points").select("pid", F.round(geo.buffer_degrees(F.lit(75.0), C("lat")), 12).alias("degrees"))


@query("fn_tile_xy", "SELECT pid, CAST(trunc((lon+180.0e0)/360.0e0*4096) AS INT) AS x, CAST(trunc((1.0e0-asinh(tan(radians(lat)))/pi())/2.0e0*4096) AS INT) AS y FROM fx_points")
def fn_tile_xy(spark, sf_dir):
    return view(spark, sf_dir, "fx_points").select("pid", geo.tile_x(C("lon"), 12).alias("x"), geo.tile_y(C("lat"), 12).alias("y"))


@query("fn_tile_bounds", "SELECT pid, round(x/4096.0e0*360.0e0-180.0e0, 9) AS west, round((x+1)/4096.0e0*360.0e0-180.0e0, 9) AS east, round(degrees(atan(sinh(pi()*(1.0e0-2.0e0*y/4096.0e0)))), 9) AS north, round(degrees(atan(sinh(pi()*(1.0e0-2.0e0*(y+1)/4096.0e0)))), 9) AS south FROM (SELECT pid, pid % 4096 AS x, pid*7 % 4096 AS y FROM fx_points)")
def fn_tile_bounds(spark, sf_dir):
    x, y = C("pid") % 4096, C("pid") * 7 % 4096
    edge = lambda c: F.round(c, 9)
    return view(spark, sf_dir, "fx_points").select("pid", edge(geo.tile_lon(x, 12)).alias("west"), edge(geo.tile_lon(x + 1, 12)).alias("east"), edge(geo.tile_lat(y, 12)).alias("north"), edge(geo.tile_lat(y + 1, 12)).alias("south"))


@query("fn_terrarium", "SELECT pid, (pid % 256)*256.0e0 + (pid*3 % 256) + (pid*7 % 256)/256.0e0 - 32768.0e0 AS elevation FROM fx_points")
def fn_terrarium(spark, sf_dir):
    return view(spark, sf_dir, "fx_points").select("pid", geo.terrarium(C("pid") % 256, C("pid") * 3 % 256, C("pid") * 7 % 256).alias("elevation"))


@query("fn_chunk_coords", "SELECT pid, CAST(floor(lon/(1.5e0/111.0e0)) AS BIGINT) AS cx, CAST(floor(lat/(1.5e0/111.0e0)) AS BIGINT) AS cy FROM fx_points")
def fn_chunk_coords(spark, sf_dir):
    return view(spark, sf_dir, "fx_points").select("pid", geo.chunk(C("lon")).alias("cx"), geo.chunk(C("lat")).alias("cy"))


@query("fn_chunk_bounds", "SELECT qid, round(cx*(1.5e0/111.0e0), 9) AS west, round(cy*(1.5e0/111.0e0), 9) AS south, round((cx+1)*(1.5e0/111.0e0), 9) AS east, round((cy+1)*(1.5e0/111.0e0), 9) AS north FROM (SELECT qid, floor(lon/(1.5e0/111.0e0)) AS cx, floor(lat/(1.5e0/111.0e0)) AS cy FROM fx_probe)")
def fn_chunk_bounds(spark, sf_dir):
    cx, cy = geo.chunk(C("lon")), geo.chunk(C("lat"))
    at = lambda c, n: F.round(c * geo.CHUNK_DEG, 9).alias(n)
    return view(spark, sf_dir, "fx_probe").select("qid", at(cx, "west"), at(cy, "south"), at(cx + 1, "east"), at(cy + 1, "north"))


@query("fn_chunk_cover", "SELECT qid, cx, cy FROM (SELECT qid, unnest(range(CAST(floor(lon/(1.5e0/111.0e0)) AS BIGINT), CAST(floor((lon+0.03e0)/(1.5e0/111.0e0)) AS BIGINT)+1)) AS cx, lat FROM fx_probe), unnest(range(CAST(floor(lat/(1.5e0/111.0e0)) AS BIGINT), CAST(floor((lat+0.02e0)/(1.5e0/111.0e0)) AS BIGINT)+1)) t(cy)")
def fn_chunk_cover(spark, sf_dir):
    across = F.sequence(geo.chunk(C("lon")), geo.chunk(C("lon") + 0.03))
    up = F.sequence(geo.chunk(C("lat")), geo.chunk(C("lat") + 0.02))
    return view(spark, sf_dir, "fx_probe").select("qid", F.explode(across).alias("cx"), up.alias("up")).select("qid", "cx", F.explode("up").alias("cy"))


@query("fn_round_key", "SELECT round(lat, 2) AS lat_key, round(lon, 2) AS lon_key, count(*)::BIGINT AS points FROM fx_points GROUP BY 1, 2")
def fn_round_key(spark, sf_dir):
    return view(spark, sf_dir, "fx_points").groupBy(F.round("lat", 2).alias("lat_key"), F.round("lon", 2).alias("lon_key")).agg(F.count("*").alias("points"))


@query("fn_latlon_pixel", "SELECT pid, CAST(trunc((44.0e0-lat)/0.01e0) AS INT) AS row, CAST(trunc((lon+117.0e0)/0.01e0) AS INT) AS col, CAST(trunc((44.0e0-lat)/0.01e0+1.0e-6) AS INT) AS snapped_row FROM fx_points")
def fn_latlon_pixel(spark, sf_dir):
    down, across = (44.0 - C("lat")) / 0.01, (C("lon") + 117.0) / 0.01
    return view(spark, sf_dir, "fx_points").select("pid", down.cast("int").alias("row"), across.cast("int").alias("col"), (down + 1e-6).cast("int").alias("snapped_row"))


@query("fn_pixel_latlon", "SELECT r, c, round(44.0e0 - (r+0.5e0)*0.025e0, 9) AS lat, round(-117.0e0 + (c+0.5e0)*0.025e0, 9) AS lon FROM fx_cells")
def fn_pixel_latlon(spark, sf_dir):
    return view(spark, sf_dir, "fx_cells").select("r", "c", F.round(44.0 - (C("r") + 0.5) * 0.025, 9).alias("lat"), F.round(-117.0 + (C("c") + 0.5) * 0.025, 9).alias("lon"))


@query("coord_validate", "SELECT pid, (TRY_CAST(t AS DOUBLE) IS NOT NULL AND TRY_CAST(t AS DOUBLE) BETWEEN -90 AND 90) AS ok FROM (SELECT pid, CASE pid % 5 WHEN 0 THEN 'abc' WHEN 1 THEN '91.5' ELSE CAST(round(lat, 3) AS VARCHAR) END AS t FROM fx_points)")
def coord_validate(spark, sf_dir):
    text = F.when(C("pid") % 5 == 0, "abc").when(C("pid") % 5 == 1, "91.5").otherwise(F.round("lat", 3).cast("string"))
    return view(spark, sf_dir, "fx_points").select("pid", geo.valid_coordinate(text.try_cast("double"), F.lit(0.0)).alias("ok"))


@query("fn_densify", "SELECT pid, k, round(lat + (0.004e0)*k/n, 9) AS lat, round(lon + 0.003e0*k/n, 9) AS lon FROM (SELECT pid, lat, lon, n, unnest(range(0, n+1)) AS k FROM (SELECT pid, lat, lon, greatest(2, CAST(trunc(d/100) AS BIGINT)+1) - 1 AS n FROM (SELECT pid, lat, lon, {h} AS d FROM fx_points)))".format(h=sql_haversine("lat", "lon", "(lat+0.004e0)", "(lon+0.003e0)")))
def fn_densify(spark, sf_dir):
    from ..operators.lines import densify

    ends = view(spark, sf_dir, "fx_points").select("pid", "lat", "lon", (C("lat") + 0.004).alias("lat2"), (C("lon") + 0.003).alias("lon2"))
    out = densify(ends, spacing_m=100.0)
    return out.select("pid", "k", F.round("at_lat", 9).alias("lat"), F.round("at_lon", 9).alias("lon"))


@query("agg_measure", "SELECT route_id, round(sum(d), 2) AS metres FROM (SELECT route_id, {h} AS d FROM (SELECT route_id, lat, lon, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM fx_path WINDOW w AS (PARTITION BY route_id ORDER BY i)) WHERE plat IS NOT NULL) GROUP BY route_id".format(h=sql_haversine("plat", "plon", "lat", "lon")))
def agg_measure(spark, sf_dir):
    from ..operators.lines import steps

    return steps(view(spark, sf_dir, "fx_path")).where(C("step_m").isNotNull()).groupBy("route_id").agg(F.round(F.sum("step_m"), 2).alias("metres"))
