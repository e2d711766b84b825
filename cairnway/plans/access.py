"""Queries of seasonal access."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import season
from .fixtures import view
from .registry import query

C = F.col
DAY = 115
PARTS = "list_filter(list_transform(string_split(coalesce(atv_datesopen, ''), ','), lambda p: CASE WHEN regexp_matches(trim(p), '^\\d{1,2}/\\d{1,2}-\\d{1,2}/\\d{1,2}') THEN [CAST(regexp_extract(trim(p), '^(\\d+)/(\\d+)-(\\d+)/(\\d+)', 1) AS INT)*100 + CAST(regexp_extract(trim(p), '^(\\d+)/(\\d+)-(\\d+)/(\\d+)', 2) AS INT), CAST(regexp_extract(trim(p), '^(\\d+)/(\\d+)-(\\d+)/(\\d+)', 3) AS INT)*100 + CAST(regexp_extract(trim(p), '^(\\d+)/(\\d+)-(\\d+)/(\\d+)', 4) AS INT)] END), lambda r: r IS NOT NULL)"
IN = "(len({p}) = 0 OR len(list_filter({p}, lambda r: CASE WHEN r[1] <= r[2] THEN {d} BETWEEN r[1] AND r[2] ELSE {d} >= r[1] OR {d} <= r[2] END)) > 0)"
CHECK = "CASE WHEN atv IS NULL OR trim(atv) = '' THEN NULL WHEN lower(trim(atv)) <> 'open' THEN false ELSE " + IN.format(p=PARTS, d=DAY) + " END"
SYMBOL = "CASE WHEN symbol IN ('1','4') THEN true WHEN symbol = '2' THEN false WHEN symbol IN ('3','11','12') THEN false END"
ROW = f"coalesce({CHECK}, {SYMBOL})"


def mvum(spark, sf_dir):
    return view(spark, sf_dir, "fx_mvum")


@query("fn_parse_date_ranges", f"SELECT ogc_fid, len({PARTS})::INTEGER AS n_ranges, ({PARTS})[1][1] AS first_start, ({PARTS})[1][2] AS first_end FROM fx_mvum")
def fn_parse_date_ranges(spark, sf_dir):
    r = season.date_ranges(C("atv_datesopen"))
    return mvum(spark, sf_dir).select("ogc_fid", F.size(r).alias("n_ranges"), F.get(r, 0)["first"].alias("first_start"), F.get(r, 0)["last"].alias("first_end"))


@query("fn_in_season", f"SELECT ogc_fid, {IN.format(p=PARTS, d=DAY)} AS in_january, {IN.format(p=PARTS, d=701)} AS in_july FROM fx_mvum")
def fn_in_season(spark, sf_dir):
    r = season.date_ranges(C("atv_datesopen"))
    return mvum(spark, sf_dir).select("ogc_fid", season.in_season(r, DAY).alias("in_january"), season.in_season(r, 701).alias("in_july"))


@query("fn_check_access", f"SELECT ogc_fid, {CHECK} AS access FROM fx_mvum")
def fn_check_access(spark, sf_dir):
    return mvum(spark, sf_dir).select("ogc_fid", season.check_access(C("atv"), C("atv_datesopen"), DAY).alias("access"))


@query("fn_symbol_access", f"SELECT ogc_fid, {SYMBOL} AS atv_access, CASE WHEN symbol = '2' THEN true ELSE {SYMBOL} END AS vehicle_access FROM fx_mvum")
def fn_symbol_access(spark, sf_dir):
    return mvum(spark, sf_dir).select("ogc_fid", season.symbol_access(C("symbol"), "atv").alias("atv_access"), season.symbol_access(C("symbol"), "vehicle").alias("vehicle_access"))


@query("fn_row_access", f"SELECT ogc_fid, {ROW} AS access FROM fx_mvum")
def fn_row_access(spark, sf_dir):
    return mvum(spark, sf_dir).select("ogc_fid", season.row_access(C("atv"), C("atv_datesopen"), C("symbol"), "atv", DAY).alias("access"))


@query("fn_mode_field", "SELECT * FROM (VALUES ('atv','atv','atv_datesopen'),('motorcycle','motorcycle','motorcycle_datesopen'),('mtb','e_bike_class1','e_bike_class1_dur'),('vehicle','highclearancevehicle','highclearancevehicle_datesopen'),('passenger','passengervehicle','passengervehicle_datesopen'),('sled','highclearancevehicle','highclearancevehicle_datesopen')) t(mode, status_field, dates_field)")
def fn_mode_field(spark, sf_dir):
    modes = [*season.MODE_FIELDS, "sled"]
    return spark.createDataFrame([(m, *season.mode_field(m)) for m in modes], "mode string, status_field string, dates_field string")


@query("fn_parse_check_date", "SELECT pid, CASE WHEN pid % 4 = 0 THEN NULL ELSE (1 + pid % 12)*100 + 1 + pid % 28 END::INTEGER AS day FROM fx_points")
def fn_parse_check_date(spark, sf_dir):
    text = F.when(C("pid") % 4 == 0, "soon").otherwise(F.concat_ws("/", (1 + C("pid") % 12).cast("string"), (1 + C("pid") % 28).cast("string")))
    return view(spark, sf_dir, "fx_points").select("pid", season.parse_check_date(text).alias("day"))


@query("scan_mvum_access", f"SELECT ogc_fid, 'road' AS kind, access FROM (SELECT ogc_fid, {ROW} AS access FROM fx_mvum) WHERE access IS NOT NULL")
def scan_mvum_access(spark, sf_dir):
    access = season.row_access(C("atv"), C("atv_datesopen"), C("symbol"), "atv", DAY)
    return mvum(spark, sf_dir).select("ogc_fid", F.lit("road").alias("kind"), access.alias("access")).where("access is not null")


@query("agg_worst_status", f"SELECT ogc_fid % 500 AS edge, CASE max(CASE WHEN access THEN 0 WHEN access IS NULL THEN 1 ELSE 2 END) WHEN 0 THEN 'open' WHEN 1 THEN 'unknown' ELSE 'closed' END AS status, count(*)::BIGINT AS matched FROM (SELECT ogc_fid, {ROW} AS access FROM fx_mvum) GROUP BY 1")
def agg_worst_status(spark, sf_dir):
    access = season.row_access(C("atv"), C("atv_datesopen"), C("symbol"), "atv", DAY)
    status = F.when(access, "open").when(access.isNull(), "unknown").otherwise("closed")
    ranked = mvum(spark, sf_dir).select((C("ogc_fid") % 500).alias("edge"), status.alias("status")).withColumn("rank", F.when(C("status") == "open", 0).when(C("status") == "unknown", 1).otherwise(2))
    return ranked.groupBy("edge").agg(F.max_by("status", "rank").alias("status"), F.count("*").alias("matched"))


@query("agg_closed_crossings", f"SELECT ogc_fid % 97 AS route, count(*) FILTER (access = false)::BIGINT AS closed, count(access)::BIGINT AS annotated FROM (SELECT ogc_fid, {ROW} AS access FROM fx_mvum) GROUP BY 1")
def agg_closed_crossings(spark, sf_dir):
    access = season.row_access(C("atv"), C("atv_datesopen"), C("symbol"), "atv", DAY)
    return mvum(spark, sf_dir).select((C("ogc_fid") % 97).alias("route"), access.alias("access")).groupBy("route").agg(F.count_if(~C("access")).alias("closed"), F.count("access").alias("annotated"))


@query("agg_extent", "SELECT min(least(lon1, lon2)) AS xmin, max(greatest(lon1, lon2)) AS xmax, min(least(lat1, lat2)) AS ymin, max(greatest(lat1, lat2)) AS ymax FROM fx_mvum")
def agg_extent(spark, sf_dir):
    return mvum(spark, sf_dir).agg(F.min(F.least("lon1", "lon2")).alias("xmin"), F.max(F.greatest("lon1", "lon2")).alias("xmax"), F.min(F.least("lat1", "lat2")).alias("ymin"), F.max(F.greatest("lat1", "lat2")).alias("ymax"))


@query("union_roads_trails", "SELECT ogc_fid, 'road' AS kind FROM fx_mvum WHERE atv IS NOT NULL UNION ALL SELECT ogc_fid, 'trail' AS kind FROM fx_mvum WHERE atv IS NULL")
def union_roads_trails(spark, sf_dir):
    rows = mvum(spark, sf_dir)
    return rows.where("atv is not null").select("ogc_fid", F.lit("road").alias("kind")).unionByName(rows.where("atv is null").select("ogc_fid", F.lit("trail").alias("kind")))


@query("fn_exclude_selection", f"SELECT ogc_fid FROM (SELECT ogc_fid, {ROW} AS access, least(lat1, lat2) AS ymin, greatest(lat1, lat2) AS ymax, least(lon1, lon2) AS xmin, greatest(lon1, lon2) AS xmax FROM fx_mvum) WHERE access = false AND ymax >= 43.2e0 AND ymin <= 43.6e0 AND xmax >= -116.9e0 AND xmin <= -116.3e0 ORDER BY ogc_fid LIMIT 500")
def fn_exclude_selection(spark, sf_dir):
    access = season.row_access(C("atv"), C("atv_datesopen"), C("symbol"), "atv", DAY)
    near = (F.greatest("lat1", "lat2") >= 43.2) & (F.least("lat1", "lat2") <= 43.6) & (F.greatest("lon1", "lon2") >= -116.9) & (F.least("lon1", "lon2") <= -116.3)
    return mvum(spark, sf_dir).where(near & ~access).select("ogc_fid").orderBy("ogc_fid").limit(500)


@query("cap_polygons", "SELECT ogc_fid, row_number() OVER (ORDER BY ogc_fid)::INTEGER AS n FROM fx_mvum WHERE atv = 'closed' QUALIFY n <= 500")
def cap_polygons(spark, sf_dir):
    from pyspark.sql.window import Window

    first = mvum(spark, sf_dir).where("atv = 'closed'").select("ogc_fid").orderBy("ogc_fid").limit(500)  # a top-k, so the window sees 500 rows
    return first.withColumn("n", F.row_number().over(Window.orderBy("ogc_fid")))


@query("bbox_features", "SELECT ogc_fid FROM fx_mvum WHERE greatest(lat1, lat2) >= 43.3e0 AND least(lat1, lat2) <= 43.4e0 AND greatest(lon1, lon2) >= -116.8e0 AND least(lon1, lon2) <= -116.6e0")
def bbox_features(spark, sf_dir):
    return mvum(spark, sf_dir).where((F.greatest("lat1", "lat2") >= 43.3) & (F.least("lat1", "lat2") <= 43.4) & (F.greatest("lon1", "lon2") >= -116.8) & (F.least("lon1", "lon2") <= -116.6)).select("ogc_fid")


@query("bbox_reject", "SELECT ogc_fid FROM fx_mvum WHERE NOT (greatest(lon1, lon2) < -116.9e0 OR least(lon1, lon2) > -116.2e0 OR greatest(lat1, lat2) < 43.1e0 OR least(lat1, lat2) > 43.8e0)")
def bbox_reject(spark, sf_dir):
    out = (F.greatest("lon1", "lon2") < -116.9) | (F.least("lon1", "lon2") > -116.2) | (F.greatest("lat1", "lat2") < 43.1) | (F.least("lat1", "lat2") > 43.8)
    return mvum(spark, sf_dir).where(~out).select("ogc_fid")


@query("fn_exclude_buffers")
def fn_exclude_buffers(spark, sf_dir):
    """Closed features near the route as 15 m polygons, in strict mode."""
    from ..operators.lines import buffered

    access = season.row_access(C("atv"), C("atv_datesopen"), C("symbol"), "atv", DAY)
    near = (F.greatest("lat1", "lat2") >= 43.2) & (F.least("lat1", "lat2") <= 43.6) & (F.greatest("lon1", "lon2") >= -116.9) & (F.least("lon1", "lon2") <= -116.3)
    closed = mvum(spark, sf_dir).where(near & ~access).orderBy("ogc_fid").limit(500)
    return buffered(closed, 15.0).select("ogc_fid", F.size("ring").alias("vertices"), "ring")
