"""Queries of aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from .fixtures import view
from .registry import query

C = F.col


@query("agg_count_by_class", "SELECT highway_class, count(*)::BIGINT AS n FROM fx_entry_points GROUP BY highway_class")
def agg_count_by_class(spark, sf_dir):
    return view(spark, sf_dir, "fx_entry_points").groupBy("highway_class").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "highway_class")


@query("agg_count_by_type", "SELECT access, count(*)::BIGINT AS n FROM fx_parking GROUP BY access")
def agg_count_by_type(spark, sf_dir):
    return view(spark, sf_dir, "fx_parking").groupBy("access").agg(F.count("*").alias("n"))


@query("agg_outcome_counters", "SELECT CASE WHEN atv IS NULL THEN 'skipped_no_status' WHEN symbol IS NULL THEN 'skipped_no_symbol' WHEN atv_datesopen = 'bad' THEN 'skipped_bad_dates' ELSE 'updated' END AS outcome, count(*)::BIGINT AS n FROM fx_mvum GROUP BY 1")
def agg_outcome_counters(spark, sf_dir):
    outcome = F.when(C("atv").isNull(), "skipped_no_status").when(C("symbol").isNull(), "skipped_no_symbol").when(C("atv_datesopen") == "bad", "skipped_bad_dates").otherwise("updated")
    return view(spark, sf_dir, "fx_mvum").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("agg_collect_set", "SELECT user_id, substr(label, 1, 4) AS prefix, list_sort(list(DISTINCT category)) AS categories FROM fx_contacts GROUP BY 1, 2")
def agg_collect_set(spark, sf_dir):
    return view(spark, sf_dir, "fx_contacts").groupBy("user_id", F.substring("label", 1, 4).alias("prefix")).agg(F.array_sort(F.collect_set("category")).alias("categories"))


@query("agg_distinct_dedupe", "SELECT lat5, lon5, min(id) AS id FROM (SELECT id, round(lat, 1) AS lat5, round(lon, 1) AS lon5 FROM fx_entry_points) GROUP BY 1, 2")
def agg_distinct_dedupe(spark, sf_dir):
    rounded = view(spark, sf_dir, "fx_entry_points").select("id", F.round("lat", 1).alias("lat5"), F.round("lon", 1).alias("lon5"))
    return rounded.groupBy("lat5", "lon5").agg(F.min("id").alias("id"))


@query("agg_linemerge")
def agg_linemerge(spark, sf_dir):
    """Lines of a group merged at ends that exactly two of them share."""
    from ..operators.merge_lines import merged

    corner = lambda a, b: F.struct(F.round(C(a), 2).alias("lat"), F.round(C(b), 2).alias("lon"))
    lines = view(spark, sf_dir, "fx_mvum").select((C("ogc_fid") % 50).alias("grp"), "ogc_fid", F.array(corner("lat1", "lon1"), corner("lat2", "lon2")).alias("line"))
    return merged(lines, "grp")


@query("join_learn_map", "SELECT m.symbol, list_sort(list(DISTINCT c.category)) AS categories FROM fx_mvum m JOIN fx_contacts c ON c.id = m.ogc_fid WHERE m.symbol IS NOT NULL GROUP BY m.symbol")
def join_learn_map(spark, sf_dir):
    known = view(spark, sf_dir, "fx_mvum").where("symbol is not null").select(C("ogc_fid").alias("id"), "symbol")
    return known.join(view(spark, sf_dir, "fx_contacts").select("id", "category"), "id").groupBy("symbol").agg(F.array_sort(F.collect_set("category")).alias("categories"))


@query("join_multikey_hash", "SELECT p.p_partkey, coalesce(a.d, b.d) AS donor FROM part p LEFT JOIN (SELECT p_brand, p_type, p_size, min(p_partkey) AS d FROM part WHERE p_partkey % 3 = 0 GROUP BY 1, 2, 3) a ON a.p_brand = p.p_brand AND a.p_type = p.p_type AND a.p_size = p.p_size LEFT JOIN (SELECT p_brand, p_type, min(p_partkey) AS d FROM part WHERE p_partkey % 3 = 0 GROUP BY 1, 2) b ON b.p_brand = p.p_brand AND b.p_type = p.p_type")
def join_multikey_hash(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand", "p_type", "p_size")
    donors = parts.where("p_partkey % 3 = 0")
    close = donors.groupBy("p_brand", "p_type", "p_size").agg(F.min("p_partkey").alias("first"))
    loose = close.groupBy("p_brand", "p_type").agg(F.min("first").alias("second"))
    return parts.join(close, ["p_brand", "p_type", "p_size"], "left").join(loose, ["p_brand", "p_type"], "left").select("p_partkey", F.coalesce("first", "second").alias("donor"))
