"""Queries of the per-user contact store."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contacts as ops
from .fixtures import view
from .registry import query

C = F.col


def contacts(spark, sf_dir):
    return view(spark, sf_dir, "fx_contacts")


@query("filter_contacts", "SELECT user_id, id, label FROM fx_contacts WHERE user_id IN (SELECT 'u' || (qid % 25)::VARCHAR FROM fx_probe) AND deleted_at IS NULL AND category = 'BUILDING' AND (label ILIKE '%00001%' OR phone ILIKE '%P1%' OR category ILIKE '%xyz%')")
def filter_contacts(spark, sf_dir):
    users = view(spark, sf_dir, "fx_probe").select(F.concat(F.lit("u"), (C("qid") % 25).cast("string")).alias("user_id"))
    return ops.listed(contacts(spark, sf_dir), users, "BUILDING", [("00001", ["label", "category"]), ("P1", ["phone"])]).select("user_id", "id", "label")


@query("filter_deleted", "SELECT id, user_id, deleted_at FROM fx_contacts WHERE deleted_at IS NOT NULL")
def filter_deleted(spark, sf_dir):
    return contacts(spark, sf_dir).where("deleted_at is not null").select("id", "user_id", "deleted_at").orderBy(F.desc("deleted_at"), "id")


@query("lookup_contact", "SELECT c.id, c.label, c.deleted_at IS NULL AS live FROM fx_contacts c JOIN fx_probe q ON c.id = q.qid * 3 AND c.user_id = 'u' || (q.qid % 25)::VARCHAR")
def lookup_contact(spark, sf_dir):
    asked = view(spark, sf_dir, "fx_probe").select((C("qid") * 3).alias("id"), F.concat(F.lit("u"), (C("qid") % 25).cast("string")).alias("user_id"))
    return contacts(spark, sf_dir).join(asked, ["id", "user_id"]).select("id", "label", C("deleted_at").isNull().alias("live"))


@query("sort_contacts", "SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY label, id)::INTEGER AS place FROM fx_contacts WHERE deleted_at IS NULL")
def sort_contacts(spark, sf_dir):
    from pyspark.sql.window import Window

    return ops.live(contacts(spark, sf_dir)).select("user_id", "id", F.row_number().over(Window.partitionBy("user_id").orderBy("label", "id")).alias("place"))


@query("contact_substring_fe", "SELECT id FROM fx_contacts WHERE contains(lower(label), 'work') OR contains(lower(category), 'mach') OR contains(phone, 'p9')")
def contact_substring_fe(spark, sf_dir):
    return contacts(spark, sf_dir).where(F.contains(F.lower("label"), F.lit("work")) | F.contains(F.lower("category"), F.lit("mach")) | F.contains(C("phone"), F.lit("p9"))).select("id")


NEW = "SELECT 1000000 + s_suppkey AS id, 'u' || (s_suppkey % 25)::VARCHAR AS user_id, CASE s_suppkey % 3 WHEN 0 THEN 'Home' WHEN 1 THEN 'Work' ELSE s_name END AS label FROM supplier"


@query("insert_contact", f"SELECT n.id, n.user_id, n.label, CASE WHEN n.label IN ('Home', 'Work') AND (row_number() OVER (PARTITION BY n.user_id, n.label ORDER BY n.id) > 1 OR EXISTS (SELECT 1 FROM fx_contacts c WHERE c.deleted_at IS NULL AND c.user_id = n.user_id AND c.label = n.label)) THEN 'conflict' END AS error FROM ({NEW}) n")
def insert_contact(spark, sf_dir):
    k = C("s_suppkey")
    new = spark.read.parquet(f"{sf_dir}/supplier.parquet").select((1000000 + k).alias("id"), F.concat(F.lit("u"), (k % 25).cast("string")).alias("user_id"), F.when(k % 3 == 0, "Home").when(k % 3 == 1, "Work").otherwise(C("s_name")).alias("label"))
    return ops.checked_inserts(contacts(spark, sf_dir), new)


@query("update_contact", "SELECT c.id, CASE WHEN q.qid IS NOT NULL AND c.deleted_at IS NULL THEN 'patched' ELSE c.category END AS category, CASE WHEN q.qid IS NOT NULL AND c.deleted_at IS NULL THEN '2024-06-01T00:00:00Z' END AS updated_at FROM fx_contacts c LEFT JOIN fx_probe q ON c.id = q.qid * 2")
def update_contact(spark, sf_dir):
    patch = view(spark, sf_dir, "fx_probe").select((C("qid") * 2).alias("id"), F.lit("patched").alias("category"))
    return ops.patched(contacts(spark, sf_dir), patch, ["category"], "2024-06-01T00:00:00Z").select("id", "category", "updated_at")


@query(
    "soft_delete",
    """SELECT c.id, CASE q.act WHEN 0 THEN coalesce(c.deleted_at, '2024-06-01T00:00:00Z') WHEN 1 THEN CASE WHEN c.deleted_at IS NOT NULL AND c.label IN ('Home','Work') AND l.label IS NOT NULL THEN c.deleted_at END ELSE c.deleted_at END AS deleted_at,
    CASE WHEN q.act = 1 AND c.deleted_at IS NOT NULL AND c.label IN ('Home','Work') AND l.label IS NOT NULL THEN 'conflict' END AS error
    FROM fx_contacts c LEFT JOIN (SELECT qid*5 AS id, qid % 3 AS act FROM fx_probe) q USING (id) LEFT JOIN (SELECT DISTINCT user_id, label FROM fx_contacts WHERE deleted_at IS NULL) l ON l.user_id = c.user_id AND l.label = c.label WHERE NOT coalesce(q.act = 2 AND c.deleted_at IS NOT NULL, false)""",
)
def soft_delete(spark, sf_dir):
    act = F.element_at(F.array(F.lit("delete"), F.lit("restore"), F.lit("purge")), (C("qid") % 3 + 1).cast("int"))
    actions = view(spark, sf_dir, "fx_probe").select((C("qid") * 5).alias("id"), act.alias("act"))
    return ops.apply_actions(contacts(spark, sf_dir), actions, "2024-06-01T00:00:00Z").select("id", "deleted_at", "error")


@query("agg_count_by_user", "SELECT user_id, count(*)::BIGINT AS contacts, count(*) FILTER (show_proximity)::BIGINT AS nearby FROM fx_contacts WHERE deleted_at IS NULL GROUP BY user_id")
def agg_count_by_user(spark, sf_dir):
    return ops.live(contacts(spark, sf_dir)).groupBy("user_id").agg(F.count("*").alias("contacts"), F.count_if("show_proximity").alias("nearby"))


@query("find_nearby", "SELECT qid, id, round(m, 1) AS metres FROM (SELECT q.qid, c.id, 2*6371000.0e0*asin(sqrt(pow(sin(radians(q.lat-c.lat)/2),2)+cos(radians(c.lat))*cos(radians(q.lat))*pow(sin(radians(q.lon-c.lon)/2),2))) AS m FROM fx_contacts c JOIN fx_probe q ON abs(c.lat-q.lat) < 0.02e0 AND abs(c.lon-q.lon) < 0.03e0 WHERE c.deleted_at IS NULL AND c.show_proximity) WHERE m <= 1500")
def find_nearby(spark, sf_dir):
    from ..operators.spatial import pairs_within

    shown = ops.live(contacts(spark, sf_dir)).where("show_proximity").select("id", "lat", "lon")
    return pairs_within(shown, view(spark, sf_dir, "fx_probe"), 1500.0, 1).select("qid", "id", "metres")
