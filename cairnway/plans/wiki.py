"""Queries of wiki links."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import wiki
from .fixtures import view
from .registry import query

C = F.col
LINKS = """SELECT pid, CASE pid % 4 WHEN 0 THEN 'wikipedia' WHEN 1 THEN 'wikidata' WHEN 2 THEN 'wikivoyage' ELSE 'appropedia' END AS tag,
  CASE pid % 12 WHEN 0 THEN 'en:Boise River' || n WHEN 4 THEN 'https://en.wikipedia.org/wiki/Boise%20Creek' || n WHEN 8 THEN 'Plain Title' WHEN 1 THEN 'Q' || n WHEN 5 THEN 'https://www.wikidata.org/wiki/Q' || n WHEN 9 THEN 'bad' || n
  WHEN 2 THEN 'https://en.wikivoyage.org/wiki/Idaho_' || n WHEN 6 THEN 'en:Sun Valley' WHEN 10 THEN '' WHEN 3 THEN 'https://www.appropedia.org/wiki/Solar+' || n WHEN 7 THEN 'Water tank' ELSE 'https://appropedia.org/Pump_' || n END AS value FROM (SELECT pid, (pid % 40){cast} AS n FROM fx_points)"""
SQL_LINKS = LINKS.replace("{cast}", "::VARCHAR")
ARTICLE = """SELECT pid, tag, value, CASE WHEN trim(value) = '' THEN NULL WHEN tag = 'wikidata' THEN nullif(coalesce(nullif(regexp_extract(value, '^(Q\\d+)$', 1), ''), regexp_extract(value, '^https?://(?:www\\.)?wikidata\\.org/wiki/(Q\\d+)', 1)), '')
  WHEN tag = 'wikipedia' THEN replace(coalesce(nullif(url_decode(replace(regexp_extract(value, '^https?://en\\.wikipedia\\.org/wiki/(.+)', 1), '+', '%2B')), ''), regexp_extract(value, '^(?:en:)?(.+)$', 1)), ' ', '_')
  WHEN tag = 'wikivoyage' THEN replace(coalesce(nullif(url_decode(replace(regexp_extract(value, '^https?://en\\.wikivoyage\\.org/wiki/(.+)', 1), '+', '%2B')), ''), regexp_extract(value, '^(?:en:)?(.+)$', 1)), ' ', '_')
  ELSE replace(coalesce(nullif(url_decode(replace(regexp_extract(value, '^https?://(?:www\\.)?appropedia\\.org/(?:wiki/)?(.+)', 1), '+', '%2B')), ''), value), ' ', '_') END AS article FROM ({links})""".replace("{links}", SQL_LINKS)
PUBLIC = "CASE tag WHEN 'wikipedia' THEN 'https://en.wikipedia.org/wiki/' WHEN 'wikidata' THEN 'https://www.wikidata.org/wiki/' WHEN 'wikivoyage' THEN 'https://en.wikivoyage.org/wiki/' ELSE 'https://www.appropedia.org/' END"


def links(spark, sf_dir):
    points = view(spark, sf_dir, "fx_points").select("pid", (C("pid") % 40).cast("string").alias("n"))
    tag = F.when(C("pid") % 4 == 0, "wikipedia").when(C("pid") % 4 == 1, "wikidata").when(C("pid") % 4 == 2, "wikivoyage").otherwise("appropedia")
    made = {0: ("en:Boise River", 1), 4: ("https://en.wikipedia.org/wiki/Boise%20Creek", 1), 8: ("Plain Title", 0), 1: ("Q", 1), 5: ("https://www.wikidata.org/wiki/Q", 1), 9: ("bad", 1), 2: ("https://en.wikivoyage.org/wiki/Idaho_", 1), 6: ("en:Sun Valley", 0), 10: ("", 0), 3: ("https://www.appropedia.org/wiki/Solar+", 1), 7: ("Water tank", 0), 11: ("https://appropedia.org/Pump_", 1)}
    value = F.lit(None).cast("string")
    for k, (head, numbered) in made.items():
        value = F.when(C("pid") % 12 == k, F.concat(F.lit(head), C("n")) if numbered else F.lit(head)).otherwise(value)
    return points.select("pid", tag.alias("tag"), value.alias("value"))


def cache(spark, sf_dir):
    """Articles known to be at hand: the even-numbered entities."""
    return view(spark, sf_dir, "fx_points").where("pid % 2 = 0").select(F.lit("wikidata").alias("source_type"), F.concat(F.lit("Q"), (C("pid") % 40).cast("string")).alias("article_id")).distinct()


CACHE = "SELECT DISTINCT 'wikidata' AS source_type, 'Q' || (pid % 40)::VARCHAR AS article_id FROM fx_points WHERE pid % 2 = 0"


@query("fn_classify_wiki", f"SELECT pid, CASE WHEN article IS NOT NULL THEN tag END AS source, article FROM ({ARTICLE})")
def fn_classify_wiki(spark, sf_dir):
    link = wiki.classify(C("tag"), C("value"))
    return links(spark, sf_dir).select("pid", link["source"].alias("source"), link["article"].alias("article"))


@query("fn_wiki_url", f"SELECT pid, {PUBLIC} || article AS url FROM ({ARTICLE}) WHERE article IS NOT NULL")
def fn_wiki_url(spark, sf_dir):
    link = wiki.classify(C("tag"), C("value"))
    known = links(spark, sf_dir).select("pid", link.alias("l")).where("l is not null")
    public = F.create_map(*[F.lit(x) for kv in wiki.PUBLIC.items() for x in kv])
    return known.select("pid", F.concat(F.try_element_at(public, C("l.source")), wiki.quote(C("l.article"))).alias("url"))


REWRITE = f"SELECT a.pid, a.tag, CASE WHEN c.article_id IS NOT NULL THEN '/wiki/' || tag || '/' || article WHEN article IS NOT NULL THEN {PUBLIC} || article ELSE value END AS url, CASE WHEN c.article_id IS NOT NULL THEN 'local' WHEN article IS NOT NULL THEN 'public' ELSE 'original' END AS status FROM ({ARTICLE}) a LEFT JOIN ({CACHE}) c ON c.source_type = a.tag AND c.article_id = a.article"


@query("fn_rewrite_wiki", REWRITE)
def fn_rewrite_wiki(spark, sf_dir):
    return wiki.rewrite(links(spark, sf_dir), cache(spark, sf_dir), "/wiki/").select("pid", "tag", "url", "status")


@query("enrich_wiki_links", f"SELECT tag, status, count(*)::BIGINT AS n FROM ({REWRITE}) WHERE status <> 'original' GROUP BY ALL")
def enrich_wiki_links(spark, sf_dir):
    return wiki.rewrite(links(spark, sf_dir), cache(spark, sf_dir), "/wiki/").where("status <> 'original'").groupBy("tag", "status").agg(F.count("*").alias("n"))


@query("fn_discover_wikivoyage", f"SELECT p.p_partkey, '/wiki/wikivoyage/' || replace(p_brand, '#', '%23') AS url FROM part p JOIN (SELECT DISTINCT p_brand AS b FROM part WHERE p_size % 10 = 0 AND p_brand LIKE '%1') c ON p_brand = b")
def fn_discover_wikivoyage(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand", "p_size")
    at_hand = parts.where("p_size % 10 = 0 and p_brand like '%1'").select("p_brand").distinct()
    return parts.join(at_hand, "p_brand", "left_semi").select("p_partkey", F.concat(F.lit("/wiki/wikivoyage/"), wiki.quote(C("p_brand"))).alias("url"))


@query("fn_wiki_fields", "SELECT pid, 'https://en.wikipedia.org/wiki/' || 'Place_' || (pid % 90)::VARCHAR AS wikipedia_url, TRY_CAST(CASE pid % 3 WHEN 0 THEN (pid*13)::VARCHAR WHEN 1 THEN 'many' END AS BIGINT) AS population FROM fx_points")
def fn_wiki_fields(spark, sf_dir):
    title = F.concat(F.lit("Place "), (C("pid") % 90).cast("string"))
    population = F.when(C("pid") % 3 == 0, (C("pid") * 13).cast("string")).when(C("pid") % 3 == 1, "many")
    return view(spark, sf_dir, "fx_points").select("pid", F.concat(F.lit(wiki.PUBLIC["wikipedia"]), F.replace(title, F.lit(" "), F.lit("_"))).alias("wikipedia_url"), population.try_cast("long").alias("population"))


@query("fn_wiki_links_fe", f"SELECT pid, url, status = 'local' AS local FROM ({REWRITE}) WHERE tag = 'wikidata'")
def fn_wiki_links_fe(spark, sf_dir):
    return wiki.rewrite(links(spark, sf_dir), cache(spark, sf_dir), "/wiki/").where("tag = 'wikidata'").select("pid", "url", (C("status") == "local").alias("local"))


@query("cache_positive_only", "SELECT source_type, article_id, max(seen)::BIGINT AS cached_at FROM (SELECT 'wikipedia' AS source_type, 'A' || (event_id % 300)::VARCHAR AS article_id, event_id AS seen, CASE event_id % 4 WHEN 0 THEN 404 WHEN 1 THEN 500 ELSE 200 END AS code FROM events) WHERE code = 200 GROUP BY ALL")
def cache_positive_only(spark, sf_dir):
    from ..operators.upsert import latest

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    code = F.when(C("event_id") % 4 == 0, 404).when(C("event_id") % 4 == 1, 500).otherwise(200)
    probes = events.select(F.lit("wikipedia").alias("source_type"), F.concat(F.lit("A"), (C("event_id") % 300).cast("string")).alias("article_id"), C("event_id").alias("cached_at"), code.alias("code"))
    return latest(probes.where("code = 200"), ["source_type", "article_id"], "cached_at").select("source_type", "article_id", "cached_at")


@query("join_source_fallback", "SELECT p.pid, coalesce(a.nm, b.nm) AS name FROM fx_points p LEFT JOIN (SELECT n_nationkey AS k, n_name AS nm FROM nation WHERE n_nationkey % 2 = 0) a ON p.pid % 40 = a.k LEFT JOIN (SELECT n_regionkey AS rk, min(n_name) AS nm FROM nation GROUP BY 1) b ON p.pid % 7 = b.rk")
def join_source_fallback(spark, sf_dir):
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    by_id = nations.where("n_nationkey % 2 = 0").select(C("n_nationkey").cast("long").alias("k"), C("n_name").alias("first"))
    by_region = nations.groupBy(C("n_regionkey").cast("long").alias("rk")).agg(F.min("n_name").alias("second"))
    points = view(spark, sf_dir, "fx_points")
    return points.join(by_id, C("pid") % 40 == C("k"), "left").join(by_region, C("pid") % 7 == C("rk"), "left").select("pid", F.coalesce("first", "second").alias("name"))


@query("enrich_wiki_index", "SELECT p.pid, n.n_name AS name, CASE WHEN n.n_nationkey % 3 <> 0 THEN n.n_nationkey * 1000 END::BIGINT AS population FROM fx_points p LEFT JOIN nation n ON TRY_CAST(regexp_extract('https://www.wikidata.org/wiki/Q' || (p.pid % 50)::VARCHAR, 'Q(\\d+)$', 1) AS BIGINT) = n.n_nationkey")
def enrich_wiki_index(spark, sf_dir):
    url = F.concat(F.lit("https://www.wikidata.org/wiki/Q"), (C("pid") % 50).cast("string"))
    k = C("n_nationkey").cast("long")
    index = spark.read.parquet(f"{sf_dir}/nation.parquet").select(k.alias("entity"), C("n_name").alias("name"), F.when(k % 3 != 0, k * 1000).alias("population"))
    points = view(spark, sf_dir, "fx_points").select("pid", F.regexp_extract(url, r"Q(\d+)$", 1).try_cast("long").alias("entity"))
    return points.join(index, "entity", "left").select("pid", "name", "population")
