"""Queries of geocoding: parsing, retrieval, scoring, ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import geocoding, retrieval
from .fixtures import view
from .geodesy import sql_haversine
from .registry import query
from .text import expand_sql

C = F.col
STATE_CODES = ", ".join(f"'{s}'" for s in text.STATES)
NAMES = ", ".join(f"'{n}'" for n in text.STATES.values() if n)
ROADS = ", ".join(f"'{w}'" for w in text.ROAD_WORDS)
FREE = "SELECT aid, CASE aid % 5 WHEN 0 THEN number || ' ' || street || ', ' || city || ' ID ' || zipcode WHEN 1 THEN city || ' Idaho' WHEN 2 THEN zipcode WHEN 3 THEN '43.5, -116.2' ELSE city || ' cafe' END AS q FROM fx_addresses"


def free_queries(spark, sf_dir):
    a = view(spark, sf_dir, "fx_addresses")
    m = C("aid") % 5
    q = F.when(m == 0, F.concat(C("number"), F.lit(" "), C("street"), F.lit(", "), C("city"), F.lit(" ID "), C("zipcode"))).when(m == 1, F.concat(C("city"), F.lit(" Idaho"))).when(m == 2, C("zipcode")).when(m == 3, "43.5, -116.2").otherwise(F.concat(C("city"), F.lit(" cafe")))
    return a.select("aid", q.alias("q"))


@query(
    "fn_intent",
    f"""WITH t AS (SELECT aid, q, list_filter(regexp_split_to_array(replace(q, ',', ' '), '\\s+'), lambda x: x <> '') AS w FROM ({FREE}))
    SELECT aid, CASE WHEN regexp_full_match(q, '\\s*-?\\d+\\.?\\d*\\s*[,\\s]\\s*-?\\d+\\.?\\d*\\s*') AND abs(w[1]::DOUBLE) <= 90 AND abs(w[2]::DOUBLE) <= 180 THEN 'COORD' WHEN regexp_matches(w[1], '^\\d') AND len(w) > 1 THEN 'ADDRESS'
    WHEN len(w) = 1 AND regexp_full_match(q, '\\d{{5}}') THEN 'POSTCODE' WHEN len(w) >= 2 AND (upper(w[-1]) IN ({STATE_CODES}) OR lower(w[-1]) IN ({NAMES}) OR len(w) >= 3 AND lower(w[-2] || ' ' || w[-1]) IN ({NAMES})) THEN 'LOCALITY' ELSE 'UNKNOWN' END AS intent FROM t""",
)
def fn_intent(spark, sf_dir):
    return geocoding.classify(free_queries(spark, sf_dir), "q").select("aid", "intent")


@query(
    "parse_free_address",
    f"""WITH t AS (SELECT aid, regexp_extract(q, '\\b(\\d{{5}})\\s*$', 1) AS zip, list_filter(regexp_split_to_array(regexp_replace(q, '\\b\\d{{5}}\\s*$', ''), '[,\\s]+'), lambda x: x <> '') AS w FROM ({FREE})),
    s AS (SELECT aid, zip, CASE WHEN len(w) >= 2 AND upper(w[-1]) IN ({STATE_CODES}) THEN upper(w[-1]) END AS state, w FROM t),
    u AS (SELECT aid, zip, state, CASE WHEN state IS NOT NULL THEN w[:-2] ELSE w END AS w FROM s),
    n AS (SELECT aid, zip, state, CASE WHEN len(w) > 0 AND regexp_matches(w[1], '^\\d') THEN w[1] END AS number, w FROM u),
    m AS (SELECT aid, zip, state, number, CASE WHEN number IS NOT NULL THEN w[2:] ELSE w END AS w FROM n)
    SELECT aid, nullif(zip, '') AS zipcode, state, number, CASE WHEN state IS NOT NULL AND len(w) >= 2 THEN w[-1] END AS city, nullif(array_to_string(CASE WHEN state IS NOT NULL AND len(w) >= 2 THEN w[:-2] ELSE w END, ' '), '') AS street FROM m""",
)
def parse_free_address(spark, sf_dir):
    return geocoding.parse_free(free_queries(spark, sf_dir), "q").select("aid", "zipcode", "state", "number", "city", "street")


@query("fn_tag_address")
def fn_tag_address(spark, sf_dir):
    """Address components by rule: number, direction, street, type, city, state, zip code."""
    return geocoding.classify(free_queries(spark, sf_dir), "q")


@query("fn_fix_directional")
def fn_fix_directional(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_addresses").select("aid", F.concat(C("number"), F.lit(" N St "), F.initcap("city")).alias("q"))
    return geocoding.fix_directional(rows, "q").select("aid", "number", "street", "city")


@query("filter_address_exact", "SELECT q.qid, a.aid FROM fx_queries q JOIN fx_addresses a ON upper(trim(q.number)) = a.number AND upper(trim(q.street)) = a.street AND (q.city IS NULL OR upper(q.city) = a.city) AND (q.state IS NULL OR q.state = a.state) AND (q.zipcode IS NULL OR q.zipcode = a.zipcode) QUALIFY row_number() OVER (PARTITION BY q.qid ORDER BY a.aid) <= 5")
def filter_address_exact(spark, sf_dir):
    return geocoding.exact_addresses(view(spark, sf_dir, "fx_queries"), view(spark, sf_dir, "fx_addresses"), 5).select("qid", "aid")


@query("filter_zip", "SELECT q.qid, a.aid FROM fx_queries q JOIN fx_addresses a ON q.zipcode = a.zipcode QUALIFY row_number() OVER (PARTITION BY q.qid ORDER BY a.aid) <= 20")
def filter_zip(spark, sf_dir):
    return geocoding.by_zip(view(spark, sf_dir, "fx_queries"), view(spark, sf_dir, "fx_addresses"), 20).select("qid", "aid")


#: Queries of fx_queries as texts and components, both ways.
PARSED = "SELECT qid, 'ADDRESS' AS intent, number || ' ' || street || coalesce(', ' || city, '') || coalesce(' ' || state, '') || coalesce(' ' || zipcode, '') AS q, number AS qn, street AS qs, city AS qc, state AS qst, zipcode AS qz, lat AS qlat, lon AS qlon FROM fx_queries"
SKIPPED = ", ".join(f"'{w}'" for w in retrieval.SKIPPED)


def words_sql(x: str) -> str:
    return f"list_distinct(list_filter(string_split({expand_sql(x)}, ' '), lambda t: t <> '' AND t NOT IN ({SKIPPED})))"


def one_out_sql(x: str) -> str:
    return f"list_prepend({x}, list_transform(range(1, length({x}) + 1), lambda i: left({x}, i - 1) || substr({x}, i + 1)))"


#: Every word of a query against every word of the index, and every feature: what retrieval finds without its index.
FREE_TEXT = f"""asked AS ({PARSED}),
    f AS (SELECT fid, {words_sql("concat_ws(' ', name, housenumber, street, city, state, osm_value)")} AS words, lat, lon FROM fx_features),
    post AS (SELECT fid, unnest(words) AS word FROM f),
    vocab AS (SELECT word AS found, ln(1.0e0 + (SELECT count(*) FROM f)::DOUBLE / count(*)) AS idf FROM post GROUP BY word),
    qw AS (SELECT qid, unnest({words_sql("q")}) AS word FROM asked),
    hits AS (SELECT word, found, idf * CASE WHEN word = found THEN 1.0e0 WHEN length(word) >= 3 AND starts_with(found, word) AND NOT regexp_full_match(found, '[0-9]+') THEN 0.8e0 ELSE 0.6e0 END AS worth FROM (SELECT DISTINCT word FROM qw), vocab
      WHERE word = found OR (length(word) >= 3 AND starts_with(found, word) AND NOT regexp_full_match(found, '[0-9]+'))
      OR (length(word) >= 4 AND length(found) >= 4 AND NOT regexp_matches(word || found, '[0-9]') AND list_has_any({one_out_sql("word")}, {one_out_sql("found")}))),
    per AS (SELECT qid, fid, qw.word, max(worth) AS worth FROM qw JOIN hits ON qw.word = hits.word JOIN post ON post.word = found GROUP BY ALL),
    sizes AS (SELECT qid, count(*) AS n FROM qw GROUP BY qid),
    matched AS (SELECT per.qid, fid, sum(worth) AS worth FROM per JOIN sizes USING (qid) GROUP BY per.qid, fid, n HAVING count(*) >= n - n // 4),
    free_text AS (SELECT qid, fid, relevance, row_number() OVER (PARTITION BY qid ORDER BY relevance DESC, fid) - 1 AS position FROM (
      SELECT m.qid, m.fid, round(worth * (1 + 0.5e0 * coalesce(exp(-{sql_haversine("f.lat", "f.lon", "qlat", "qlon")} / 1000 / 64), 0)), 6) AS relevance FROM matched m JOIN f USING (fid) JOIN asked USING (qid)) QUALIFY position < 10)"""
FOUND = f"""{FREE_TEXT},
    street AS (SELECT qid, fid, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN housenumber = qn THEN 0 ELSE 1 END, abs(housenumber::INTEGER - qn::INTEGER) NULLS LAST, fid) - 1 AS position FROM asked JOIN fx_features
      ON {expand_sql("qs")} = {expand_sql("street")} AND (qc IS NULL OR upper(trim(qc)) = upper(city)) AND (qst IS NULL OR upper(trim(qst)) = state) QUALIFY position < 5),
    exact AS (SELECT qid, aid, row_number() OVER (PARTITION BY qid ORDER BY (lat - qlat) * (lat - qlat) + (lon - qlon) * (lon - qlon), aid) - 1 AS position FROM asked JOIN fx_addresses ON upper(trim(qn)) = number AND upper(trim(qs)) = street
      AND (qc IS NULL OR upper(qc) = city) AND (qst IS NULL OR qst = state) AND (qz IS NULL OR qz = zipcode) QUALIFY position < 10),
    found AS (
      SELECT qid, 'addresses' AS source, aid AS id, concat_ws(' ', number, street, city, state, zipcode) AS name, 'street_address' AS type, NULL AS osm_key, number, street, city, state, lat, lon, NULL AS rank, 1 AS source_order, position FROM exact JOIN fx_addresses USING (aid)
      UNION ALL SELECT qid, 'features', fid, array_to_string(list_filter([CASE WHEN housenumber IS NOT NULL THEN housenumber || ' ' || street ELSE coalesce(name, street) END, city, state, country], lambda x: x IS NOT NULL), ', '),
        CASE WHEN osm_key IN ('amenity', 'shop') THEN 'poi' WHEN housenumber IS NOT NULL OR osm_value = 'residential' THEN 'street_address' WHEN type = 'hamlet' THEN 'locality' ELSE 'poi' END,
        osm_key, housenumber, street, CASE WHEN city IS NULL AND type = 'hamlet' THEN name ELSE city END, state, lat, lon, position, source_order, position
      FROM (SELECT qid, fid, position, 2 AS source_order FROM free_text UNION ALL SELECT qid, fid, position, 3 FROM street) JOIN fx_features USING (fid)),
    pairs AS (SELECT * FROM found JOIN asked USING (qid))"""
TYPES_LIST = ", ".join(f"'{t}'" for t in sorted(set(text.STREET_TYPES.values())))
SCORE = f"""{FOUND},
    scored AS (SELECT *, CASE WHEN upper(number) = upper(trim(qn)) THEN 6.0e0 WHEN number IS NOT NULL THEN -5.0e0 ELSE 0 END
      + CASE WHEN list_has_any(list_intersect(string_split({expand_sql("qs")}, ' '), [{TYPES_LIST}]), string_split({expand_sql("street")}, ' ')) THEN 1.5e0 ELSE 0 END
      + 2.0e0 * len(list_filter(w, lambda t: contains(upper(name), t))) / len(w)::DOUBLE + CASE WHEN upper(qst) = state THEN 1.0e0 ELSE 0 END + CASE WHEN source = 'addresses' THEN 2.0e0 ELSE 0 END + CASE WHEN type = 'street_address' THEN 1.0e0 ELSE 0 END
      + CASE WHEN rank IS NULL THEN 0 ELSE greatest(0.0e0, 1.0e0 - rank / 10.0e0) END
      + CASE WHEN list_has_any(list_transform(w, lambda t: lower(t)), [{ROADS}]) THEN 0 WHEN osm_key IN ('amenity', 'shop') THEN 3.0e0 WHEN osm_key = 'highway' THEN -4.0e0 ELSE 0 END AS score
    FROM (SELECT *, list_distinct(list_filter(regexp_split_to_array(replace(upper(q), ',', ' '), '\\s+'), lambda t: t <> '')) AS w FROM pairs))"""


def parsed_queries(spark, sf_dir):
    q = view(spark, sf_dir, "fx_queries")
    shown = F.concat(C("number"), F.lit(" "), C("street"), *[F.coalesce(F.concat(F.lit(mark), C(c)), F.lit("")) for mark, c in ((", ", "city"), (" ", "state"), (" ", "zipcode"))])
    return q.select("*", shown.alias("q"), F.lit("ADDRESS").alias("intent"), F.lit(None).cast("int").alias("zoom"))


def retrieved(spark, sf_dir):
    return geocoding.candidates(parsed_queries(spark, sf_dir), view(spark, sf_dir, "fx_addresses"), view(spark, sf_dir, "fx_features"), 10)


def scored(spark, sf_dir):
    """Query and candidate pairs with every signal that needs no fuzzy match, and their sum."""
    return geocoding.score(retrieved(spark, sf_dir), fuzzy=False)


@query("retrieve_free_text", f"WITH {FREE_TEXT} SELECT qid, fid, relevance, position::INTEGER AS position FROM free_text")
def retrieve_free_text(spark, sf_dir):
    """What the index finds equals what every word against every feature finds."""
    index = retrieval.Index.of(view(spark, sf_dir, "fx_features"))
    return retrieval.free_text(parsed_queries(spark, sf_dir), index, 10).select("qid", "fid", "relevance", "position")


@query("fn_score", f"WITH {SCORE} SELECT qid, source, id, source_order, round(score, 2) AS score FROM scored")
def fn_score(spark, sf_dir):
    return scored(spark, sf_dir).select("qid", "source", "id", "source_order", F.round("score", 2).alias("score"))


@query("win_rank_position", f"WITH {FOUND} SELECT qid, id, source_order, greatest(0.0e0, 1.0e0 - rank/10.0e0) AS position_score FROM found WHERE rank IS NOT NULL")
def win_rank_position(spark, sf_dir):
    return retrieved(spark, sf_dir).where("rank is not null").select("qid", "id", "source_order", F.greatest(F.lit(0.0), 1.0 - C("rank") / 10.0).alias("position_score"))


@query("topk_rerank", f"WITH {SCORE} SELECT qid, source, id, round(score, 2) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 2) DESC, source_order, position)::INTEGER AS place, CASE WHEN round(score, 2) >= 10 THEN 'exact' WHEN round(score, 2) >= 5 THEN 'high' WHEN round(score, 2) >= 2 THEN 'medium' ELSE 'low' END AS confidence FROM scored QUALIFY place <= 10")
def topk_rerank(spark, sf_dir):
    return geocoding.rerank(scored(spark, sf_dir), 10).select("qid", "source", "id", "score", "place", "confidence")


@query("geo_rank")
def geo_rank(spark, sf_dir):
    """The whole ranking, fuzzy street and city matches included."""
    return geocoding.rerank(geocoding.score(retrieved(spark, sf_dir), fuzzy=True), 10).select("qid", "source", "id", "score", "place", "confidence")


@query("geocode_full")
def geocode_full(spark, sf_dir):
    """From free text to ranked places: coordinates, parse, classify, retrieve, drop doubles within 50 m, score, rank, match codes."""
    asked = free_queries(spark, sf_dir).withColumnRenamed("aid", "qid")
    return geocoding.geocode(asked, view(spark, sf_dir, "fx_addresses"), view(spark, sf_dir, "fx_features"), 5)


@query("fn_match_code")
def fn_match_code(spark, sf_dir):
    return geocoding.match_code(retrieved(spark, sf_dir)).select("qid", "source", "id", "source_order", "match_number", "match_street", "match_city")


@query("set_overlap", f"SELECT aid, len(list_intersect(string_split({expand_sql('street')}, ' '), ['street', 'avenue', 'road'])) > 0 AS typed, len(list_intersect(string_split({expand_sql('street')}, ' '), ['avenue', 'lane'])) > 0 AS overlaps FROM fx_addresses")
def set_overlap(spark, sf_dir):
    words = F.split(text.expand_street(C("street")), " ")
    types = F.array(*[F.lit(t) for t in sorted(set(text.STREET_TYPES.values()))])
    return view(spark, sf_dir, "fx_addresses").select("aid", F.arrays_overlap(words, types).alias("typed"), F.arrays_overlap(words, F.array(F.lit("avenue"), F.lit("lane"))).alias("overlaps"))


@query("topk_viewport", "SELECT qid, aid, place FROM (SELECT q.qid, a.aid, row_number() OVER (PARTITION BY q.qid ORDER BY (a.lat-q.lat)*(a.lat-q.lat) + (a.lon-q.lon)*(a.lon-q.lon), a.aid)::INTEGER AS place FROM fx_queries q JOIN fx_addresses a ON upper(q.street) = a.street) WHERE place <= 10")
def topk_viewport(spark, sf_dir):
    from ..operators.spatial import nearest_planar

    q = view(spark, sf_dir, "fx_queries").select("qid", F.upper("street").alias("street"), "lat", "lon")
    found = nearest_planar(q, view(spark, sf_dir, "fx_addresses").select("aid", "street", "lat", "lon"), 10, ["aid"], ["street"])
    return found.select("qid", "aid", C("n").alias("place"))


@query("union_sources", "SELECT 1 AS source_order, qid, aid FROM (SELECT q.qid, a.aid FROM fx_queries q JOIN fx_addresses a ON q.number = a.number AND upper(q.street) = a.street) UNION ALL SELECT 2, q.qid, a.aid FROM fx_queries q JOIN fx_addresses a ON q.zipcode = a.zipcode AND q.number = a.number")
def union_sources(spark, sf_dir):
    q, a = view(spark, sf_dir, "fx_queries"), view(spark, sf_dir, "fx_addresses")
    first = q.select("qid", "number", F.upper("street").alias("street")).join(a.select("aid", "number", "street"), ["number", "street"])
    second = q.select("qid", "number", "zipcode").join(a.select("aid", "number", "zipcode"), ["number", "zipcode"])
    return first.select(F.lit(1).alias("source_order"), "qid", "aid").unionByName(second.select(F.lit(2).alias("source_order"), "qid", "aid"))


@query(
    "self_join_dedup50",
    f"""WITH {FOUND},
    lists AS (SELECT qid, list([{{'source': source, 'id': id, 'lat': lat, 'lon': lon}}] ORDER BY source_order, position) AS parts FROM found GROUP BY qid),
    kept AS (SELECT qid, list_reduce(parts, lambda s, c: CASE WHEN len(list_filter(s, lambda k: k.source = c[1].source AND {sql_haversine("k.lat", "k.lon", "c[1].lat", "c[1].lon")} < 50)) > 0 THEN s ELSE list_concat(s, c) END) AS k FROM lists)
    SELECT qid, k.source AS source, k.id AS id FROM (SELECT qid, unnest(k) AS k FROM kept)""",
)
def self_join_dedup50(spark, sf_dir):
    return geocoding.drop_close(retrieved(spark, sf_dir), 50.0).select("qid", "source", "id")


ALIASES = "SELECT n_nationkey AS entry, CAST(0 AS INTEGER) AS form_no, lower(n_name) AS form FROM nation UNION ALL SELECT n_nationkey, 1, lower(substr(n_name, 1, 3)) FROM nation"
ASKED = "SELECT c_custkey, lower(CASE c_custkey % 4 WHEN 0 THEN n_name WHEN 1 THEN n_name || ' office' WHEN 2 THEN substr(n_name, 1, 5) ELSE 'the ' || n_name || ' site' END) AS q FROM customer JOIN nation ON c_nationkey = n_nationkey"


@query(
    "fn_alias_match",
    f"""SELECT c_custkey, entry::BIGINT AS entry, CASE WHEN rule <= 2 THEN 'exact' ELSE 'partial' END AS confidence FROM (
    SELECT c_custkey, entry, form_no, CASE WHEN q = form THEN 1 WHEN starts_with(q, form || ' ') THEN 2 WHEN starts_with(form, q) THEN 3 WHEN contains(' ' || q || ' ', ' ' || form || ' ') THEN 4 END AS rule FROM ({ASKED}) CROSS JOIN ({ALIASES})) WHERE rule IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY least(rule, 3), entry, form_no) = 1""",
)
def fn_alias_match(spark, sf_dir):
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    book = nations.select(C("n_nationkey").alias("entry"), F.array(F.lower("n_name"), F.lower(F.substring("n_name", 1, 3))).alias("forms"))
    m = C("c_custkey") % 4
    q = F.when(m == 0, C("n_name")).when(m == 1, F.concat("n_name", F.lit(" office"))).when(m == 2, F.substring("n_name", 1, 5)).otherwise(F.concat(F.lit("the "), C("n_name"), F.lit(" site")))
    asked = spark.read.parquet(f"{sf_dir}/customer.parquet").join(nations, C("c_nationkey") == C("n_nationkey")).select("c_custkey", text.normalize(q).alias("q"))
    return geocoding.match_aliases(asked, book, "c_custkey").select("c_custkey", C("entry").cast("long").alias("entry"), "confidence")


@query("join_annotate_75m", "WITH near AS (SELECT p.pid, min(q.qid) AS entry FROM fx_points p JOIN fx_probe q ON abs(p.lat - q.lat) < 0.001e0 AND 2*6371000.0e0*asin(sqrt(pow(sin(radians(q.lat-p.lat)/2),2)+cos(radians(p.lat))*cos(radians(q.lat))*pow(sin(radians(q.lon-p.lon)/2),2))) <= 75 GROUP BY p.pid) SELECT p.pid, entry FROM fx_points p LEFT JOIN near USING (pid)")
def join_annotate_75m(spark, sf_dir):
    from ..operators.spatial import first_within

    points, book = view(spark, sf_dir, "fx_points"), view(spark, sf_dir, "fx_probe")
    near = first_within(points, book, 75.0).select("pid", "entry")
    return points.select("pid").join(near, "pid", "left")


@query("prefix_contacts", "SELECT q, id, label FROM (SELECT 'customer#00000' || (k % 10)::VARCHAR AS q FROM range(10) t(k)) JOIN fx_contacts ON starts_with(lower(label), q) QUALIFY row_number() OVER (PARTITION BY q ORDER BY label, id) <= 3")
def prefix_contacts(spark, sf_dir):
    asked = spark.range(10).select(F.concat(F.lit("customer#00000"), C("id").cast("string")).alias("q"), F.length(F.lit("customer#000000")).alias("n"))
    contacts = view(spark, sf_dir, "fx_contacts").select("id", "label", F.lower("label").alias("low"))
    # Prefixes of one length make the match an equi-join.
    met = asked.join(contacts, C("q") == F.substr("low", F.lit(1), F.lit(15)))
    return geocoding.first_rows(met, ["q"], ["label", "id"], 3).select("q", "id", "label")


@query(
    "reverse_geocode",
    f"""SELECT qid, fid, layer AS type, name FROM (SELECT qid, fid, layer, name, row_number() OVER (PARTITION BY qid ORDER BY metres, fid) AS n FROM (
      SELECT q.qid, f.fid, f.layer, f.shown AS name, {sql_haversine("f.lat", "f.lon", "q.lat", "q.lon")} AS metres FROM fx_probe q CROSS JOIN (
        SELECT *, CASE WHEN osm_key IN ('amenity', 'shop') THEN 'poi' WHEN housenumber IS NOT NULL OR osm_value = 'residential' THEN 'street_address' WHEN type = 'hamlet' THEN 'locality' ELSE 'poi' END AS layer,
          array_to_string(list_filter([CASE WHEN housenumber IS NOT NULL THEN housenumber || ' ' || street ELSE coalesce(name, street) END, city, state, country], lambda x: x IS NOT NULL), ', ') AS shown FROM fx_features) f)
      WHERE metres <= CASE layer WHEN 'poi' THEN 300 WHEN 'street_address' THEN 1000 ELSE 15000 END) WHERE n = 1""",
)
def reverse_geocode(spark, sf_dir):
    """What is nearest to each probe, with its display name."""
    features = view(spark, sf_dir, "fx_features")
    found = retrieval.reverse(view(spark, sf_dir, "fx_probe"), features)
    shown = text.display_name(C("housenumber"), C("street"), C("name"), C("city"), C("county"), C("state"), C("country"))
    return found.select("qid", "fid", "type").join(features.select("fid", shown.alias("name")), "fid").select("qid", "fid", "type", "name")
