"""Deterministic geographic views over the driver's tables, as SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "fx_points": ("customer", "c_custkey AS pid, 43.0e0 + (c_custkey*7919 % 10000)/1.0e4 AS lat, -117.0e0 + (c_custkey*104729 % 10000)/1.0e4 AS lon"),
    "fx_probe": ("supplier", "s_suppkey AS qid, 43.0e0 + (s_suppkey*6151 % 10000)/1.0e4 AS lat, -117.0e0 + (s_suppkey*3571 % 10000)/1.0e4 AS lon"),
    "fx_trips": ("supplier", "s_suppkey AS trip, 43.0e0 + (s_suppkey*6151 % 10000)/1.0e4 AS lat, -117.0e0 + (s_suppkey*3571 % 10000)/1.0e4 AS lon, CASE WHEN s_nationkey % 4 = 0 THEN 'strict' ELSE 'pragmatic' END AS boundary, CASE WHEN s_acctbal < 0 THEN 0.8e0 ELSE 1.0e0 END AS affinity"),
    "fx_tables": ("nation", "n_nationkey AS db, CAST(-8672 + n_nationkey*4 AS BIGINT) AS lo, CAST(-8669 + n_nationkey*4 + n_nationkey % 3 AS BIGINT) AS hi, CASE WHEN n_nationkey % 5 = 4 THEN 'old' ELSE 'now' END AS profile"),
    "fx_requests": ("events", "event_id AS rid, CAST(ts AS DATE) AS day, CASE WHEN user_id % 9 <> 0 THEN user_id END AS user_id, CAST(floor(value * 100) AS BIGINT) % 200 AS fid"),
    "fx_details": ("part", "p_partkey AS fid, CASE p_size % 5 WHEN 0 THEN 'amenity' WHEN 1 THEN 'shop' WHEN 2 THEN 'highway' WHEN 3 THEN 'office' END AS class, CASE WHEN p_size % 11 <> 0 THEN p_name END AS name, CASE WHEN p_size % 4 = 0 THEN p_brand ELSE '' END AS phone, CASE WHEN p_size % 4 < 2 THEN p_type END AS website, CASE WHEN p_size % 7 < 2 THEN concat('g', p_brand) END AS place_id, CASE WHEN p_size % 7 = 0 THEN p_type END AS data"),
    "fx_contacts": (
        "customer",
        "c_custkey AS id, concat('u', CAST(c_nationkey AS {s})) AS user_id, CASE WHEN c_custkey % 50 = 0 THEN 'Home' WHEN c_custkey % 50 = 1 THEN 'Work' ELSE c_name END AS label, c_mktsegment AS category, "
        "concat('p', CAST(c_custkey % 977 AS {s})) AS phone, 43.0e0 + (c_custkey*7919 % 10000)/1.0e4 AS lat, -117.0e0 + (c_custkey*104729 % 10000)/1.0e4 AS lon, (c_custkey % 3 <> 0) AS show_proximity, CASE WHEN c_acctbal < 0 THEN concat('2024-01-', lpad(CAST(1 + c_custkey % 28 AS {s}), 2, '0'), 'T00:00:00Z') END AS deleted_at",
    ),
    "fx_addresses": (
        "orders",
        "o_orderkey AS aid, CAST(100 + o_orderkey % 900 AS {s}) AS number, concat(CASE o_custkey % 4 WHEN 0 THEN 'MAIN' WHEN 1 THEN 'NORTH' WHEN 2 THEN 'OAK' ELSE '21ST' END, CASE o_orderkey % 3 WHEN 0 THEN ' ST' WHEN 1 THEN ' AVE' ELSE ' RD' END) AS street, "
        "CASE o_custkey % 3 WHEN 0 THEN 'BOISE' WHEN 1 THEN 'NAMPA' ELSE 'EAGLE' END AS city, 'ID' AS state, CAST(83600 + o_custkey % 100 AS {s}) AS zipcode, 43.0e0 + (o_orderkey*3331 % 10000)/1.0e4 AS lat, -117.0e0 + (o_orderkey*7877 % 10000)/1.0e4 AS lon",
    ),
    "fx_queries": (
        "supplier",
        "s_suppkey AS qid, CAST(100 + (s_suppkey*37) % 900 AS {s}) AS number, concat(CASE s_suppkey % 4 WHEN 0 THEN 'main' WHEN 1 THEN 'North' WHEN 2 THEN 'Oak' ELSE '21st' END, CASE s_suppkey % 5 WHEN 0 THEN ' street' WHEN 1 THEN ' ave' WHEN 2 THEN ' rd' WHEN 3 THEN ' avenue' ELSE ' st' END) AS street, "
        "CASE s_suppkey % 3 WHEN 0 THEN 'Boise' WHEN 1 THEN 'Nampa' END AS city, CASE WHEN s_suppkey % 2 = 0 THEN 'ID' END AS state, CASE WHEN s_suppkey % 7 = 0 THEN CAST(83600 + s_suppkey % 100 AS {s}) END AS zipcode, 43.0e0 + (s_suppkey*6151 % 10000)/1.0e4 AS lat, -117.0e0 + (s_suppkey*3571 % 10000)/1.0e4 AS lon",
    ),
    "fx_entry_points": ("part", "p_partkey AS id, 43.0e0 + (p_partkey*2711 % 10000)/1.0e4 AS lat, -117.0e0 + (p_partkey*9973 % 10000)/1.0e4 AS lon, CASE p_size % 5 WHEN 0 THEN 'primary' WHEN 1 THEN 'residential' WHEN 2 THEN 'track' WHEN 3 THEN 'path' ELSE 'service' END AS highway_class, p_name AS name"),
    "fx_features": (
        "part",
        "p_partkey AS fid, CASE p_size % 5 WHEN 0 THEN concat(p_name, ' coffee') WHEN 1 THEN concat(p_name, ' market') WHEN 2 THEN concat(CASE p_partkey % 4 WHEN 0 THEN 'Main' WHEN 1 THEN 'North' WHEN 2 THEN 'Oak' ELSE '21st' END, CASE p_partkey % 3 WHEN 0 THEN ' Street' WHEN 1 THEN ' Avenue' ELSE ' Road' END) WHEN 4 THEN concat(p_name, ' village') END AS name, CASE p_size % 5 WHEN 0 THEN 'amenity' WHEN 1 THEN 'shop' WHEN 2 THEN 'highway' ELSE 'place' END AS osm_key, "
        "CASE p_size % 5 WHEN 0 THEN 'cafe' WHEN 1 THEN 'supermarket' WHEN 2 THEN 'residential' WHEN 3 THEN 'house' ELSE 'hamlet' END AS osm_value, CASE p_size % 5 WHEN 2 THEN 'street' WHEN 4 THEN 'hamlet' ELSE 'house' END AS type, CASE WHEN p_size % 5 = 3 THEN CAST(100 + p_partkey*37 % 900 AS {s}) END AS housenumber, "
        "CASE WHEN p_size % 5 IN (2, 3) THEN concat(CASE p_partkey % 4 WHEN 0 THEN 'Main' WHEN 1 THEN 'North' WHEN 2 THEN 'Oak' ELSE '21st' END, CASE p_partkey % 3 WHEN 0 THEN ' Street' WHEN 1 THEN ' Avenue' ELSE ' Road' END) END AS street, CASE WHEN p_size % 5 <> 4 THEN CASE p_partkey % 7 WHEN 0 THEN 'Boise' WHEN 1 THEN 'Nampa' WHEN 2 THEN 'Eagle' WHEN 3 THEN 'Kuna' ELSE 'Twin Falls' END END AS city, CAST(NULL AS {s}) AS county, 'ID' AS state, 'United States' AS country, 43.0e0 + (p_partkey*2711 % 10000)/1.0e4 AS lat, -117.0e0 + (p_partkey*9973 % 10000)/1.0e4 AS lon",
    ),
    "fx_parking": ("part", "p_partkey AS id, CASE p_size % 7 WHEN 0 THEN 'private' WHEN 1 THEN 'no' WHEN 2 THEN 'permit' WHEN 3 THEN 'yes' WHEN 4 THEN 'customers' END AS access, 43.0e0 + (p_partkey*4421 % 10000)/1.0e4 AS lat, -117.0e0 + (p_partkey*8017 % 10000)/1.0e4 AS lon"),
    "fx_units": (
        "nation",
        "CAST(n_nationkey AS BIGINT) AS unit_id, concat('Unit ', n_name) AS unit_nm, CASE n_nationkey % 3 WHEN 0 THEN 'NPS' WHEN 1 THEN 'BLM' ELSE 'ZZZ' END AS mang_name, CASE n_nationkey % 4 WHEN 0 THEN 'OA' WHEN 1 THEN 'RA' WHEN 2 THEN 'XA' END AS pub_access, CASE n_nationkey % 5 WHEN 0 THEN ' WSA' WHEN 1 THEN 'NLS' WHEN 2 THEN 'FOTH' WHEN 3 THEN '??' END AS des_tp, CAST(1 + n_nationkey % 5 AS {s}) AS gap_sts, CASE n_nationkey % 3 WHEN 0 THEN 'Marine' WHEN 1 THEN 'Fee' ELSE 'Proclamation' END AS category, CASE n_nationkey % 4 WHEN 0 THEN 'NM' WHEN 1 THEN 'DC' WHEN 2 THEN 'QQ' END AS state_nm, CASE WHEN n_nationkey % 6 <> 5 THEN CAST(1000 + n_nationkey*37 AS DOUBLE) END AS gis_acres, "
        "-117.0e0 + (n_nationkey % 5)*0.2e0 AS xmin, -117.0e0 + (n_nationkey % 5)*0.2e0 + 0.3e0 AS xmax, 43.0e0 + (n_nationkey % 4)*0.2e0 AS ymin, 43.0e0 + (n_nationkey % 4)*0.2e0 + 0.35e0 AS ymax",
    ),
    "fx_mvum": (
        "part",
        "p_partkey AS ogc_fid, CASE p_size % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'Open' WHEN 2 THEN 'closed' END AS atv, CASE p_size % 5 WHEN 0 THEN '05/01-11/30' WHEN 1 THEN '12/01-03/31' WHEN 2 THEN '06/15-10/15,12/01-03/31' WHEN 3 THEN 'bad' END AS atv_datesopen, CASE p_size % 3 WHEN 0 THEN 'yearlong' WHEN 1 THEN 'seasonal' END AS seasonal, "
        "CASE p_size % 8 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN '3' WHEN 3 THEN '4' WHEN 4 THEN '11' WHEN 5 THEN '12' WHEN 6 THEN '99' END AS symbol, 43.0e0 + (p_partkey*2711 % 10000)/1.0e4 AS lat1, -117.0e0 + (p_partkey*9973 % 10000)/1.0e4 AS lon1, 43.0e0 + (p_partkey*2711 % 10000)/1.0e4 + (p_partkey % 7)*1.0e-3 AS lat2, -117.0e0 + (p_partkey*9973 % 10000)/1.0e4 + (p_partkey % 5)*1.0e-3 AS lon2",
    ),
    "fx_trace_edges": ("lineitem", "l_orderkey AS route_id, CAST(l_linenumber AS BIGINT)*10000000000 + l_partkey*10000 + l_suppkey % 10000 AS edge_no, CASE l_partkey % 5 WHEN 0 THEN 'paved' WHEN 1 THEN 'gravel' WHEN 2 THEN 'dirt' WHEN 3 THEN 'weird' ELSE 'asphalt' END AS surface, CASE l_suppkey % 4 WHEN 0 THEN 'track' WHEN 1 THEN 'path' ELSE 'road' END AS use_tag, l_quantity*10.0e0 AS length_m"),
    "fx_path": ("lineitem", "l_orderkey AS route_id, CAST(l_linenumber AS BIGINT)*10000000000 + l_partkey*10000 + l_suppkey % 10000 AS i, 43.0e0 + (l_orderkey % 1000)*1.0e-3 + l_linenumber*(1 + l_partkey % 3)*1.0e-3 AS lat, -117.0e0 + (l_orderkey % 777)*1.0e-3 + l_linenumber*(l_suppkey % 3)*1.0e-3 AS lon, 1000.0e0 + l_partkey % 97 AS elev_m, CASE l_suppkey % 3 WHEN 0 THEN 'foot' WHEN 1 THEN '2w' ELSE 'vehicle' END AS mode, l_partkey % 4 = 0 AS on_trail, l_partkey % 11 = 0 AS barrier"),
}
def place_sql(key: str, first: int, spark: bool) -> str:
    """Every second one of a key's last 32 bits as a number: cells follow a curve that keeps the map about square as it grows."""
    if spark:  # bits are kept where half as far a shift puts them; texts of bits cost forty times as much
        return "CAST(" + " | ".join(f"(shiftright({key}, {k + first}) & {1 << k})" for k in range(16)) + " AS INT)"
    return "CAST(" + " + ".join(f"((({key} >> {2 * k + first}) & 1) << {k})" for k in range(16)) + " AS INT)"


#: A map of one cell an order: its place from the order's key, what is there from the order and the place.
CELLS = (
    "SELECT r, c, CASE WHEN o_custkey % 97 = 5 THEN NULL ELSE 1000.0e0 + (r*r*3 + c*c*5 + r*c*7) % 211 * 0.5e0 END AS elev_m, CASE CAST(floor(o_totalprice) AS BIGINT) % 9 WHEN 0 THEN 10 WHEN 1 THEN 20 WHEN 2 THEN 30 WHEN 3 THEN 40 WHEN 4 THEN 60 WHEN 5 THEN 80 WHEN 6 THEN 90 WHEN 7 THEN 95 ELSE 50 END AS wc_class, "
    "CASE WHEN r % 24 = 20 THEN 5 WHEN c % 29 = 13 THEN 15 WHEN r = c THEN 25 ELSE 0 END AS trail, CASE WHEN r % 40 BETWEEN 5 AND 8 AND c % 40 BETWEEN 25 AND 30 THEN 255 ELSE 0 END AS barrier, CASE WHEN r % 40 BETWEEN 30 AND 34 AND c % 40 BETWEEN 3 AND 9 THEN 255 ELSE 0 END AS wilderness "
    "FROM PLACES o"
)


def cells_sql(spark: bool) -> str:
    r, c = place_sql("o_orderkey", 1, spark), place_sql("o_orderkey", 0, spark)
    if spark:  # a generator's columns are worked out once: filters and joins on them do not spell them out again
        return CELLS.replace("PLACES", f"(SELECT r, c, o_custkey, o_totalprice FROM {{orders}} LATERAL VIEW inline(array(named_struct('r', {r}, 'c', {c}))) p)")
    return CELLS.replace("PLACES", f"(SELECT {r} AS r, {c} AS c, o_custkey, o_totalprice FROM {{orders}})")


#: Cells are numbered r * STRIDE + c; maps are cut into areas of AREA by AREA cells.
STRIDE, AREA = 1 << 20, 64


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One fixture view as a DataFrame; only the columns it reads reach the scan."""
    if name == "fx_cells":
        return spark.sql(cells_sql(True), orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))
    source, columns = VIEWS[name]
    return spark.sql(f"SELECT {columns.format(s='STRING')} FROM {{src}}", src=spark.read.parquet(f"{sf_dir}/{source}.parquet"))


def oracle_view(name: str) -> str:
    if name == "fx_cells":
        return cells_sql(False).format(orders="orders")
    source, columns = VIEWS[name]
    return f"SELECT {columns.format(s='VARCHAR')} FROM {source}"


def needed(sql: str) -> list[str]:
    return [v for v in dict.fromkeys(re.findall(r"\bfx_\w+", sql)) if v in VIEWS or v == "fx_cells"]
