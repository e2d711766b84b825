"""Maps with gaps and large keys equal their SQL."""

import math

import duckdb
import pytest

from cairnway.plans import registry

CELL_QUERIES = ["win_slope_grad", "fn_cost_grid", "fn_cost_multiplier", "agg_percentile95", "win_gaussian", "win_inflate", "fn_unified_layers"]


def orders(spark, at, keys):
    rows = [(k, (i * 37) % 500, 1000.0 + (i * 911) % 9973) for i, k in enumerate(keys)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{at}/orders.parquet")


def both(spark, at, name):
    """Rows of the query and of its SQL, to nine digits."""
    out = registry.queries()[name](spark, str(at))
    plain = lambda rows: sorted((tuple("NULL" if v is None or v != v else v if isinstance(v, str) or math.isinf(v) else round(v, 6) for v in r) for r in rows), key=repr)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{at}/orders.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(out.columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    return plain(map(tuple, out.collect())), plain(want)


@pytest.mark.parametrize("name", CELL_QUERIES)
def test_maps_with_absent_cells_equal_their_sql(spark, tmp_path, name):
    orders(spark, tmp_path, [k for k in range(700) if k % 7 != 3 and not 100 <= k < 160])
    got, want = both(spark, tmp_path, name)
    assert got == want


@pytest.mark.parametrize("name", ["fn_friction_mult", "fn_trail_friction"])
def test_keys_beyond_32_bits_equal_their_sql(spark, tmp_path, name):
    orders(spark, tmp_path, [k + (i % 3) * 2**33 for i, k in enumerate(range(300))])
    got, want = both(spark, tmp_path, name)
    assert got == want


def test_reverse_geocoding_compares_places_not_rows(spark, monkeypatch):
    """Copies at one place are met once, and the nearest within the reach of its type is found."""
    from cairnway.operators import retrieval, spatial

    met = []

    def counted(points, others, metres, real=spatial.within_radius):
        met.append(points.count() * others.count())
        return real(points, others, metres)

    for module in (spatial, retrieval):
        monkeypatch.setattr(module, "within_radius", counted, raising=False)
    kinds = [("amenity", "cafe", "house", None, 0.002), ("highway", "residential", "street", None, 0.004), ("place", "hamlet", "hamlet", None, 0.05), ("place", "hamlet", "hamlet", None, 0.2)]
    rows = [(100 * i + j, *kind[:4], 43.0 + kind[4], -117.0) for i, kind in enumerate(kinds) for j in range(20)]
    features = spark.createDataFrame(rows, "fid long, osm_key string, osm_value string, type string, housenumber string, lat double, lon double")
    spots = [(43.0, -117.0), (43.012, -117.0), (43.1, -117.0), (44.0, -117.0), (95.0, 0.0)]
    places = spark.createDataFrame([(100 * i + j, lat, lon) for i, (lat, lon) in enumerate(spots) for j in range(20)], "qid long, lat double, lon double")
    found = {r.qid: (r.fid, r.type) for r in retrieval.reverse(places, features).collect()}
    # From the first spot the cafe is nearest, at 222 m; from the second the street, at 890 m; from the third only a hamlet is in reach.
    best = {0: (0, "poi"), 1: (100, "street_address"), 2: (200, "locality")}
    assert found == {100 * i + j: b for i, b in best.items() for j in range(20)}
    assert max(met) <= 20


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_steps_of_a_map_meet_cells_by_hash_in_a_shuffle(spark):
    from cairnway.operators import routing

    cells = spark.createDataFrame([(0, 0, 1.0, 1.0, 0, 0)], "r int, c int, elev_m double, mult double, trail int, barrier int")
    assert "ShuffledHashJoin" in plan(routing.edges(cells, "foot", 30.0))


def test_pairs_of_boxes_are_told_once_without_a_shuffle_of_pairs(spark):
    told = plan(registry.queries()["join_line_buffer"](spark, "/root/testdata/sf0.001"))
    assert "SortMergeJoin" in told and "BroadcastHashJoin" not in told and "HashAggregate" not in told
