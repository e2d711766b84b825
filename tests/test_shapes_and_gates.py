"""Boxes of all sizes, polygons of any shape, percentiles, nearest points within a radius, and gates, against plain Python."""

import math
import random

import numpy as np
import pytest

from cairnway.functions import surface
from cairnway.operators import enrichment, routing, spatial
from cairnway.sources import readers, writers


def odd_even(x, y, rings):
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]], strict=True):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                odd = not odd
    return odd


def test_boxes_from_steps_to_the_globe(spark):
    rnd = random.Random(1)
    points = [(i, rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for i in range(200)] + [(900, 0.0, 0.0), (901, 90.0, 180.0)]
    boxes = [(0, -180.0, 180.0, -90.0, 90.0), (1, 0.0, 0.0, 0.0, 0.0), (2, -0.05, 0.05, -0.05, 0.05)]
    boxes += [(10 + k, x, x + 2.0**-k * 90, y, y + 2.0**-k * 60) for k in range(12) for x, y in [(rnd.uniform(-180, 90), rnd.uniform(-90, 30))]]
    table = spark.createDataFrame(boxes, "box int, xmin double, xmax double, ymin double, ymax double")
    for boundary in (True, False):
        got = spatial.in_rectangles(spark.createDataFrame(points, "pid int, lat double, lon double"), table, 0.1, boundary)
        inside = (lambda v, a, b: a <= v <= b) if boundary else (lambda v, a, b: a < v < b)
        want = {(p, b) for p, lat, lon in points for b, x1, x2, y1, y2 in boxes if inside(lon, x1, x2) and inside(lat, y1, y2)}
        pairs = [(r.pid, r.box) for r in got.collect()]
        assert set(pairs) == want and len(pairs) == len(want)


def test_polygons_that_are_not_convex_with_holes(spark):
    rnd = random.Random(2)
    shapes = []
    for k in range(20):
        cx, cy, size = rnd.uniform(-170, 170), rnd.uniform(-80, 80), 10 ** rnd.uniform(-2, 1)
        star = [(cx + size * r * math.cos(a), cy + size * r * math.sin(a)) for a, r in ((2 * math.pi * i / 14, rnd.uniform(0.4, 1)) for i in range(14))]
        hole = [(cx + size * 0.2 * math.cos(a), cy + size * 0.2 * math.sin(a)) for a in (2 * math.pi * i / 5 for i in range(5))]
        shapes.append((k, [star, hole], cx, cy, size))
    points = [(1000 * k + i, cy + size * rnd.uniform(-1, 1), cx + size * rnd.uniform(-1, 1)) for k, _, cx, cy, size in shapes for i in range(60)]
    table = spark.createDataFrame([(k, rings) for k, rings, *_ in shapes] + [(99, [])], "shape int, rings array<array<struct<lon:double,lat:double>>>")
    got = {(r.pid, r.shape) for r in spatial.in_polygons(spark.createDataFrame(points, "pid int, lat double, lon double"), table, 0.1).collect()}
    assert got == {(p, k) for p, lat, lon in points for k, rings, *_ in shapes if odd_even(lon, lat, rings)} and len(got) > 100


def test_points_on_edges_and_corners(spark):
    square = [[(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)], [(0.5, 0.5), (1.5, 0.5), (1.5, 1.5), (0.5, 1.5)]]
    points = [(0, 0.0, 1.0), (1, 0.0, 0.0), (2, 0.5, 1.0), (3, 1.0, 1.0), (4, 0.25, 0.25), (5, 3.0, 3.0)]
    table = spark.createDataFrame([(1, square)], "shape int, rings array<array<struct<lon:double,lat:double>>>")
    held = lambda boundary: {r.pid for r in spatial.in_polygons(spark.createDataFrame(points, "pid int, lat double, lon double"), table, 0.1, boundary).collect()}
    assert held(True) == {0, 1, 2, 4} and held(False) == {4}


def test_nearest_within_a_radius(spark):
    rnd = random.Random(3)
    points = spark.createDataFrame([(i, 43 + rnd.random(), -117 + rnd.random()) for i in range(300)], "id int, lat double, lon double")
    asked = spark.createDataFrame([(i, 43 + rnd.random(), -117 + rnd.random()) for i in range(20)] + [(99, 0.0, 0.0)], "qid int, lat double, lon double")
    whole = spatial.nearest(asked, points, 300, (20_000.0,), ["id"]).where("metres <= 5000 and n <= 4").select("qid", "id", "n")
    near = spatial.nearest(asked, points, 4, (2_000.0, 50_000.0), ["id"], within=5000.0).select("qid", "id", "n")
    assert sorted(map(tuple, near.collect())) == sorted(map(tuple, whole.collect())) and near.count() > 20


@pytest.mark.parametrize("values", [[1.0], [2.0, 2.0, 2.0], [3.0, 1.0], list(range(101)), [1e9, -1e9, 0.0, 5.5, 5.5]])
def test_percentile_is_exact(spark, values):
    rows = [("a", float(v)) for v in values] + [("a", None)] + [("b", float(v) * 2) for v in values]
    table = spark.createDataFrame(rows, "k string, v double")
    for share in (0.0, 0.5, 0.95, 1.0):
        got = {r.k: r.p for r in surface.percentile(table, "v", share, ["k"], bins=8).collect()}
        assert got == {"a": pytest.approx(np.quantile(values, share)), "b": pytest.approx(2 * np.quantile(values, share))}


def test_lookups_end_at_the_cap_in_order(spark):
    fields = "rid int, day string, user_id string, class string, name string, place_id string, data string, phone string"
    rows = [
        (1, "d", "u", "highway", "n", None, None, None), (2, "d", "u", "shop", "n", None, None, "1"), (3, "d", None, "shop", "n", "g", "x", None), (4, "d", "u", "shop", "n", "g", None, None), (5, "d", None, "shop", "n", None, None, ""),
        (6, "d", "u", "shop", "", None, None, None), (7, "d", "u", "shop", "n", None, None, None), (8, "d", "u", "shop", "n", None, None, None), (9, "d", "u", "shop", "n", None, None, None), (10, "e", "u", "shop", "n", None, None, None), (11, "e", "u", None, "n", None, None, None),
    ]
    got = {r.rid: r.decision for r in enrichment.paid_gate(spark.createDataFrame(rows, fields), ("phone",), 2).collect()}
    assert got == {1: "not_business", 2: "complete", 3: "cache_hit", 4: "known_miss", 5: "guest", 6: "unnamed", 7: "lookup", 8: "lookup", 9: "capped", 10: "lookup", 11: "not_business"}


def test_gate_reasons_in_order(spark):
    trips = [(1, "strict", [1.0]), (2, "pragmatic", [1.0, 0.5]), (3, "pragmatic", None), (4, "pragmatic", [1.0]), (5, "pragmatic", [1.0]), (6, "pragmatic", [1.0]), (7, "pragmatic", [])]
    needed = [(1, 0, 0), (2, 0, 0), (3, 99, 0), (4, 15, 0), (5, 21, 0), (6, 0, 0), (6, 1, 0), (7, 2, 0)]
    tables = [(1, 0, 9, "now"), (2, 10, 19, "now"), (3, 15, 16, "now"), (4, 20, 29, "old")]
    present = [(1, 0, 0), (1, 2, 0), (2, 1, 0)]
    got = routing.gate(
        spark.createDataFrame(trips, "trip int, boundary string, affinity array<double>"), spark.createDataFrame(needed, "trip int, cx int, cy int"), spark.createDataFrame(tables, "db int, lo int, hi int, profile string"), spark.createDataFrame(present, "db int, cx int, cy int"), "now"
    ).collect()
    assert {r.trip: (r.fallback_reason, r.db) for r in got} == {1: ("boundary_mode", None), 2: ("affinity", None), 3: ("no_coverage", None), 4: ("multi_region", None), 5: ("stale_profile", None), 6: ("missing_chunk", None), 7: (None, 1)}


def test_manifests_of_all_kinds(spark):
    texts = ['{"version": 1, "tile_dbs": [{"name": "a", "path": "a.parquet", "chunk_bounds": {"min_x": 1, "max_x": 2, "min_y": 3, "max_y": 4}}, {"name": "b", "path": "s3a://x/b"}]}', '{"path": "/old"}', '{"version": 9}', "{", None, '{"version": 1, "tile_dbs": []}']
    rows = readers.manifest(spark.createDataFrame([(i, "at", t) for i, t in enumerate(texts)], "id int, folder string, text string"), "text").collect()
    assert sorted((r.id, r.problem or "", -1 if r.ord is None else r.ord, r.path, r.min_x) for r in rows) == [
        (0, "", 0, "at/a.parquet", 1), (0, "", 1, "s3a://x/b", None), (1, "", 0, "/old", None), (2, "unknown version", -1, None, None), (3, "no manifest", -1, None, None), (4, "no manifest", -1, None, None), (5, "", -1, None, None)
    ]


def test_written_tables_are_deleted(spark):
    mine = len(writers.WRITTEN)
    plain, dealt = writers.rewritten(spark.range(3), "x"), writers.bucketed(spark.range(3), "id", "y")
    assert plain.count() == dealt.count() == 3
    folders = [at for at, _ in writers.WRITTEN[mine:]]
    writers.release(spark, since=mine)
    for at in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    assert len(writers.WRITTEN) == mine
