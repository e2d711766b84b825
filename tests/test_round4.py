"""Equal places and questions are worked out once, and what has been exploded is shuffled, never broadcast."""

import math
import random

from cairnway.operators import spatial


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def spots(n, seed):
    draw = random.Random(seed)
    return [(i, 43 + draw.randrange(6) / 100, -117 + draw.randrange(6) / 100) for i in range(n)]


def test_exploded_segments_are_not_broadcast(spark):
    points = spark.createDataFrame(spots(20, 1), "qid long, lat double, lon double")
    lines = points.selectExpr("qid as fid", "lat as lat1", "lon as lon1", "lat + 0.003 as lat2", "lon + 0.001 as lon2")
    assert "BroadcastHashJoin" not in plan(spatial.near_segments(points, lines, 0.02, 0.02))


def test_nearest_segment_of_places_that_repeat(spark):
    asked = spots(60, 2) + [(60, 50.0, 0.0)]
    lines = [(i, lat, lon, lat + 0.004, lon + (i % 2) * 0.003) for i, lat, lon in spots(80, 3)]
    found = spatial.nearest_segment(spark.createDataFrame(asked, "qid long, lat double, lon double"), spark.createDataFrame(lines, "fid long, lat1 double, lon1 double, lat2 double, lon2 double"), 0.02, 0.005, "fid", 9)

    def off(lat, lon, lat1, lon1, lat2, lon2):
        dx, dy = lon2 - lon1, lat2 - lat1
        t = max(0.0, min(1.0, ((lon - lon1) * dx + (lat - lat1) * dy) / (dx * dx + dy * dy)))
        return round(math.hypot(lon1 + t * dx - lon, lat1 + t * dy - lat), 9)

    want = {}
    for qid, lat, lon in asked:
        best = min((off(lat, lon, *line[1:]), line[0]) for line in lines)
        if best[0] <= 0.02:
            want[qid] = best[1]
    assert {r["qid"]: r["fid"] for r in found.collect()} == want


def test_similar_names_of_rows_that_repeat(spark, tmp_path):
    from cairnway.plans import registry

    rows = [(i + 10000 * j, f"old mill {i % 3}", f"b{i % 2}", i % 5) for i in range(6) for j in range(5)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    found = registry.queries()["topk_sim_dist"](spark, str(tmp_path)).collect()
    # Copies lie at one place: each has the three first ids of the copies of its best name.
    assert {r["qid"] for r in found} == {r[0] for r in rows}
    for r in found:
        assert r["id"] == r["qid"] % 10000 + 10000 * (r["place"] - 1)


def test_nearest_of_places_that_repeat(spark):
    asked, points = spots(50, 4), spots(120, 5)
    found = spatial.nearest(spark.createDataFrame(asked, "qid long, lat double, lon double"), spark.createDataFrame(points, "id long, lat double, lon double"), 3, (2000.0, 8000.0), ["id"])
    assert found.count() == 150 and found.where("n = 1 and metres > 5000").isEmpty()
