"""Queries and operators that SQL cannot express, against brute force in plain Python."""

import heapq
import itertools
import math
import random

import pytest

from cairnway.operators import contacts, geocoding, routing, spatial
from cairnway.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES = registry.queries()
WITHOUT = sorted(set(QUERIES) - set(registry.oracle_sql()))


@pytest.mark.parametrize("name", WITHOUT)
def test_rows_do_not_depend_on_how_the_work_is_dealt(spark, name):
    def rows(parts, adaptive):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        return sorted(map(repr, QUERIES[name](spark, SF).collect()))

    try:
        one, other = rows("4", "true"), rows("7", "false")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert one and one == other


def indel(a, b):
    """200 times the longest common subsequence over both lengths."""
    if not a and not b:
        return 100.0
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            row[j], before = (before + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return 200.0 * row[-1] / (len(a) + len(b))


def test_indel_ratios(spark):
    names = {r.n_nationkey: r.n_name for r in spark.read.parquet(f"{SF}/nation.parquet").collect()}
    for r in QUERIES["fn_indel_ratio"](spark, SF).collect():
        assert r.ratio == pytest.approx(indel(names[r.k], names[r.k - 1]), abs=1e-5)


def test_token_sort_ratios(spark):
    parts = {r.p_partkey: (r.p_name, r.p_type) for r in spark.read.parquet(f"{SF}/part.parquet").collect()}
    ordered = lambda t: " ".join(sorted(t.lower().split()))
    for r in QUERIES["fn_token_sort_ratio"](spark, SF).collect():
        a, b = parts[r.p_partkey]
        assert r.ratio == pytest.approx(indel(ordered(a), ordered(b)), abs=1e-5)


def test_polylines_come_back(spark):
    assert all(r.same for r in QUERIES["fn_polyline"](spark, SF).collect())


def metres(a, b):
    (y1, x1), (y2, x2) = ((math.radians(v) for v in p) for p in (a, b))
    return 2 * 6_371_000.0 * math.asin(math.sqrt(math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2))


@pytest.mark.parametrize("lat, lon, reach", [(80.0, 10.0, 2800.0), (0.0, 179.999, 1000.0), (-45.0, -179.99, 5000.0), (89.99, 0.0, 4000.0), (-90.0, 0.0, 20_000.0), (43.0, -117.0, 300_000.0)])
def test_radius_joins_near_poles_and_across_180_degrees(spark, lat, lon, reach):
    rnd = random.Random(int(lat))
    wide = reach / 111_000.0
    near = lambda: (max(-90.0, min(90.0, lat + rnd.uniform(-2, 2) * wide)), (lon + rnd.uniform(-2, 2) * min(180.0, wide / max(0.001, math.cos(math.radians(lat)))) + 180) % 360 - 180)
    points, asked = [(i, *near()) for i in range(60)], [(i, *near()) for i in range(30)]
    got = {(r.pid, r.qid) for r in spatial.within_radius(spark.createDataFrame(points, "pid long, lat double, lon double"), spark.createDataFrame(asked, "qid long, lat double, lon double"), reach).collect()}
    assert got == {(p, q) for (p, *a), (q, *b) in itertools.product(points, asked) if metres(a, b) <= reach}


def test_nearest_points_beyond_the_last_ring(spark):
    points = [(i, 10.0 * i - 45, 30.0 * i - 150) for i in range(10)]
    asked = [(0, 43.0, -117.0), (1, -80.0, 100.0)]
    got = {(r.qid, r.n, r.pid) for r in spatial.nearest(spark.createDataFrame(asked, "qid long, lat double, lon double"), spark.createDataFrame(points, "pid long, lat double, lon double"), 4, (2000.0, 8000.0), ["pid"]).collect()}
    want = {(q, n + 1, p) for q, *a in asked for n, (_, p) in enumerate(sorted((metres(a, b), p) for p, *b in points)[:4])}
    assert got == want


def test_aliases_of_one_letter_and_empty_queries(spark):
    book = spark.createDataFrame([(1, ["a"]), (2, ["ab", ""])], "entry long, forms array<string>")
    asked = spark.createDataFrame([(1, ""), (2, "a"), (3, "b")], "k long, q string")
    assert {(r.k, r.entry, r.confidence) for r in geocoding.match_aliases(asked, book, "k").collect()} == {(2, 1, "exact")}


def test_contacts_conflict_within_a_batch_and_restore_under_a_new_label(spark):
    schema = "id long, user_id string, label string, deleted_at string"
    stored = spark.createDataFrame([(1, "u", "Home", "2024"), (2, "u", "Home", "2024"), (3, "u", "Work", None), (4, "u", "Work", "2024")], schema)
    new = spark.createDataFrame([(10, "v", "Home"), (11, "v", "Home"), (12, "u", "Work"), (13, "v", "x"), (14, "v", "x")], "id long, user_id string, label string")
    assert {r.id: r.error for r in contacts.checked_inserts(stored, new).collect()} == {10: None, 11: "conflict", 12: "conflict", 13: None, 14: None}
    acts = spark.createDataFrame([(1, "restore", None), (2, "restore", None), (4, "restore", "Old work")], "id long, act string, restore_as string")
    out = {r.id: (r.label, r.deleted_at, r.error) for r in contacts.apply_actions(stored, acts, "now").collect()}
    assert out == {1: ("Home", None, None), 2: ("Home", "2024", "conflict"), 3: ("Work", None, None), 4: ("Old work", None, None)}
    users = spark.createDataFrame([("u",)], "user_id string")
    assert [r.id for r in contacts.listed(stored, users).collect()] == [3]


def test_routes_cost_what_dijkstra_finds(spark):
    rnd, side = random.Random(2), 12
    edges = []
    for r, c in itertools.product(range(side), range(side)):
        for dr, dc in itertools.product((-1, 0, 1), (-1, 0, 1)):
            if (dr or dc) and 0 <= r + dr < side and 0 <= c + dc < side and rnd.random() < 0.7:
                edges.append((r * side + c, (r + dr) * side + c + dc, rnd.uniform(1, 9) * math.hypot(dr, dc)))
    around = {}
    for a, b, w in edges:
        around.setdefault(a, []).append((b, w))

    def cost(starts, goals):
        best, heap = {s: 0.0 for s in starts}, [(0.0, s) for s in starts]
        while heap:
            d, n = heapq.heappop(heap)
            if n in goals:
                return d
            for m, w in around.get(n, ()):
                if d + w < best.get(m, math.inf):
                    best[m] = d + w
                    heapq.heappush(heap, (d + w, m))
        return math.inf

    trips = [(i, "a", rnd.sample(range(side * side), 2), [*rnd.sample(range(side * side), 2), 10**6]) for i in range(25)] + [(99, "a", [5], [10**6])]
    asked = spark.createDataFrame(trips, "trip long, area string, starts array<long>, goals array<long>")
    graph = spark.createDataFrame([("a", *e) for e in edges], "area string, a long, b long, w double")
    weight = {(a, b): w for a, b, w in edges}
    for side_ in (side, None):
        for r in routing.route(asked, graph, side_, together=7).collect():
            _, _, starts, goals = next(t for t in trips if t[0] == r.trip)
            assert r.cost_s == pytest.approx(cost(starts, goals))
            if r.path:
                assert r.path[0] in starts and r.path[-1] in goals
                assert sum(weight[e] for e in zip(r.path, r.path[1:], strict=False)) == pytest.approx(r.cost_s)


def test_grades_and_blurs_beside_absent_cells(spark):
    """A plane of grade 1 with a row of cells taken out keeps its grade or has none; a blurred constant stays constant."""
    from cairnway.functions import surface

    plane = [(r, c, float(r)) for r in range(9) for c in range(5) if r != 4]
    out = surface.with_grade(spark.createDataFrame(plane, "r int, c int, elev_m double"), 1.0).collect()
    assert {r.grade for r in out if r.r not in (3, 5)} == {1.0} and {r.grade for r in out if r.r in (3, 5)} == {None}
    flat = spark.createDataFrame([(r, c, 7.0) for r in range(9) for c in range(5) if (r, c) != (4, 2)], "r int, c int, v double")
    assert all(abs(r.v - 7.0) < 1e-9 for r in surface.blur(flat, "v").collect())


def test_lines_joined_like_one_pair_at_a_time():
    from cairnway.operators.merge_lines import join_ends

    def slowly(lines):
        lines = [list(x) for x in lines if len(x) > 1]
        while True:
            at = {}
            for k, x in enumerate(lines):
                for p in (x[0], x[-1]):
                    at.setdefault(p, []).append(k)
            pair = next((v for v in at.values() if len(v) == 2 and v[0] != v[1]), None)
            if not pair:
                return lines
            one, two = (lines[k] for k in pair)
            p = next(p for p, v in at.items() if v == pair)
            one, two = one if one[-1] == p else one[::-1], two if two[0] == p else two[::-1]
            lines = [x for k, x in enumerate(lines) if k not in pair] + [one + two[1:]]

    rnd = random.Random(1)
    for _ in range(200):
        lines = [[rnd.randrange(12), 100 + i, rnd.randrange(12)] for i in range(rnd.randint(1, 12))]
        shape = lambda out: sorted((len(x), tuple(sorted(p for p in x if p >= 100))) for x in out)
        assert shape(join_ends(lines)) == shape(slowly(lines))
