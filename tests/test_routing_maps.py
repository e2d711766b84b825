"""Routing over maps from the tables: every query against plain searches over its edges."""

import heapq
import math
import statistics

import pytest

from cairnway.functions import surface
from cairnway.operators import routing
from cairnway.plans import registry
from cairnway.plans import routing as plans

SF = "/root/testdata/sf0.001"


def plain(around, start, seeds=None):
    """Costs of all nodes from one."""
    best, heap = {}, [(0.0, start)]
    while heap:
        d, n = heapq.heappop(heap)
        if n in best:
            continue
        best[n] = d
        for m, w in around.get(n, ()):
            if m not in best:
                heapq.heappush(heap, (d + w, m))
    return best


def listed(rows):
    out = {}
    for r in rows:
        out.setdefault(r.a, []).append((r.b, r.w))
    return out


@pytest.fixture(scope="module")
def edges(spark):
    return plans.numbered(plans.grid_edges(spark, SF)).collect()


@pytest.fixture(scope="module")
def ends(spark):
    return plans.trip_ends(spark, SF).collect()


def area(n, size=plans.AREA):
    return n // plans.STRIDE // size, n % plans.STRIDE // size


def test_costs_over_tiles_equal_one_search(spark, edges):
    graph = spark.createDataFrame([(str(area(r.a, 8)), r.a, r.b, str(area(r.b, 8)), r.w) for r in edges], "tile string, a long, b long, tile2 string, w double")
    got = routing.costs_over_tiles(spark.createDataFrame([(str(area(1, 8)), 1)], "tile string, node long"), graph).collect()
    want = plain(listed(edges), 1)
    assert {r.node for r in got} == set(want) and len(got) == len(want) > 1000
    assert all(r.cost_s == pytest.approx(want[r.node]) for r in got)


def test_ways_are_as_long_as_their_costs(spark, edges, ends):
    within = [r for r in edges if area(r.a) == area(r.b)]
    weight, around = {(r.a, r.b): r.w for r in within}, listed(within)
    costs = {e.trip: plain(around, e.start).get(e.goal, math.inf) for e in ends}
    paths = {}
    for r in registry.queries()["path_reconstruct"](spark, SF).orderBy("trip", "i").collect():
        paths.setdefault(r.trip, []).append(r.r * plans.STRIDE + r.c)
    assert set(paths) == {t for t, c in costs.items() if c < math.inf} and paths
    for e in ends:
        if e.trip in paths:
            p = paths[e.trip]
            assert (p[0], p[-1]) == (e.start, e.goal)
            assert sum(weight[s] for s in zip(p, p[1:], strict=False)) == pytest.approx(costs[e.trip])


def test_four_modes_equal_one_search_over_the_layers(spark, ends):
    around = listed(plans.multimode_edges(spark, SF).collect())
    got = {r.trip: r for r in registry.queries()["astar_multimode"](spark, SF).collect()}
    alone = {}
    for e in ends:
        best = plain(around, e.start)
        want = min(best.get(e.goal + k * plans.LAYER, math.inf) for k in range(4))
        assert got[e.trip].cost_s == (pytest.approx(want, abs=1e-4) if want < math.inf else math.inf)
        alone[e.trip] = want
    assert any(len(r.modes) > 1 for r in got.values()) and all(set(r.modes) <= set(surface.MODES) for r in got.values())


def test_chunk_costs_equal_searches_inside_chunks(spark, edges):
    doors = routing.entrances(plans.CHUNK)
    got = {(r.chunk, r.from_entrance, r.to_entrance): r.cost_s for r in registry.queries()["hpa_build"](spark, SF).where("mode = 'foot'").collect()}
    around = listed([r for r in edges if area(r.a, plans.CHUNK) == area(r.b, plans.CHUNK)])
    want = {}
    for cy, cx in {area(r.a, plans.CHUNK) for r in edges}:
        cells = [(cy * plans.CHUNK + r) * plans.STRIDE + cx * plans.CHUNK + c for r, c in doors]
        for i, a in enumerate(cells):
            best = plain(around, a)
            want |= {(f"{cy},{cx}", i, j): best[b] for j, b in enumerate(cells) if i != j and b in best}
    assert set(got) == set(want) and all(got[k] == pytest.approx(v, abs=1e-6) for k, v in want.items())
    rows = registry.queries()["write_chunk_costs"](spark, SF).collect()
    assert {r["mode"]: r["rows"] for r in rows}["foot"] == len(want)


def test_abstract_ways_between_any_cells(spark, edges, ends):
    """Never cheaper than the best way, seldom much dearer; refined to cells they cost what they were said to."""
    within = [r for r in edges if area(r.a) == area(r.b)]
    weight, around = {(r.a, r.b): r.w for r in within}, listed(within)
    told = {r.trip: r.cost_s for r in registry.queries()["hpa_abstract"](spark, SF).collect()}
    full = {e.trip: plain(around, e.start).get(e.goal, math.inf) for e in ends}
    assert told and set(told) <= {t for t, c in full.items() if c < math.inf}
    ratios = [told[t] / full[t] for t in told if full[t] > 0]
    assert min(ratios) >= 1 - 1e-6 and statistics.median(ratios) < 1.25
    paths = {}
    for r in registry.queries()["hpa_refine"](spark, SF).orderBy("trip", "i").collect():
        paths.setdefault(r.trip, []).append(r.cell)
    assert set(paths) == set(told)
    for e in ends:
        if e.trip in told:
            p = paths[e.trip]
            assert (p[0], p[-1]) == (e.start, e.goal)
            assert sum(weight[s] for s in zip(p, p[1:], strict=False)) == pytest.approx(told[e.trip], abs=1e-3)
    print(sorted(round(x, 3) for x in ratios))


def test_start_and_goal_in_one_chunk_or_at_one_cell(spark):
    row = [(f"0,{c // 4}", c, c + d, 1.0) for c in range(8) for d in (-1, 1) if 0 <= c + d < 8]
    chunk = lambda n: f"0,{n // 4}"
    inner = spark.createDataFrame([e for e in row if chunk(e[1]) == chunk(e[2])], "chunk string, a long, b long, w double")
    doors = spark.createDataFrame([(chunk(n), n) for n in (0, 3, 4, 7)], "chunk string, door long")
    graph = spark.createDataFrame([("a", 0, 3, 3.0), ("a", 3, 0, 3.0), ("a", 4, 7, 3.0), ("a", 7, 4, 3.0), ("a", 3, 4, 1.0), ("a", 4, 3, 1.0)], "area string, a long, b long, w double")
    trips = spark.createDataFrame([(1, "a", 1, 2, chunk(1), chunk(2)), (2, "a", 1, 6, chunk(1), chunk(6)), (3, "a", 5, 5, chunk(5), chunk(5)), (4, "a", 1, 99, chunk(1), "0,24")], "trip long, area string, start long, goal long, chunk string, chunk2 string")
    got = {r.trip: r for r in routing.abstract_routes(trips, routing.pseudo_edges(trips, inner, doors), graph).collect()}
    assert {t: r.cost_s for t, r in got.items()} == {1: 1.0, 2: 5.0, 3: 0.0, 4: math.inf}
    from pyspark.sql import functions as F

    paths = {r.trip: r.path for r in routing.stitched(spark.createDataFrame([(r.trip, r.cost_s, r.hops) for r in got.values()], "trip long, cost_s double, hops array<long>"), inner, lambda n: F.concat(F.lit("0,"), F.floor(n / 4).cast("string"))).collect()}
    assert paths == {1: [1, 2], 2: [1, 2, 3, 4, 5, 6], 3: [5]}
