"""Searches and joins of points compare places, whatever the number of rows that share them."""

from cairnway.operators import spatial
from cairnway.plans import registry

SF = "/root/testdata/sf0.001"


def test_both_ends_of_trips_are_one_search(spark, monkeypatch):
    calls = []

    def counted(*args, real=spatial.nearest, **more):
        calls.append(args)
        return real(*args, **more)

    monkeypatch.setattr(spatial, "nearest", counted)
    assert registry.queries()["route_scenarios"](spark, SF).count() == 10
    assert len(calls) == 1


def test_pairs_within_are_those_of_all_rows_by_places(spark, monkeypatch):
    """Places are met once, hot ones are dealt to parts, and tasks are as many as pairs need."""
    met = []

    def counted(points, others, metres, real=spatial.within_radius):
        met.append((points.count(), others.count()))
        return real(points, others, metres)

    points = spark.createDataFrame([(i, *((43.0, -117.0) if i % 3 else (43.0 + i % 4 * 0.004, -117.0))) for i in range(120)] + [(900, None, 1.0)], "pid long, lat double, lon double")
    asked = spark.createDataFrame([(i, 43.0 + i % 2 * 0.01, -117.0) for i in range(30)] + [(900, 1.0, None)], "qid long, lat double, lon double")
    want = sorted(map(tuple, spatial.within_radius(points, asked, 800.0).selectExpr("pid", "qid", "lat", "qlat", "round(metres, 1)").collect()))
    monkeypatch.setattr(spatial, "within_radius", counted)
    monkeypatch.setattr(spatial, "PAIRS", 100)
    found = spatial.pairs_within(points, asked, 800.0, 1)
    assert sorted(map(tuple, found.select("pid", "qid", "lat", "qlat", "metres").collect())) == want and len(want) > 1000
    assert max(a * b for a, b in met) <= 15
    assert f", {-(-len(want) // 100)}), REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()


def test_radius_queries_compare_places(spark, monkeypatch):
    calls = []

    def counted(*args, real=spatial.pairs_within):
        calls.append(args)
        return real(*args)

    monkeypatch.setattr(spatial, "pairs_within", counted)
    for name in ("join_radius", "find_nearby"):
        registry.queries()[name](spark, SF)
    assert len(calls) == 2


def all_at_once(runs, shortest):
    """Short runs go one after the other, equal neighbours join after each."""
    runs = list(runs)
    while len(runs) > 1 and (at := next((i for i, r in enumerate(runs) if r[1] < shortest), None)) is not None:
        _, metres, last = runs.pop(at)
        k = max(at - 1, 0)
        runs[k] = (runs[k][0], runs[k][1] + metres, last if at else runs[k][2])
        joined = [runs[0]]
        for r in runs[1:]:
            joined[-1:] = [(r[0], joined[-1][1] + r[1], r[2])] if r[0] == joined[-1][0] else [joined[-1], r]
        runs = joined
    return runs


def test_short_runs_are_folded_in_one_reading(spark, monkeypatch):
    """Routes that end anywhere in a batch, with null categories and many runs, as the rule says; no list of a route is collected."""
    import itertools
    import random

    from cairnway.operators import runs

    rnd = random.Random(9)
    edges = [(route, i, rnd.choice(["PAVED", "TRAIL", None]), float(rnd.choice([5, 20, 60, 99, 100, 400]))) for route in range(80) for i in range(rnd.choice([1, 2, 3, 9, 60]))]
    want = []
    for route, own in itertools.groupby(edges, key=lambda e: e[0]):
        first = [(k, sum(e[3] for e in same), same[-1][1]) for k, same in ((k, list(g)) for k, g in itertools.groupby(own, key=lambda e: e[2]))]
        assert runs.merge_short(first, 100.0) == all_at_once(first, 100.0)
        want += [(route, i + 1, *r) for i, r in enumerate(all_at_once(first, 100.0))]
    rnd.shuffle(edges)
    table = spark.createDataFrame(edges, "route_id long, edge_no long, category string, length_m double")
    monkeypatch.setattr(runs, "EDGES", 100)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = runs.collapsed(table)
        assert sorted(map(tuple, found.collect()), key=lambda r: r[:2]) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    told = found._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in told and f", {-(-len(edges) // 100)}), REPARTITION_BY_NUM" in told


def test_lines_are_dealt_to_tasks_by_their_cells(spark, monkeypatch):
    from cairnway.operators import rasterize

    monkeypatch.setattr(rasterize, "CELLS", 50)
    found = registry.queries()["fn_rasterize_line"](spark, SF)
    assert all(r.cells >= 1 for r in found.collect())
    told = found._jdf.queryExecution().executedPlan().toString()
    tasks = -(-sum(r.cells for r in found.collect()) // 50)
    assert tasks > 4 and f", {tasks}), REPARTITION_BY_NUM" in told and "ENSURE_REQUIREMENTS" not in told


def test_questions_without_a_place_meet_the_first_ids_of_a_pattern(spark, monkeypatch):
    from cairnway.operators import geocoding, retrieval

    met = []

    def counted(rows, by, *more, real=retrieval.first_rows):
        if by == ["pid"]:
            met.append(rows.count())
        return real(rows, by, *more)

    features = spark.createDataFrame([(i, "corner shop", None, None, "Boise", "ID", "cafe", 43.0 + i * 0.001, -117.0) for i in range(200)], "fid long, name string, housenumber string, street string, city string, state string, osm_value string, lat double, lon double")
    asked = spark.createDataFrame([(1, "corner boise", None, None, None), (2, "corner shop", None, 5.0, None), (3, "corner shop", 43.1004, -117.0, None)], "qid long, q string, lat double, lon double, zoom int")
    monkeypatch.setattr(retrieval, "first_rows", counted)
    found = sorted((r.qid, r.position, r.fid) for r in retrieval.free_text(asked, retrieval.Index.of(features), 3).collect())
    assert found == [(q, p, p) for q in (1, 2) for p in range(3)] + [(3, 0, 100), (3, 1, 101), (3, 2, 99)]
    assert met[1] <= 6  # after rare words: pairs of questions without a place, before of all questions with all features
    said = "aid long, number string, street string, city string, state string, zipcode string, lat double, lon double"
    addresses = spark.createDataFrame([(i, "1", "MAIN ST", "BOISE", "ID", "83600" if i % 2 else "83601", 43.0 + i, -117.0) for i in range(9, -1, -1)], said)
    questions = spark.createDataFrame([(1, "1", "Main St", None, None, None, None, None), (2, "1", "Main St", "Boise", "ID", "83600", None, 1.0), (3, "1", "main st", None, None, "83600", 50.2, -117.0)], "qid long, number string, street string, city string, state string, zipcode string, lat double, lon double")
    near = {q: [r.aid for r in sorted(geocoding.exact_addresses(questions, addresses, 2, near=True).collect(), key=lambda r: r.n) if r.qid == q] for q in (1, 2, 3)}
    assert near == {1: [0, 1], 2: [1, 3], 3: [7, 9]}
    postal = {q: [r.aid for r in sorted(geocoding.by_zip(questions, addresses, 2, near=True).collect(), key=lambda r: r.n) if r.qid == q] for q in (1, 2, 3)}
    assert postal == {1: [], 2: [1, 3], 3: [7, 9]}
