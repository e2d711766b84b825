"""Golden cases of functions and kernels that SQL does not check."""

import random

import pytest
from pyspark.sql import functions as F

from cairnway.functions import season, surface, text
from cairnway.functions.polyline import decode_line, encode_line
from cairnway.operators import geocoding, hours, merge_lines, routing, runs, spatial


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("dates", "day", "want"), [("05/01-09/30", 115, False), ("12/01-03/31", 115, True), ("06/15-10/15,12/01-03/31", 701, True), ("bad", 115, True), (None, 115, True)])
def test_seasons(spark, dates, day, want):
    assert one(spark, season.check_access(F.lit("Open"), F.lit(dates).cast("string"), day)) is want


def test_symbol_fallback(spark):
    assert one(spark, season.row_access(F.lit(None).cast("string"), F.lit(""), F.lit("3"), "atv", 115)) is False
    assert one(spark, season.row_access(F.lit(" "), F.lit(""), F.lit("2"), "vehicle")) is True
    assert one(spark, season.row_access(F.lit(None).cast("string"), F.lit(""), F.lit("99"), "atv")) is None


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = _next(row, x, b)
    return row[-1]


def _next(above, x, b):
    out = [0]
    for j, y in enumerate(b):
        out.append(above[j] + 1 if x == y else max(above[j + 1], out[-1]))
    return out


def test_indel_ratio(spark):
    rnd = random.Random(1)
    pairs = [("", ""), ("a", ""), ("main street", "main st"), *[("".join(rnd.choices("abc", k=rnd.randint(0, 9))), "".join(rnd.choices("abc", k=rnd.randint(0, 9)))) for _ in range(40)]]
    out = spark.createDataFrame(pairs, "a string, b string").select("a", "b", text.indel_ratio(F.col("a"), F.col("b")).alias("r")).collect()
    for r in out:
        total = len(r.a) + len(r.b)
        assert abs(r.r - (200 * lcs(r.a, r.b) / total if total else 100)) < 1e-9
        assert text.common_length(r.a, r.b) == lcs(r.a, r.b)
    built_in = spark.createDataFrame(pairs, "a string, b string").select("a", "b", text.longest_common_subsequence(F.col("a"), F.col("b")).alias("n"))
    assert all(r.n == lcs(r.a, r.b) for r in built_in.collect())


def test_trigram_similarity(spark):
    assert round(one(spark, text.trigram_similarity(F.lit("word"), F.lit("two words"))), 6) == 0.363636


def test_polyline_round_trip():
    rnd = random.Random(2)
    line = [{"lat": round(rnd.uniform(-90, 90), 6), "lon": round(rnd.uniform(-180, 180), 6)} for _ in range(50)]
    assert decode_line(encode_line(line)) == line


def test_short_runs_merge():
    assert runs.merge_short([("P", 500, 1), ("G", 50, 2), ("P", 500, 3)], 100) == [("P", 1050, 3)]
    assert runs.merge_short([("G", 50, 1), ("P", 500, 2)], 100) == [("P", 550, 2)]
    assert runs.merge_short([("P", 200, 1), (None, 300, 2)], 100) == [("P", 200, 1), (None, 300, 2)]


def test_segments_break_at_turns_and_half_miles():
    steps = [(500.0, 0.0, 0.0), (400.0, 10.0, 0.0), (10.0, 10.0, 0.0), (10.0, 300.0, 0.0)]
    assert [(s[0], s[1]) for s in runs.segment_steps(steps)] == [(0, 1), (2, 2), (3, 3)]


def test_surface_classes(spark):
    case = lambda s, u, r=None: one(spark, runs.surface_class(F.lit(s).cast("string"), F.lit(u).cast("string"), F.lit(r).cast("string")))
    assert [case("asphalt", "road"), case("dirt", "road"), case("dirt", None), case("paved", "alley", "service_other"), case("unknown", "road"), case("x", "path")] == ["PAVED", "TRACK", "UNPAVED", "PAVED", None, "TRAIL"]


def test_polygon_with_a_notch(spark):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in [(0, 0), (4, 0), (4, 4), (2, 2), (0, 4)]])
    inside = lambda x, y, b=True: one(spark, spatial.in_rings(F.lit(float(x)), F.lit(float(y)), F.array(ring), b))
    assert inside(1, 1) and not inside(2, 3) and inside(2, 2) and not inside(2, 2, False) and inside(4, 2) and not inside(4, 2, False)


def test_lines_join_where_two_meet():
    out = merge_lines.join_ends([[(0, 0), (1, 0)], [(2, 0), (1, 0)], [(5, 5), (6, 6)]])
    assert sorted(map(len, out)) == [2, 3]
    assert len(merge_lines.join_ends([[(0, 0), (1, 0)], [(1, 0), (2, 0)], [(1, 0), (1, 1)]])) == 3


def test_shortest_path_on_a_grid():
    graph = {}
    for r in range(30):
        for c in range(30):
            graph[r * 30 + c] = [((r + a) * 30 + c + b, (a * a + b * b) ** 0.5) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and 0 <= r + a < 30 and 0 <= c + b < 30]
    cost, path = routing.shortest(graph, {0: 0.0}, {899})
    assert len(path) == 30 and abs(cost - 29 * 2**0.5) < 1e-9
    assert routing.shortest({}, {0: 0.0}, {1}) == (float("inf"), [])


def test_entrances():
    assert len(routing.entrances(50)) == 20 and routing.entrances(50)[:2] == [(0, 8), (0, 16)]


def test_terrain_override(spark):
    cells = spark.createDataFrame([(0, 0, 1.0, 30, 0, 0, 0, 0.0), (0, 1, 1.0, 80, 0, 0, 0, 0.0)], "r int, c int, elev_m double, wc_class int, trail int, barrier int, wilderness int, grade double")
    assert [r.m for r in cells.select(surface.cost_multiplier("2w", F.lit(2.0)).alias("m")).collect()] == [4.0, float("inf")]


def test_intents(spark):
    rows = [("Boise Idaho",), ("Filer ID",), ("83702",), ("43.6, -116.2",), ("100 Main St, Boise, ID",), ("coffee",), ("new york",)]
    out = [r.intent for r in geocoding.classify(spark.createDataFrame(rows, "q string"), "q").collect()]
    assert out == ["LOCALITY", "LOCALITY", "POSTCODE", "COORD", "ADDRESS", "UNKNOWN", "UNKNOWN"]


def test_close_candidates_of_one_source_go(spark):
    rows = [(1, 0, 10, "a", 43.0, -116.0), (1, 1, 11, "a", 43.0, -116.0), (1, 2, 12, "b", 43.0, -116.0), (1, 3, 13, "a", 43.1, -116.0)]
    kept = geocoding.drop_close(spark.createDataFrame(rows, "qid long, position int, aid long, source string, lat double, lon double").selectExpr("*", "1 AS source_order"), 50.0)
    assert sorted(r.aid for r in kept.collect()) == [10, 12, 13]


def test_opening_hours(spark):
    rows = [(1, d, "00:00", None) for d in range(7)] + [(2, d, "08:00", "12:00") for d in range(1, 6)] + [(2, 1, "13:00", "00:00")] + [(3, 0, "09:00", "10:00"), (3, 6, "09:00", "10:00")]
    out = {r.k: r.hours for r in hours.opening_hours(spark.createDataFrame(rows, "k int, day int, open string, close string"), "k").collect()}
    assert out == {1: "24/7", 2: "Mo 08:00-12:00,13:00-24:00; Tu-Fr 08:00-12:00", 3: "Sa,Su 09:00-10:00"}


def test_only_named_columns_are_patched(spark):
    from cairnway.operators import contacts

    table = spark.createDataFrame([(1, "a", None)], "id long, label string, deleted_at string")
    with pytest.raises(ValueError, match="not editable"):
        contacts.patched(table, table, ["id"], "now")


def test_entry_point(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
