"""Maps are searched by packed tiles, and chunk costs are told of all modes."""

import random

from test_routing_maps import plain

from cairnway.operators import routing


def test_tiles_with_numbers_are_packed_once_and_written_once_a_round(spark, monkeypatch):
    """Ways that leave a tile and come back, dead ends, a tile without edges of its own, and one that nothing leads to."""
    rnd, tile, around, edges = random.Random(5), lambda n: n // 10, {}, []
    for _ in range(240):
        a, b = rnd.randrange(60), rnd.randrange(60)
        if b < 50 or a >= 50:
            around.setdefault(a, []).append((b, float(rnd.randint(1, 40))))
    around.setdefault(3, []).extend([(71, 2.5), (72, 0.5)])  # from which no edge leads on
    edges = [(tile(a), a, b, tile(b), w) for a, more in around.items() for b, w in more]
    written = []

    def counted(rows, name, real=routing.rewritten):
        written.append(name)
        return real(rows, name)

    monkeypatch.setattr(routing, "rewritten", counted)
    graph = spark.createDataFrame(edges, "tile long, a long, b long, tile2 long, w double")
    got = routing.costs_over_tiles(spark.createDataFrame([(0, 1)], "tile long, node long"), graph).collect()
    want = plain(around, 1)
    assert {r.node: r.cost_s for r in got} == want and len(got) == len(want) > 40 and {71, 72} <= set(want) and 55 not in want
    assert all(r.tile == tile(r.node) for r in got)
    assert 3 < len(written) < 30 and set(written) == {"tile_costs"}


def test_texts_are_compared_once_and_only_the_first_places_of_a_name_meet_questions(spark, tmp_path, monkeypatch):
    """Equal names at many spots, in groups of ties, against all pairs; ``similarity`` is worked out for pairs of texts, not of rows."""
    import duckdb

    from cairnway.plans import registry, spatial

    rnd = random.Random(8)
    rows = [(i + 20003 * j, rnd.choice(["old mill", "old barn", "new mill", None, ""]), f"b{rnd.randrange(3)}", 1) for i in range(0, 900, 30) for j in range(8)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    con, written = duckdb.connect(), {}
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")

    def counted(table, name, real=spatial.rewritten):
        written[name] = real(table, name)
        return written[name]

    monkeypatch.setattr(spatial, "rewritten", counted)
    for name, columns in (("topk_sim_dist", ["qid", "id", "similarity", "place"]), ("join_spatial_fuzzy", ["qid", "id", "similarity"])):
        got = registry.queries()[name](spark, str(tmp_path)).select(*columns).collect()
        want = con.sql(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
        assert sorted(map(tuple, got)) == sorted(want) and len(got) > 100
        assert written["alike"].count() <= 4 * 12


def test_lines_are_bresenham_s(spark):
    """Cell by cell as the loop with an error term has them, in all directions; of cells that roads share, closed wins."""
    from cairnway.operators.rasterize import access_grid, line_cells

    def loop(r, c, r2, c2):
        dr, dc, out = abs(r2 - r), abs(c2 - c), {(r, c)}
        err, sr, sc = dr - dc, 1 if r < r2 else -1, 1 if c < c2 else -1
        while (r, c) != (r2, c2):
            e2 = 2 * err
            if e2 > -dc:
                err, r = err - dc, r + sr
            if e2 < dr:
                err, c = err + dr, c + sc
            out.add((r, c))
        return out

    lines = [(i, i % 3 > 0, 20, 20, 20 + a, 20 + b) for i, (a, b) in enumerate((a, b) for a in range(-9, 10) for b in range(-9, 10))]
    lines += [(900, None, 0, 0, 3, 8), (901, True, 5, 2**20, 5 + 7, 2**20 - 50_000)]
    table = spark.createDataFrame(lines, "fid long, access boolean, r1 int, c1 int, r2 int, c2 int")
    got = {}
    for x in line_cells(table).collect():
        got.setdefault(x.fid, []).append((x.r, x.c))
    want = {i: loop(*ends) for i, _, *ends in lines}
    assert all(len(v) == len(set(v)) for v in got.values()) and {k: set(v) for k, v in got.items()} == want
    grid = {}
    for i, access, *_ in lines:
        for at in want[i] if access is not None else ():
            grid[at] = max(grid.get(at, 0), 1 if access else 255)
    assert {(x.r, x.c): x.value for x in access_grid(table).collect()} == grid


def test_chunk_costs_are_told_of_all_modes(spark):
    """Each mode's costs against a search from each entrance; what is written has them all."""
    from cairnway.functions import surface
    from cairnway.plans import registry
    from cairnway.plans import routing as plans

    sf, doors, want = "/root/testdata/sf0.001", routing.entrances(plans.CHUNK), {}
    places = [r * plans.CHUNK + c for r, c in doors]
    groups = {}
    for e in plans.chunked(spark, sf).collect():
        groups.setdefault((e.chunk, e["mode"]), {}).setdefault(e.a, []).append((e.b, e.w))
    for (chunk, mode), around in groups.items():
        for i, a in enumerate(places):
            best = plain(around, a)
            want |= {(chunk, mode, i, j): round(best[b], 6) for j, b in enumerate(places) if i != j and b in best}
    got = {(r.chunk, r["mode"], r.from_entrance, r.to_entrance): r.cost_s for r in registry.queries()["hpa_build"](spark, sf).collect()}
    assert {m for _, m in groups} == set(surface.MODES) and got.keys() == want.keys() and {"foot", "2w", "4w"} <= {m for _, m, *_ in got}
    assert all(abs(got[k] - v) < 2e-6 for k, v in want.items())
    told = {r["mode"]: r["rows"] for r in registry.queries()["write_chunk_costs"](spark, sf).collect()}
    assert told == {m: n for m in surface.MODES if (n := sum(k[1] == m for k in want))}  # without a road no vehicle goes from entrance to entrance on a map this small


def test_unified_layers_have_all_steps(spark):
    """All modes; friction, closures that bleed, affinity on the network only, a crisp corridor: against plain loops."""
    import math

    from cairnway.functions import surface
    from cairnway.plans import registry

    size, inf = 24, math.inf
    rows = [(r, c, 1000.0, (50, 30, 60)[(r + c) % 3], 5 if r == 10 else 0, 255 if r == 10 and c > 15 else 0, 0) for r in range(size) for c in range(size)]
    cells = spark.createDataFrame(rows, "r int, c int, elev_m double, wc_class int, trail int, barrier int, wilderness int")
    from pyspark.sql import functions as F

    graded = surface.with_grade(cells, 30.0)
    found = surface.unified_layers(graded, surface.friction_multiplier(F.col("wc_class")), F.col("barrier") == 255, 0.5, F.col("c") < 2)
    got = {(x.mode, x.r, x.c): x.mult for x in found.collect()}
    assert len(got) == 4 * size * size
    taps = surface.gaussian_weights()
    reach = len(taps) // 2
    for mode, factor in (("foot", {}), ("2w", {30: 2.0, 60: 3.0}), ("4w", {30: 1.5, 60: 2.0}), ("vehicle", {30: inf, 60: inf})):
        base = [[rows[r * size + c][3] / 10 * factor.get(rows[r * size + c][3], 1.0) for c in range(size)] for r in range(size)]
        for r, c, _, wc, _, barrier, _ in rows:
            if mode == "vehicle" and wc == 30:
                base[r][c] = 5.0  # a flat field
            if mode != "foot" and barrier == 255:
                base[r][c] = inf
        finite = sorted(x for line in base for x in line if x < inf)
        at = (len(finite) - 1) * 0.95
        p95 = finite[int(at)] + (finite[math.ceil(at)] - finite[int(at)]) * (at - int(at))
        filled = [[x if x < inf else min(50 * p95, 1e12) for x in line] for line in base]
        pick = lambda k: max(0, min(size - 1, k))
        once = [[sum(w * filled[pick(r + k - reach)][c] for k, w in enumerate(taps)) for c in range(size)] for r in range(size)]
        twice = [[sum(w * once[r][pick(c + k - reach)] for k, w in enumerate(taps)) for c in range(size)] for r in range(size)]
        for r in range(size):
            for c in range(size):
                want = inf if c < 2 or base[r][c] == inf else twice[r][c] * (0.5 if r == 10 else 1.0)
                assert got[mode, r, c] == want or abs(got[mode, r, c] - want) < 1e-6 * want, (mode, r, c)
    assert {x["mode"] for x in registry.queries()["fn_unified_layers"](spark, "/root/testdata/sf0.001").select("mode").distinct().collect()} == set(surface.MODES)
