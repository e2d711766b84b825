"""Queries of least-cost routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import surface
from ..operators import routing
from .fixtures import AREA, STRIDE, view
from .raster import CELL, GRADE, MULT
from .registry import query

C = F.col
INF = "CAST('Infinity' AS DOUBLE)"
FOOT_TRAIL = "CASE {t} WHEN 0 THEN " + INF + " WHEN 5 THEN 0.1e0 WHEN 15 THEN 0.3e0 WHEN 25 THEN 0.5e0 ELSE 1.0e0 END"
EDGES = f"""g AS ({GRADE}), k AS (SELECT r, c, elev_m, {MULT["foot"]} AS mult, trail, barrier FROM g),
  e0 AS (SELECT a.r, a.c, b.r AS r2, b.c AS c2, a.elev_m AS e1, b.elev_m AS e2, a.mult AS m1, b.mult AS m2, a.trail AS t1, b.trail AS t2, sqrt(pow(b.r - a.r, 2) + pow(b.c - a.c, 2))*30.0e0 AS dist
    FROM k a JOIN k b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND (a.r <> b.r OR a.c <> b.c) WHERE a.elev_m IS NOT NULL AND b.elev_m IS NOT NULL AND a.barrier <> 255 AND b.barrier <> 255),
  e1 AS (SELECT *, (e2 - e1)/dist AS grade FROM e0),
  e2 AS (SELECT *, dist*3.6e0/(0.6e0*6.0e0*exp(-3.5e0*abs(grade + 0.05e0)))*CASE WHEN abs(grade) > tan(radians(40.0e0)) THEN exp((abs(grade) - tan(radians(40.0e0)))*10) ELSE 1.0e0 END AS base FROM e1 WHERE abs(grade) <= tan(radians(40.0e0)) OR exp((abs(grade) - tan(radians(40.0e0)))*10) <= 1.0e6),
  edge AS (SELECT r, c, r2, c2, CASE WHEN t1 > 0 OR t2 > 0 THEN base*least({FOOT_TRAIL.format(t="t1")}, {FOOT_TRAIL.format(t="t2")}) ELSE base*0.5e0*(m1 + m2) END AS seconds FROM e2)"""


def multiplied(spark, sf_dir, mode="foot"):
    cells = view(spark, sf_dir, "fx_cells")
    graded = surface.with_grade(cells, CELL) if surface.MODES[mode].flat_degrees else cells.withColumn("grade", F.lit(0.0))
    return graded.withColumn("mult", surface.cost_multiplier(mode))


def grid_edges(spark, sf_dir, mode="foot", boundary="strict"):
    return routing.edges(multiplied(spark, sf_dir, mode), mode, CELL, boundary)


def number(r, c):
    return (C(r).cast("long") * STRIDE + C(c)).alias("n")


def tile(n, size=AREA):
    """The tile of a cell's number, as text."""
    return F.concat_ws(",", F.floor(n / STRIDE / size).cast("string"), F.floor(n % STRIDE / size).cast("string"))


def numbered(edges):
    """Cells as one number each."""
    return edges.select(number("r", "c").alias("a"), number("r2", "c2").alias("b"), C("seconds").alias("w"))


def inside(edges, name="area", size=AREA):
    """Edges that stay in a tile, with it."""
    return edges.where(tile(C("a"), size) == tile(C("b"), size)).withColumn(name, tile(C("a"), size))


@query("edge_cost", f"WITH {EDGES} SELECT r, c, r2, c2, round(seconds, 2) AS seconds FROM edge WHERE seconds < {INF}")
def edge_cost(spark, sf_dir):
    return grid_edges(spark, sf_dir).select("r", "c", "r2", "c2", F.round("seconds", 2).alias("seconds"))


def sssp(start: str, edges: str) -> str:
    return f"""WITH RECURSIVE {EDGES}, numbered AS (SELECT CAST(r AS BIGINT)*{STRIDE} + c AS a, CAST(r2 AS BIGINT)*{STRIDE} + c2 AS b, seconds FROM edge WHERE {edges}), dist(node, cost) USING KEY (node) AS (
  SELECT node, 0.0e0 AS cost FROM ({start}) UNION
  SELECT x.node, min(x.cost) AS cost FROM (SELECT b AS node, d.cost + e.seconds AS cost FROM dist d JOIN numbered e ON d.node = e.a) x LEFT JOIN recurring.dist o ON o.node = x.node WHERE o.cost IS NULL OR x.cost < o.cost - 1.0e-12 GROUP BY x.node)"""


#: Tiles of costs over the whole map: wider than areas, as each round reads the map's edges and rounds grow with the tiles that a path crosses.
WIDE = 1024


@query("sssp_costs", f"{sssp('SELECT CAST(1 AS BIGINT) AS node', 'true')} SELECT node, round(cost, 4) AS cost_s FROM dist")
def sssp_costs(spark, sf_dir):
    """Costs from one cell over the whole map, tile by tile."""
    wide = lambda r, c: F.floor(C(r) / WIDE) * STRIDE + F.floor(C(c) / WIDE)
    edges = grid_edges(spark, sf_dir).select(wide("r", "c").alias("tile"), number("r", "c").alias("a"), number("r2", "c2").alias("b"), wide("r2", "c2").alias("tile2"), C("seconds").alias("w"))
    sources = cells(spark, sf_dir).where("r = 0 and c = 1").select(wide("r", "c").alias("tile"), number("r", "c").alias("node"))
    return routing.costs_over_tiles(sources, edges).select("node", F.round("cost_s", 4).alias("cost_s"))


def cells(spark, sf_dir):
    return view(spark, sf_dir, "fx_cells")


#: Where the trips of an area go from its cell (0, 1), by row and column inside it.
GOALS = [(63, 63), (0, 63), (63, 0), (20, 20), (10, 15), (30, 34)]
AREA_OF = f"r // {AREA} = r2 // {AREA} AND c // {AREA} = c2 // {AREA}"
STARTS = f"SELECT CAST(r AS BIGINT)*{STRIDE} + c AS node FROM fx_cells WHERE r % {AREA} = 0 AND c % {AREA} = 1"


def trip_ends(spark, sf_dir):
    """A trip from each area's cell (0, 1) to each of GOALS; its number is its goal's."""
    areas = cells(spark, sf_dir).where((C("r") % AREA == 0) & (C("c") % AREA == 1)).select(C("r").cast("long").alias("r"), (C("c") - 1).cast("long").alias("c"))
    goals = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in GOALS])).alias("g")
    rows = areas.select((C("r") * STRIDE + C("c") + 1).alias("start"), "r", "c", goals)
    return rows.select("start", ((C("r") + C("g.r")) * STRIDE + C("c") + C("g.c")).alias("goal")).select(C("goal").alias("trip"), tile(C("start")).alias("area"), "start", "goal")


@query("astar_multigoal", f"{sssp(STARTS, AREA_OF)} SELECT node AS trip, round(cost, 4) AS cost_s FROM dist WHERE ({' OR '.join(f'(node // {STRIDE} % {AREA} = {r} AND node % {STRIDE} % {AREA} = {c})' for r, c in GOALS)})")
def astar_multigoal(spark, sf_dir):
    return trips(spark, sf_dir).where(C("cost_s") < float("inf")).select("trip", F.round("cost_s", 4).alias("cost_s"))


def trips(spark, sf_dir):
    asked = trip_ends(spark, sf_dir).select("trip", "area", F.array("start").alias("starts"), F.array("goal").alias("goals"))
    return routing.route(asked, inside(numbered(grid_edges(spark, sf_dir))), STRIDE)


@query("path_reconstruct")
def path_reconstruct(spark, sf_dir):
    out = trips(spark, sf_dir)
    return out.select("trip", F.posexplode("path").alias("i", "node")).select("trip", "i", F.floor(C("node") / STRIDE).cast("int").alias("r"), (C("node") % STRIDE).cast("int").alias("c"))


LAYER = STRIDE * STRIDE


def multimode_edges(spark, sf_dir):
    """Edges of four layers, a mode each, node = layer * LAYER + cell, with a minute to change to and from foot at road termini."""
    from .raster import termini

    layers = [inside(numbered(grid_edges(spark, sf_dir, m))).select("area", (C("a") + k * LAYER).alias("a"), (C("b") + k * LAYER).alias("b"), "w") for k, m in enumerate(surface.MODES)]
    at = termini(cells(spark, sf_dir)).select(number("r", "c"))
    both = [F.struct((C("n") + a).alias("a"), (C("n") + b).alias("b")) for k in range(1, len(layers)) for a, b in ((0, k * LAYER), (k * LAYER, 0))]
    out = at.select(tile(C("n")).alias("area"), F.explode(F.array(*both)).alias("e")).select("area", "e.a", "e.b", F.lit(60.0).alias("w"))
    for layer in layers:
        out = out.unionByName(layer)
    return out


@query("astar_multimode")
def astar_multimode(spark, sf_dir):
    """Trips that begin on foot and may end in any mode."""
    ends = [C("goal") + k * LAYER for k in range(len(surface.MODES))]
    asked = trip_ends(spark, sf_dir).select("trip", "area", F.array("start").alias("starts"), F.array(*ends).alias("goals"))
    found = routing.route(asked, multimode_edges(spark, sf_dir), STRIDE)
    names = F.array(*[F.lit(m) for m in surface.MODES])
    modes = F.array_sort(F.array_distinct(F.transform("path", lambda n: F.get(names, F.floor(n / LAYER).cast("int")))))
    return found.select("trip", F.round("cost_s", 4).alias("cost_s"), modes.alias("modes"))


CHUNK = 16
#: Entrances of a side, by place on it.
DOORS = [x for _, x in routing.entrances(CHUNK)[:5]]


def chunked(spark, sf_dir, modes=tuple(surface.MODES)):
    """In-chunk edges of every chunk and every mode, cells by their place in it."""
    out = None
    local = lambda n: (F.floor(n / STRIDE) % CHUNK * CHUNK + n % STRIDE % CHUNK).cast("long")
    for m in modes:
        part = inside(numbered(grid_edges(spark, sf_dir, m)), "chunk", CHUNK).select("chunk", F.lit(m).alias("mode"), local(C("a")).alias("a"), local(C("b")).alias("b"), "w")
        out = part if out is None else out.unionByName(part)
    return out


@query("hpa_build")
def hpa_build(spark, sf_dir):
    costs = routing.build_chunks(chunked(spark, sf_dir), CHUNK)
    return costs.select("chunk", "mode", "from_entrance", "to_entrance", F.round("cost_s", 6).alias("cost_s"))


def seams(edges):
    """Steps between facing entrances of neighbouring chunks, from edges (a, b, w)."""
    row, column = lambda n: F.floor(n / STRIDE), lambda n: n % STRIDE
    across = lambda one, other: (one(C("a")) == one(C("b"))) & (F.floor(other(C("a")) / CHUNK) != F.floor(other(C("b")) / CHUNK)) & (one(C("a")) % CHUNK).isin(*DOORS)
    return edges.where(across(row, column) | across(column, row))


SEAMS = " OR ".join(f"({x} = {x}2 AND {y} // {CHUNK} <> {y}2 // {CHUNK} AND {x} % {CHUNK} IN ({', '.join(map(str, DOORS))}))" for x, y in ("rc", "cr"))


@query("join_seams", f"WITH {EDGES} SELECT CAST(r AS BIGINT)*{STRIDE} + c AS a, CAST(r2 AS BIGINT)*{STRIDE} + c2 AS b, round(seconds, 4) AS seconds FROM edge WHERE seconds < {INF} AND ({SEAMS})")
def join_seams(spark, sf_dir):
    return seams(numbered(grid_edges(spark, sf_dir))).select("a", "b", F.round("w", 4).alias("seconds"))


def abstract(spark, sf_dir):
    """(routes, in-chunk edges): trips of each area over costs between entrances, steps between chunks and the trips' own ends."""
    from ..sources.writers import rewritten

    edges = rewritten(numbered(grid_edges(spark, sf_dir)), "edges")
    inner = inside(edges, "chunk", CHUNK)
    costs = routing.build_chunks(chunked(spark, sf_dir, ("foot",)), CHUNK)
    corner = F.split("chunk", ",")
    places = F.array(*[F.lit(r * STRIDE + c) for r, c in routing.entrances(CHUNK)])
    door = lambda k: corner[0].cast("long") * CHUNK * STRIDE + corner[1].cast("long") * CHUNK + F.get(places, k)
    between = rewritten(costs.select(door(C("from_entrance")).alias("a"), door(C("to_entrance")).alias("b"), C("cost_s").alias("w")), "between")
    graph = inside(between.unionByName(seams(edges)))
    ends = trip_ends(spark, sf_dir).select("trip", "area", "start", "goal", tile(C("start"), CHUNK).alias("chunk"), tile(C("goal"), CHUNK).alias("chunk2"))
    doors = between.select(tile(C("a"), CHUNK).alias("chunk"), C("a").alias("door")).unionByName(between.select(tile(C("b"), CHUNK).alias("chunk"), C("b").alias("door"))).distinct()
    return rewritten(routing.abstract_routes(ends, routing.pseudo_edges(ends, inner, doors), graph), "abstract"), inner


@query("hpa_abstract")
def hpa_abstract(spark, sf_dir):
    routes, _ = abstract(spark, sf_dir)
    return routes.where(C("cost_s") < float("inf")).select("trip", F.round("cost_s", 4).alias("cost_s"), F.size("hops").alias("hops"))


@query("hpa_refine")
def hpa_refine(spark, sf_dir):
    """Every cell of the abstract ways, in order."""
    routes, inner = abstract(spark, sf_dir)
    return routing.stitched(routes, inner, lambda n: tile(n, CHUNK)).select("trip", F.posexplode("path").alias("i", "cell"))


CX, CY = "CAST(floor({x}/(1.5e0/111.0e0)) AS BIGINT)", "CAST(floor(lat/(1.5e0/111.0e0)) AS BIGINT)"


@query(
    "hpa_gate",
    f"""WITH needed AS (SELECT trip, unnest(range({CX.format(x="lon")}, {CX.format(x="(lon + 0.03e0)")} + 1)) AS cx, {CY} AS cy FROM fx_trips),
    present AS (SELECT DISTINCT {CX.format(x="lon")} AS cx, {CY} AS cy FROM fx_entry_points WHERE highway_class <> 'service'),
    span AS (SELECT trip, min(cx) AS f, max(cx) AS l FROM needed GROUP BY trip),
    found AS (SELECT span.trip, count(db) AS dbs, min(db) AS db, min(profile) AS profile FROM span LEFT JOIN fx_tables ON l >= lo AND f <= hi GROUP BY span.trip),
    absent AS (SELECT DISTINCT trip FROM needed n WHERE NOT EXISTS (SELECT 1 FROM present p WHERE p.cx = n.cx AND p.cy = n.cy)),
    told AS (SELECT t.trip, db, CASE WHEN boundary <> 'pragmatic' THEN 'boundary_mode' WHEN affinity <> 1.0e0 THEN 'affinity' WHEN dbs = 0 THEN 'no_coverage' WHEN dbs > 1 THEN 'multi_region' WHEN profile <> 'now' THEN 'stale_profile' WHEN a.trip IS NOT NULL THEN 'missing_chunk' END AS fallback_reason
      FROM fx_trips t JOIN found USING (trip) LEFT JOIN absent a ON a.trip = t.trip)
    SELECT trip, fallback_reason, CASE WHEN fallback_reason IS NULL THEN db END AS db FROM told""",
)
def hpa_gate(spark, sf_dir):
    """Why each trip cannot use precomputed costs, from its request, the declared tables and the chunks that were built."""
    from ..functions import geo

    trips_ = view(spark, sf_dir, "fx_trips")
    needed_ = trips_.select("trip", F.explode(F.sequence(geo.chunk(C("lon")), geo.chunk(C("lon") + 0.03))).alias("cx"), geo.chunk(C("lat")).alias("cy"))
    tables = view(spark, sf_dir, "fx_tables")
    built = present(spark, sf_dir).join(F.broadcast(tables.select("db")))  # each declared table, of which there are a few dozen
    return routing.gate(trips_.select("trip", "boundary", F.array("affinity").alias("affinity")), needed_, tables, built, "now")


SNAP = """SELECT q.qid, min(2*6371000.0e0*asin(sqrt(pow(sin(radians(q.lat-e.lat)/2),2)+cos(radians(e.lat))*cos(radians(q.lat))*pow(sin(radians(q.lon-e.lon)/2),2)))) AS metres
  FROM (SELECT qid, lat + {off} AS lat, lon + {off} AS lon FROM fx_probe) q CROSS JOIN fx_entry_points e GROUP BY q.qid"""


def snap_metres(spark, sf_dir, offs):
    """How far the nearest entry point of the road network is from each probe, moved by each of ``offs`` degrees, in one search."""
    from ..operators.spatial import nearest

    moved = F.explode(F.array(*[F.struct(F.lit(k).alias("end"), (C("lat") + off).alias("lat"), (C("lon") + off).alias("lon")) for k, off in enumerate(offs)]))
    asked = view(spark, sf_dir, "fx_probe").select("qid", moved.alias("to")).select(F.struct("qid", "to.end").alias("qid"), "to.lat", "to.lon")
    return nearest(asked, view(spark, sf_dir, "fx_entry_points"), 1, (2_000.0, 8_000.0, 32_000.0), ["id"]).select("qid.qid", "qid.end", "metres")


@query("route_scenarios", f"SELECT qid, CASE WHEN a.metres <= 1000 AND b.metres <= 1000 THEN 'D' WHEN a.metres <= 1000 THEN 'B' WHEN b.metres <= 1000 THEN 'A' ELSE 'C' END AS scenario FROM ({SNAP.format(off='0.0e0')}) a JOIN ({SNAP.format(off='0.05e0')}) b USING (qid)")
def route_scenarios(spark, sf_dir):
    """Which ends of a trip stand on the network: both (D), the start (B), the end (A) or none (C)."""
    metres = snap_metres(spark, sf_dir, (0.0, 0.05))
    on = lambda k: F.min(F.when(C("end") == k, C("metres"))) <= 1000
    ends = metres.groupBy("qid").agg(on(0).alias("on_start"), on(1).alias("on_end")).where("on_start is not null and on_end is not null")
    return ends.select("qid", F.when(C("on_start") & C("on_end"), "D").when(C("on_start"), "B").when(C("on_end"), "A").otherwise("C").alias("scenario"))


NEEDED = "SELECT DISTINCT CAST(floor(lon/(1.5e0/111.0e0)) AS BIGINT) AS cx, CAST(floor(lat/(1.5e0/111.0e0)) AS BIGINT) AS cy FROM fx_points"
PRESENT = "SELECT DISTINCT CAST(floor(lon/(1.5e0/111.0e0)) AS BIGINT) AS cx, CAST(floor(lat/(1.5e0/111.0e0)) AS BIGINT) AS cy FROM fx_entry_points WHERE highway_class <> 'service'"


def chunks(df):
    from ..functions import geo

    return df.select(geo.chunk(C("lon")).alias("cx"), geo.chunk(C("lat")).alias("cy")).distinct()


def needed(spark, sf_dir):
    return chunks(view(spark, sf_dir, "fx_points"))


def present(spark, sf_dir):
    return chunks(view(spark, sf_dir, "fx_entry_points").where("highway_class <> 'service'"))


@query("agg_distinct_chunks", NEEDED)
def agg_distinct_chunks(spark, sf_dir):
    return needed(spark, sf_dir)


@query("join_coverage_anti", f"SELECT count(*)::BIGINT AS missing FROM (SELECT * FROM ({NEEDED}) EXCEPT SELECT * FROM ({PRESENT}))")
def join_coverage_anti(spark, sf_dir):
    return needed(spark, sf_dir).join(present(spark, sf_dir), ["cx", "cy"], "left_anti").agg(F.count("*").alias("missing"))


@query("except_chunks", f"SELECT * FROM ({NEEDED}) EXCEPT SELECT * FROM ({PRESENT})")
def except_chunks(spark, sf_dir):
    return needed(spark, sf_dir).subtract(present(spark, sf_dir))


@query("join_manifest_overlap", "SELECT q.qid, m.ord AS db FROM fx_probe q JOIN (VALUES (0, NULL, NULL), (1, -8659, -8620), (2, -8619, -8580)) m(ord, lo, hi) ON m.lo IS NULL OR (floor((q.lon + 0.05e0)/(1.5e0/111.0e0)) >= m.lo AND floor(q.lon/(1.5e0/111.0e0)) <= m.hi)")
def join_manifest_overlap(spark, sf_dir):
    from ..functions import geo

    manifest = spark.createDataFrame([(0, None, None), (1, -8659, -8620), (2, -8619, -8580)], "db int, lo long, hi long")  # three declared files
    lo, hi = geo.chunk(C("lon")), geo.chunk(C("lon") + 0.05)
    return view(spark, sf_dir, "fx_probe").join(F.broadcast(manifest), C("lo").isNull() | ((hi >= C("lo")) & (lo <= C("hi")))).select("qid", "db")


ALL = "['foot','2w','4w','vehicle']"


@query("fn_mode_eligibility_snap", "SELECT qid, list_filter(['foot', CASE WHEN (d <= 5 AND cls IN ('primary','residential')) OR (d <= 100 AND cls IN ('primary','residential') AND flat) THEN 'vehicle' END, CASE WHEN d <= 100 AND (cls IN ('primary','residential') OR use_tag = 'track') THEN '4w' END, CASE WHEN d <= 100 AND (cls IN ('primary','residential') OR use_tag IN ('track','path')) THEN '2w' END], lambda x: x IS NOT NULL) AS modes FROM (SELECT qid, (qid*31 % 150)::DOUBLE AS d, CASE qid % 4 WHEN 0 THEN 'primary' WHEN 1 THEN 'residential' ELSE 'service' END AS cls, CASE qid % 3 WHEN 0 THEN 'track' WHEN 1 THEN 'path' ELSE 'road' END AS use_tag, qid % 2 = 0 AS flat FROM fx_probe)")
def fn_mode_eligibility_snap(spark, sf_dir):
    return view(spark, sf_dir, "fx_probe").select("qid", snap_modes().alias("modes"))


def snap_modes():
    d, flat = (C("qid") * 31 % 150).cast("double"), C("qid") % 2 == 0
    cls, use = F.when(C("qid") % 4 == 0, "primary").when(C("qid") % 4 == 1, "residential").otherwise("service"), F.when(C("qid") % 3 == 0, "track").when(C("qid") % 3 == 1, "path").otherwise("road")
    paved = cls.isin("primary", "residential")
    vehicle = ((d <= 5) & paved) | ((d <= 100) & paved & flat)
    return F.array_compact(F.array(F.lit("foot"), F.when(vehicle, "vehicle"), F.when((d <= 100) & (paved | (use == "track")), "4w"), F.when((d <= 100) & (paved | use.isin("track", "path")), "2w")))


CATEGORY = "SELECT * FROM (VALUES ('amenity:parking', ['vehicle','4w']), ('highway:*', ['vehicle']), ('natural:*', ['foot'])) t(category, modes)"


@query("fn_mode_eligibility_cat", f"SELECT pid, coalesce(a.modes, b.modes) AS modes FROM (SELECT pid, CASE pid % 5 WHEN 0 THEN 'amenity:parking' WHEN 1 THEN 'amenity:cafe' WHEN 2 THEN 'highway:track' WHEN 3 THEN 'natural:peak' ELSE 'shop:x' END AS k FROM fx_points) p LEFT JOIN ({CATEGORY}) a ON a.category = k LEFT JOIN ({CATEGORY}) b ON b.category = split_part(k, ':', 1) || ':*'")
def fn_mode_eligibility_cat(spark, sf_dir):
    return with_category(view(spark, sf_dir, "fx_points").select("pid", "pid"), spark).select("pid", "modes")


def with_category(points, spark):
    m = C("pid") % 5
    k = F.when(m == 0, "amenity:parking").when(m == 1, "amenity:cafe").when(m == 2, "highway:track").when(m == 3, "natural:peak").otherwise("shop:x")
    known = spark.createDataFrame([("amenity:parking", ["vehicle", "4w"]), ("highway:*", ["vehicle"]), ("natural:*", ["foot"])], "category string, found array<string>")
    exact, wild = known.select(C("category").alias("k"), C("found").alias("exact")), known.select(C("category").alias("wild"), C("found").alias("general"))
    asked = points.select(points["pid"], k.alias("k"), F.concat(F.substring_index(k, ":", 1), F.lit(":*")).alias("wild"))
    return asked.join(F.broadcast(exact), "k", "left").join(F.broadcast(wild), "wild", "left").withColumn("modes", F.coalesce("exact", "general"))


@query("fn_seed_modes", f"SELECT pid, list_sort(list_distinct(list_concat(coalesce(a.modes, b.modes, ['2w']), ['foot']))) AS modes FROM (SELECT pid, CASE pid % 5 WHEN 0 THEN 'amenity:parking' WHEN 1 THEN 'amenity:cafe' WHEN 2 THEN 'highway:track' WHEN 3 THEN 'natural:peak' ELSE 'shop:x' END AS k FROM fx_points) p LEFT JOIN ({CATEGORY}) a ON a.category = k LEFT JOIN ({CATEGORY}) b ON b.category = split_part(k, ':', 1) || ':*'")
def fn_seed_modes(spark, sf_dir):
    typed = with_category(view(spark, sf_dir, "fx_points"), spark)
    return typed.select("pid", F.array_sort(F.array_union(F.coalesce("modes", F.array(F.lit("2w"))), F.array(F.lit("foot")))).alias("modes"))


@query("union_modes", "SELECT qid, list_sort(list_distinct(list_concat(CASE WHEN qid % 2 = 0 THEN ['foot','4w'] ELSE ['2w'] END, CASE WHEN qid % 3 = 0 THEN ['vehicle'] ELSE ['foot'] END))) AS modes FROM fx_probe")
def union_modes(spark, sf_dir):
    start = F.when(C("qid") % 2 == 0, F.array(F.lit("foot"), F.lit("4w"))).otherwise(F.array(F.lit("2w")))
    end = F.when(C("qid") % 3 == 0, F.array(F.lit("vehicle"))).otherwise(F.array(F.lit("foot")))
    return view(spark, sf_dir, "fx_probe").select("qid", F.array_sort(F.array_union(start, end)).alias("modes"))


@query("intersect_modes", "SELECT qid, list_sort(list_intersect(CASE WHEN qid % 2 = 0 THEN ['foot','4w'] ELSE ['2w','foot'] END, CASE WHEN qid % 3 = 0 THEN ['vehicle','4w'] ELSE ['foot'] END)) AS modes FROM fx_probe")
def intersect_modes(spark, sf_dir):
    start = F.when(C("qid") % 2 == 0, F.array(F.lit("foot"), F.lit("4w"))).otherwise(F.array(F.lit("2w"), F.lit("foot")))
    end = F.when(C("qid") % 3 == 0, F.array(F.lit("vehicle"), F.lit("4w"))).otherwise(F.array(F.lit("foot")))
    return view(spark, sf_dir, "fx_probe").select("qid", F.array_sort(F.array_intersect(start, end)).alias("modes"))


@query("fn_highway_priority", "SELECT id, coalesce(MAP {'primary': 3, 'residential': 6, 'service': 7, 'track': 8, 'path': 9}[highway_class], 99) AS priority FROM fx_entry_points")
def fn_highway_priority(spark, sf_dir):
    from ..functions.text import literal_map

    #: Order of road classes.
    order = {"motorway": 1, "trunk": 2, "primary": 3, "secondary": 4, "tertiary": 5, "residential": 6, "service": 7, "track": 8, "path": 9, "footway": 10}
    return view(spark, sf_dir, "fx_entry_points").select("id", F.coalesce(F.try_element_at(literal_map(order), C("highway_class")), F.lit(99)).alias("priority"))


@query("union_transitions", "SELECT r, c, from_mode, to_mode, min(src)::INTEGER AS source FROM (SELECT r, c, 'vehicle' AS from_mode, 'foot' AS to_mode, 1 AS src FROM fx_cells WHERE trail = 5 UNION ALL SELECT r, c, 'vehicle', 'foot', 2 FROM fx_cells WHERE c % 29 = 13 UNION ALL SELECT r, c, 'foot', '2w', 3 FROM fx_cells WHERE trail = 25) GROUP BY ALL")
def union_transitions(spark, sf_dir):
    part = lambda where, a, b, k: cells(spark, sf_dir).where(where).select("r", "c", F.lit(a).alias("from_mode"), F.lit(b).alias("to_mode"), F.lit(k).alias("source"))
    found = part("trail = 5", "vehicle", "foot", 1).unionByName(part("c % 29 = 13", "vehicle", "foot", 2)).unionByName(part("trail = 25", "foot", "2w", 3))
    return found.groupBy("r", "c", "from_mode", "to_mode").agg(F.min("source").alias("source"))
