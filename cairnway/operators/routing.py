"""Least-cost routing: an edge table from a cell table, and shortest paths over edge tables.

Edge costs are column expressions, so Catalyst plans them as one self-join on the neighbour's cell.  Searching is inherently
sequential: every route is a group of its own for an Arrow kernel, which gets the edges of its own area only.  Areas too
large for one task go through :func:`build_chunks` (costs between the entrances of each chunk, one task a chunk) and an
abstract graph that is smaller by the area of a chunk.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import surface
from ..sources.writers import bucketed, rewritten

C = F.col
OFFSETS = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]


def edge_seconds(mode: str, boundary: str = "strict", up: bool = True) -> Column:
    """Seconds from a cell to its neighbour (columns with a trailing 2), or back, infinity where it cannot be gone.

    Needs elev_m, mult, trail, barrier of both ends, their distance ``dist`` and the ``grade`` of the way there.
    """
    inf = F.lit(float("inf"))
    over = F.abs("grade") - surface.max_grade(mode)
    penalty = F.when(over > 0, F.exp(over * surface.SLOPE_SCALE)).otherwise(1.0)
    kmh = surface.speed(C("grade") if up else -C("grade"), mode)
    friction = lambda t: F.when(t == 0, inf).otherwise(surface.trail_friction(t, mode))
    trail = F.least(friction(C("trail")), friction(C("trail2")))
    factor = F.when((C("trail") > 0) | (C("trail2") > 0), trail).otherwise(0.5 * (C("mult") + C("mult2")))
    walled = (C("barrier") == 255) | (C("barrier2") == 255)
    if boundary == "strict":
        factor = F.when(walled, inf).otherwise(factor)
    edge = C("dist") * 3.6 / kmh * penalty * factor
    if boundary == "pragmatic":
        edge = edge * F.when(walled, F.lit(float(surface.PRIVATE_LAND))).otherwise(1.0)
    bad = C("elev_m").isNull() | C("elev_m2").isNull() | (penalty > surface.SLOPE_CAP) | (kmh <= 1e-9)
    return F.when(bad, inf).otherwise(edge)


def edges(cells: DataFrame, mode: str, cell_m: float, boundary: str = "strict", by: list[str] | None = None) -> DataFrame:
    """(r, c, elev_m, mult, trail, barrier) -> r, c, r2, c2, seconds for every passable step to one of eight neighbours."""
    keys = by or []
    here = cells.select(*keys, "r", "c", "elev_m", "mult", "trail", "barrier")
    there = here.select(*keys, *[C(x).alias(f"{x}2") for x in ("r", "c", "elev_m", "mult", "trail", "barrier")])
    # Each pair of cells is met once, by the one that comes first, and tells the steps both ways.
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in OFFSETS if (a, b) > (0, 0)]))
    # Each cell is looked up once for each neighbour: hashing the cells spares sorting four times as many steps.
    met = here.withColumn("s", step).select("*", "s.dr", "s.dc").withColumn("r2", C("r") + C("dr")).withColumn("c2", C("c") + C("dc")).join(there.hint("shuffle_hash"), [*keys, "r2", "c2"])
    met = met.withColumn("dist", F.sqrt(C("dr") * C("dr") + C("dc") * C("dc")) * cell_m).withColumn("grade", (C("elev_m2") - C("elev_m")) / C("dist"))
    # Costs are told by a generator: a filter on them is not worked out with them in the join again.
    way = lambda a, b, up: F.struct(C("r" + a).alias("r"), C("c" + a).alias("c"), C("r" + b).alias("r2"), C("c" + b).alias("c2"), edge_seconds(mode, boundary, up).alias("seconds"))
    told = met.select(*keys, F.explode(F.array(way("", "2", True), way("2", "", False))).alias("e")).select(*keys, "e.*")
    return told.where(C("seconds") < float("inf"))


def adjacency(table: pd.DataFrame) -> dict:
    out: dict = {}
    for a, b, w in zip(table.a, table.b, table.w, strict=True):
        out.setdefault(a, []).append((b, w))
    return out


def shortest(graph: dict, starts: dict, goals: set):
    """(cost, path) to the first goal settled, from several weighted starts; (inf, []) where none can be reached.  With no goals,
    (costs of all nodes, parents)."""
    best, parent, done, heap = dict(starts), {}, set(), [(d, n) for n, d in starts.items()]
    heapq.heapify(heap)
    while heap:
        d, n = heapq.heappop(heap)
        if n in done:
            continue
        done.add(n)
        if n in goals:
            path = [n]
            while path[-1] in parent:
                path.append(parent[path[-1]])
            return d, path[::-1]
        for m, w in graph.get(n, ()):
            if d + w < best.get(m, float("inf")):
                best[m], parent[m] = d + w, n
                heapq.heappush(heap, (d + w, m))
    return (float("inf"), []) if goals else (best, parent)


class Area:
    """The edges of one area as arrays by source node (compressed rows), searched by A* for one trip after the other."""

    def __init__(self, table: pd.DataFrame, side: int | None):
        a, b = table.a.to_numpy(np.int64), table.b.to_numpy(np.int64)
        self.nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
        self.at = {int(n): i for i, n in enumerate(self.nodes)}
        source, order = ends[: len(a)], np.argsort(ends[: len(a)], kind="stable")
        self.first = np.searchsorted(source[order], np.arange(len(self.nodes) + 1))
        self.to, self.w = ends[len(a) :][order], table.w.to_numpy(float)[order]
        self.side, self.rate = side, 0.0
        if side:
            cell = self.nodes % (side * side)
            self.r, self.c = cell // side, cell % side
            length = self._octile(self.r[source[order]] - self.r[self.to], self.c[source[order]] - self.c[self.to])
            # No step is cheaper than this a cell, so distance times rate never exceeds the cost that is left.
            self.rate = float((self.w[length > 0] / length[length > 0]).min(initial=np.inf)) if (length > 0).any() else 0.0

    @staticmethod
    def _octile(dr, dc):
        dr, dc = np.abs(dr), np.abs(dc)
        return np.maximum(dr, dc) + (np.sqrt(2) - 1) * np.minimum(dr, dc)

    def _left(self, goals: list[int]) -> np.ndarray:
        """A lower bound of what is left from every node to the nearest goal."""
        if not self.rate or not len(goals):
            return np.zeros(len(self.nodes))
        return (1 - 1e-12) * self.rate * np.min([self._octile(self.r - self.r[g], self.c - self.c[g]) for g in goals], axis=0)

    def search(self, starts, goals) -> tuple[float, list[int]]:
        goals = [self.at[g] for g in goals if g in self.at]
        left, wanted = self._left(goals), set(goals)
        best = np.full(len(self.nodes), np.inf)
        parent, done, heap = np.full(len(self.nodes), -1), np.zeros(len(self.nodes), dtype=bool), []
        for s in starts:
            if s in self.at:
                best[self.at[s]] = 0.0
                heapq.heappush(heap, (left[self.at[s]], self.at[s]))
        while heap and wanted:
            _, n = heapq.heappop(heap)
            if done[n]:
                continue
            done[n] = True
            if n in wanted:
                path = [n]
                while parent[path[-1]] >= 0:
                    path.append(int(parent[path[-1]]))
                return float(best[n]), self.nodes[path[::-1]].tolist()
            lo, hi = self.first[n], self.first[n + 1]
            to, cost = self.to[lo:hi], best[n] + self.w[lo:hi]
            for m, d in zip(to[cost < best[to]].tolist(), cost[cost < best[to]].tolist(), strict=True):
                if d < best[m]:
                    best[m], parent[m] = d, n
                    heapq.heappush(heap, (d + left[m], m))
        return float("inf"), []


def route(trips: DataFrame, graph: DataFrame, side: int | None = None, together: int = 500) -> DataFrame:
    """``trips`` (trip, area, starts array<long>, goals array<long>) over edges (area, a, b, w): cost and path of each trip.

    An area's edges go to a task once for ``together`` of its trips, which are searched one after the other; areas, and blocks
    of trips of a busy area, run side by side.  With ``side`` (cells a row of the area's grid; nodes are row-major, layers follow
    each other) the search is A* with an admissible bound, else it is Dijkstra's.
    """
    blocks = trips.groupBy("area").agg(F.ceil(F.count("*") / together).alias("blocks"))
    dealt = trips.join(blocks, "area").withColumn("block", F.pmod(F.xxhash64("trip"), "blocks")).drop("blocks")
    sent = graph.join(blocks, "area").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), C("blocks") - 1))).select("area", "block", "a", "b", "w")

    def run(key: tuple, asked: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        area = Area(own, side)
        found = [area.search(t.starts, t.goals) for t in asked.itertuples()]
        return pd.DataFrame({"trip": asked.trip, "cost_s": [c for c, _ in found], "path": [p for _, p in found]})

    return dealt.groupBy("area", "block").cogroup(sent.groupBy("area", "block")).applyInPandas(run, "trip long, cost_s double, path array<long>")


def costs_from(sources: DataFrame, graph: DataFrame) -> DataFrame:
    """``sources`` (area, source) over edges (area, a, b, w): the cost of every node that a source reaches."""

    def run(key: tuple, wanted: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        around, out = adjacency(own), []
        for s in wanted.source:
            best, _ = shortest(around, {s: 0.0}, set())
            out.append(pd.DataFrame({"area": key[0], "source": s, "node": list(best), "cost_s": list(best.values())}))
        return pd.concat(out) if out else pd.DataFrame({"area": [], "source": [], "node": [], "cost_s": []})

    return sources.groupBy("area").cogroup(graph.groupBy("area")).applyInPandas(run, "area string, source long, node long, cost_s double")


def entrances(size: int) -> list[tuple[int, int]]:
    """Twenty border cells of a chunk: five a side at sixths, clockwise from the top; halves go to the even cell."""
    at = [round((size - 1) * (k + 1) / 6) for k in range(5)]
    return [*[(0, x) for x in at], *[(x, size - 1) for x in at], *[(size - 1, x) for x in at], *[(x, 0) for x in at]]


def all_costs(starts: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray, nodes: int) -> np.ndarray:
    """Costs of all nodes from all ``starts`` at once (a row a node), over edges of a small graph: every node takes the best that its
    neighbours tell, for all starts, until nothing changes.  They are the sums that a search from each start has."""
    cost = np.full((nodes, len(starts)), np.inf)
    cost[starts, np.arange(len(starts))] = 0.0
    order = np.argsort(b, kind="stable")
    a, b, w = a[order], b[order], w[order, None]
    first = np.flatnonzero(np.diff(b, prepend=-1))
    to, ways = b[first], np.empty((len(a), len(starts)))
    while len(to):
        np.take(cost, a, axis=0, out=ways, mode="clip")
        ways += w
        had = cost[to]
        told = np.minimum(np.minimum.reduceat(ways, first, axis=0), had)
        if np.array_equal(told, had):
            break
        cost[to] = told
    return cost


def build_chunks(graph: DataFrame, size: int) -> DataFrame:
    """Costs between all entrances of a chunk (chunk, mode, a, b, w) with a = row * size + col inside it; finite ones only."""
    doors = np.array([r * size + c for r, c in entrances(size)])

    def run(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        costs = all_costs(doors, own.a.to_numpy(np.int64), own.b.to_numpy(np.int64), own.w.to_numpy(np.float64), size * size)[doors].T
        i, j = np.nonzero((costs < np.inf) & ~np.eye(len(doors), dtype=bool))
        return pd.DataFrame({"chunk": key[0], "mode": key[1], "from_entrance": i, "to_entrance": j, "cost_s": costs[i, j]})

    return graph.groupBy("chunk", "mode").applyInPandas(run, "chunk string, mode string, from_entrance int, to_entrance int, cost_s double")


def _compressed(a: np.ndarray, b: np.ndarray, w: np.ndarray, more: np.ndarray) -> tuple:
    """Edges inside a tile, and the nodes ``more``, as arrays: nodes, where each one's edges begin, their ends as places among the nodes, their costs."""
    order = np.argsort(a, kind="stable")
    a, b, w = a[order], b[order], w[order]
    nodes = a[np.concatenate([[True], a[1:] != a[:-1]])] if len(a) else a
    for others in (b, more):  # nodes from which no edge leads on inside the tile
        at = np.minimum(np.searchsorted(nodes, others), max(len(nodes) - 1, 0))
        lone = others[nodes[at] != others] if len(nodes) else others
        nodes = np.union1d(nodes, lone) if len(lone) else nodes
    return nodes, np.searchsorted(a, np.append(nodes, np.iinfo(np.int64).max)), np.searchsorted(nodes, b).astype(np.int32), w


def _settle(first: np.ndarray, to: np.ndarray, w: np.ndarray, cost: np.ndarray, news: np.ndarray) -> np.ndarray:
    """Settle in ``cost`` what the new costs of the nodes ``news`` change, and tell which nodes have changed.

    All nodes within a step of the cheapest that wait go at once, over all their edges, until none of them changes any more: costs are
    the same sums as those of one node after the other.
    """
    changed, waits = np.zeros(len(cost), dtype=bool), np.zeros(len(cost), dtype=bool)
    changed[news] = waits[news] = True
    step, far = 2.0 * float(np.median(w)) if len(w) else 0.0, news
    while len(far):
        limit = cost[far].min() + step
        now = far[cost[far] <= limit]
        later = [far[cost[far] > limit]]
        while len(now):
            waits[now] = False
            begin, n = first[now], first[now + 1] - first[now]
            edge = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
            end, reached = to[edge], np.repeat(cost[now], n) + w[edge]
            better = reached < cost[end]
            end, reached = end[better], reached[better]
            np.minimum.at(cost, end, reached)
            changed[end] = True
            end = np.unique(end[~waits[end]])
            waits[end] = True
            now = end[cost[end] <= limit]
            later.append(end[cost[end] > limit])
        far = np.concatenate(later)
        far = far[waits[far]]
    return np.flatnonzero(changed)


def costs_over_tiles(sources: DataFrame, graph: DataFrame) -> DataFrame:
    """``sources`` (tile, node) over edges (tile, a, b, tile2, w): tile, node and cost_s of all that they reach, however large the map.

    Tiles that have news settle what it changes, each in its own task, and tell the tiles next to them; what they know, and the news,
    are written each round.  Rounds grow with the number of tiles that a path crosses, not with its cells.  A tile is of
    bounded size: its edges are packed into arrays once and read in place by tile, and what it knows is a row of two arrays.  The driver
    keeps the round in which each tile was settled last, a number a tile.
    """
    spark, kind = graph.sparkSession, graph.schema["tile"].dataType.simpleString()
    packed_ = f"tile {kind}, nodes binary, first binary, ends binary, w binary, at binary, b binary, over binary, tiles array<{kind}>"
    state, names = f"tile {kind}, fresh boolean, nodes binary, costs binary", ["tile", "fresh", "nodes", "costs"]

    def pack(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        inner, across = own[own.tile2.isna()], own[own.tile2.notna()]
        leave = across.a.to_numpy(np.int64)
        nodes, first, ends, w = _compressed(inner.a.to_numpy(np.int64), inner.b.to_numpy(np.int64), inner.w.to_numpy(np.float64), leave)
        at = np.searchsorted(nodes, leave)
        which, tiles = pd.factorize(across.tile2)
        parts = (nodes, first, ends, w, at, across.b.to_numpy(np.int64), np.stack([across.w.to_numpy(np.float64), which.astype(np.float64)]))
        return pd.DataFrame([(key[0], *(x.tobytes() for x in parts), list(tiles))], columns=[c.split()[0] for c in packed_.split(", ")])

    outside = F.when(C("tile") != C("tile2"), C("tile2")).alias("tile2")
    edges_ = bucketed(graph.select("tile", "a", "b", outside, "w").groupBy("tile").applyInPandas(pack, packed_), "tile", "tile_edges")

    def run(key: tuple, rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame([], columns=names)
        old, news = rows[~rows.fresh.astype(bool)], rows[rows.fresh.astype(bool)]
        seen, paid = (np.concatenate([np.frombuffer(x, dtype=kind) for x in column]) for column, kind in ((news.nodes, np.int64), (news.costs, np.float64)))
        row = next(own.itertuples()) if len(own) else None
        part = lambda name, kind: np.frombuffer(getattr(row, name), dtype=kind) if row is not None else np.zeros(0, dtype=kind)
        first, ends, w = part("first", np.int64), part("ends", np.int32), part("w", np.float64)
        nodes = np.frombuffer(old.nodes.iloc[0], dtype=np.int64) if len(old) else part("nodes", np.int64)
        cost = np.frombuffer(old.costs.iloc[0], dtype=np.float64) if len(old) else np.full(len(nodes), np.inf)
        lone = np.setdiff1d(seen, nodes[np.isin(nodes, seen)])  # that have no edges here
        nodes, cost = np.concatenate([nodes, lone]), np.concatenate([cost, np.full(len(lone), np.inf)])
        first = np.concatenate([first, np.full(len(nodes) + 1 - len(first), len(w))])
        order = np.argsort(nodes, kind="stable")
        place = order[np.searchsorted(nodes, seen, sorter=order)]
        better = paid < cost[place]
        if not better.any():
            return pd.DataFrame([], columns=names)
        np.minimum.at(cost, place[better], paid[better])
        changed = np.zeros(len(nodes), dtype=bool)
        changed[_settle(first, ends, w, cost, np.unique(place[better]))] = True
        out = [(key[0], False, nodes.tobytes(), cost.tobytes())]
        at, over = part("at", np.int64), part("over", np.float64).reshape(2, -1)
        sent = np.flatnonzero(changed[at])
        to, told, where = part("b", np.int64)[sent], cost[at[sent]] + over[0][sent], over[1][sent].astype(np.int64)
        for k in np.unique(where):
            mine = np.flatnonzero(where == k)
            once, which = np.unique(to[mine], return_inverse=True)
            least = np.full(len(once), np.inf)
            np.minimum.at(least, which, told[mine])
            out.append((row.tiles[k], True, once.tobytes(), least.tobytes()))
        return pd.DataFrame(out, columns=names)

    def first_news(batches):
        for batch in batches:
            yield pd.DataFrame([(t, True, np.int64(n).tobytes(), np.float64(0.0).tobytes()) for t, n in zip(batch.tile, batch.node, strict=True)], columns=names)

    rounds = [rewritten(sources.select("tile", "node").distinct().mapInPandas(first_news, state), "tile_costs")]
    settled: dict = {}  # the round of each tile
    while True:
        last = len(rounds) - 1
        told = rounds[last].select("tile", "fresh").distinct().collect()  # tiles that have been settled, and those next to them
        settled |= {r.tile: last for r in told if not r.fresh}
        active = [r.tile for r in told if r.fresh]
        if not active:
            break
        rows = rounds[last].where("fresh")
        for k in sorted({settled[t] for t in active if t in settled}):
            rows = rows.unionByName(rounds[k].where(~C("fresh") & C("tile").isin([t for t in active if settled.get(t) == k])))
        rounds.append(rewritten(rows.groupBy("tile").cogroup(edges_.where(C("tile").isin(active)).groupBy("tile")).applyInPandas(run, state), "tile_costs"))

    def unpacked(batches):
        for batch in batches:
            for row in batch.itertuples():
                nodes, cost = np.frombuffer(row.nodes, dtype=np.int64), np.frombuffer(row.costs, dtype=np.float64)
                yield pd.DataFrame({"tile": row.tile, "node": nodes[cost < np.inf], "cost_s": cost[cost < np.inf]})

    known = rounds[0].limit(0)
    for k in sorted(set(settled.values())):
        known = known.unionByName(rounds[k].where(~C("fresh") & C("tile").isin([t for t, at in settled.items() if at == k])))
    return known.mapInPandas(unpacked, f"tile {kind}, node long, cost_s double")


def pseudo_edges(trips: DataFrame, inner: DataFrame, doors: DataFrame) -> DataFrame:
    """``trips`` (trip, chunk, start, chunk2, goal) over in-chunk edges (chunk, a, b, w): edges of each trip from its start to the
    doors (chunk, door) of its chunk, and from the doors of the goal's chunk to the goal; straight to it in the same chunk."""
    ends = trips.select("trip", "chunk", C("start").alias("cell"), F.lit(True).alias("out"), F.when(C("chunk") == C("chunk2"), C("goal")).alias("other"))
    ends = ends.unionByName(trips.select("trip", C("chunk2").alias("chunk"), C("goal").alias("cell"), F.lit(False).alias("out"), F.lit(None).cast("long").alias("other")))
    wanted = ends.unionByName(doors.select(F.lit(None).cast("long").alias("trip"), "chunk", C("door").alias("cell"), F.lit(None).cast("boolean").alias("out"), F.lit(None).cast("long").alias("other")))

    def run(key: tuple, rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        asked = rows[rows.trip.notna()]
        exits, forward, back, out = rows[rows.trip.isna()].cell.tolist(), adjacency(own), None, []
        for t in asked.itertuples():
            if t.out:
                best, _ = shortest(forward, {t.cell: 0.0}, set())
                out += [(int(t.trip), t.cell, d, best[d]) for d in {*exits, *([int(t.other)] if t.other == t.other and t.other is not None else [])} if d in best]
            else:
                back = back or adjacency(own.rename(columns={"a": "b", "b": "a"}))
                best, _ = shortest(back, {t.cell: 0.0}, set())
                out += [(int(t.trip), d, t.cell, best[d]) for d in exits if d in best]
        return pd.DataFrame(out, columns=["trip", "a", "b", "w"])

    chunks = ends.select("chunk").distinct()
    return wanted.join(chunks, "chunk", "left_semi").groupBy("chunk").cogroup(inner.join(chunks, "chunk", "left_semi").groupBy("chunk")).applyInPandas(run, "trip long, a long, b long, w double")


def abstract_routes(trips: DataFrame, pseudo: DataFrame, graph: DataFrame) -> DataFrame:
    """``trips`` (trip, area, start, goal) over the abstract edges of their area (area, a, b, w) and their own pseudo edges: cost, and
    the cells at which the way changes chunks."""
    own = trips.select("trip", "area", "start", "goal").join(pseudo, "trip", "left")

    def run(key: tuple, rows: pd.DataFrame, edges_: pd.DataFrame) -> pd.DataFrame:
        around, out = adjacency(edges_), []
        for trip, mine in rows.groupby("trip"):
            start, goal = int(mine.start.iloc[0]), int(mine.goal.iloc[0])
            extra = adjacency(mine[mine.w.notna()].astype({"a": "int64", "b": "int64"}))
            graph_ = around | {n: around.get(n, []) + e for n, e in extra.items()}
            out.append((trip, *shortest(graph_, {start: 0.0}, {goal})))
        return pd.DataFrame(out, columns=["trip", "cost_s", "hops"])

    return own.groupBy("area").cogroup(graph.groupBy("area")).applyInPandas(run, "trip long, cost_s double, hops array<long>")


def stitched(routes: DataFrame, inner: DataFrame, chunk_of) -> DataFrame:
    """``routes`` (trip, hops) to whole paths (trip, path): a hop inside a chunk becomes the way through it, found once for all trips
    that take it; a hop between chunks is a step.  ``chunk_of`` makes a chunk of a cell."""
    pairs = F.transform(F.sequence(F.lit(1), F.size("hops") - 1), lambda i: F.struct(i.alias("i"), F.get("hops", i - 1).alias("a"), F.get("hops", i).alias("b")))
    hops = routes.where(F.size("hops") > 1).select("trip", F.explode(pairs).alias("h")).select("trip", "h.i", "h.a", "h.b")
    hops = rewritten(hops.withColumn("area", F.when(chunk_of(C("a")) == chunk_of(C("b")), chunk_of(C("a")))), "hops")
    once = hops.where("area is not null").select("area", "a", "b").distinct()
    asked = once.select(F.xxhash64("a", "b").alias("trip"), "area", F.array("a").alias("starts"), F.array("b").alias("goals"))
    ways = route(asked, inner.select(C("chunk").alias("area"), "a", "b", "w")).select(F.element_at("path", 1).alias("a"), F.element_at("path", -1).alias("b"), "path")
    steps = hops.join(ways, ["a", "b"], "left").select("trip", "i", F.coalesce(F.slice("path", F.lit(2), F.size("path")), F.array("b")).alias("rest"))
    joined = steps.groupBy("trip").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "rest"))), lambda s: s["rest"])).alias("rest"))
    out = routes.where(F.size("hops") > 0).join(joined, "trip", "left")
    return out.select("trip", "cost_s", F.concat(F.slice("hops", 1, 1), F.coalesce("rest", F.array().cast("array<long>"))).alias("path"))


def gate(trips: DataFrame, needed: DataFrame, tables: DataFrame, present: DataFrame, profile: str) -> DataFrame:
    """Why a trip cannot use precomputed chunk costs: ``fallback_reason``, null where it can, and ``db``, the table to use.

    ``trips`` (trip, boundary, affinity array<double>), ``needed`` (trip, cx, cy: the chunks on its way), ``tables`` (db, lo, hi, profile:
    declared files and the chunk columns they cover, unbounded where null) and ``present`` (db, cx, cy: chunks that were built).
    Configuration comes first, then coverage by exactly one table, then its freshness, then whether all chunks are there.
    """
    span = needed.groupBy("trip").agg(F.min("cx").alias("first"), F.max("cx").alias("last"))
    covers = (C("lo").isNull() | (C("last") >= C("lo"))) & (C("hi").isNull() | (C("first") <= C("hi")))
    # Declared files are few: a manifest lists them.
    found = span.join(F.broadcast(tables), covers, "left").groupBy("trip").agg(F.count("db").alias("dbs"), F.min("db").alias("db"), F.min("profile").alias("profile"))
    one = found.where("dbs = 1").select("trip", "db")
    absent = needed.join(one, "trip").join(present, ["db", "cx", "cy"], "left_anti").select("trip").distinct().withColumn("absent", F.lit(True))
    out = trips.join(found, "trip", "left").join(absent, "trip", "left")
    odd = F.exists(F.coalesce("affinity", F.array().cast("array<double>")), lambda v: v != 1.0)
    reason = (
        F.when(C("boundary") != "pragmatic", "boundary_mode").when(odd, "affinity").when(F.coalesce("dbs", F.lit(0)) == 0, "no_coverage").when(C("dbs") > 1, "multi_region")
        .when(C("profile").isNull() | (C("profile") != profile), "stale_profile").when(C("absent"), "missing_chunk")
    )
    return out.select("trip", reason.alias("fallback_reason"), F.when(reason.isNull(), C("db")).alias("db"))
