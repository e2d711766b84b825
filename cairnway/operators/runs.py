"""Sequential rules over ordered rows of a route: Arrow kernels where a state decides, one route a group."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo

C = F.col
#: Surfaces and uses of road edges.
PAVED = ("paved_smooth", "paved", "paved_rough", "asphalt", "concrete", "concrete:lanes", "concrete:plates", "paving_stones", "sett", "cobblestone", "metal", "wood")
UNPAVED = ("compacted", "dirt", "gravel", "fine_gravel", "ground", "sand", "earth", "mud", "grass", "unpaved")
TRAIL_USES = ("path", "footway", "cycleway", "bridleway", "steps", "pedestrian", "mountain_bike", "sidewalk")
FEET, HALF_MILE_M, TURN = 3.28084, 804.672, 30.0


def surface_class(surface, use, road_class=None):
    """PAVED, UNPAVED, TRACK, TRAIL or null: what an edge is like."""
    s, u = F.lower(F.coalesce(surface, F.lit(""))), F.lower(F.coalesce(use, F.lit("")))
    r = F.lower(F.coalesce(road_class, F.lit(""))) if road_class is not None else F.lit("")
    track = (u == "track") | ((r == "service_other") & ~s.isin(*PAVED)) | (s.isin("dirt", "compacted") & (u == "road"))
    return F.when(u.isin(*TRAIL_USES), "TRAIL").when(track, "TRACK").when(s.isin(*UNPAVED), "UNPAVED").when(s.isin(*PAVED), "PAVED")


def merge_short(runs: list[tuple], shortest: float) -> list[tuple]:
    """Runs (category, metres, last row): the first one too short joins its neighbour before (the first its neighbour after),
    equal neighbours join, and so on until none is too short.

    Runs before the first short one are long enough and told apart, so they are a stack that each run is looked at once against.
    """
    done: list[list] = []
    for kind, metres, last in runs:
        if not done:
            done.append([kind, metres, last])
        elif done[0][1] < shortest:  # only the first run can be short here: it joins what comes after
            done[0] = [kind, done[0][1] + metres, last]
        elif kind == done[-1][0]:
            done[-1] = [kind, done[-1][1] + metres, last]
        elif metres < shortest:
            done[-1] = [done[-1][0], done[-1][1] + metres, last]
        else:
            done.append([kind, metres, last])
    return [tuple(r) for r in done]


#: A task sorts so many edges.
EDGES = 1_000_000


def collapsed(edges: DataFrame, shortest: float = 100.0) -> DataFrame:
    """(route_id, edge_no, category, length_m) -> the route's runs after short ones are gone: run, category, metres, last_edge.

    Tasks grow in number with the edges; each sorts its own and reads them once, with no more than a batch and one route's runs at hand.
    """
    spark = edges.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-edges.count() // EDGES))
    kind = pa.schema([("route_id", pa.int64()), ("run", pa.int32()), ("category", pa.string()), ("metres", pa.float64()), ("last_edge", pa.int64())])

    def merged(rows: pa.Table) -> tuple[pa.Table, np.ndarray]:
        """Neighbours of one route and category as one, and where routes begin."""
        route, codes = rows["route_id"].to_numpy(), pc.fill_null(rows["category"].combine_chunks().dictionary_encode().indices, -1).to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], (route[1:] != route[:-1]) | (codes[1:] != codes[:-1])]))
        ends = np.append(starts[1:], len(route)) - 1
        metres = np.add.reduceat(pc.fill_null(rows["length_m"], 0.0).to_numpy(), starts)
        out = rows.take(pa.array(ends)).set_column(3, "length_m", pa.array(metres))
        return out, np.flatnonzero(np.concatenate([[True], np.diff(route[starts]) != 0]))

    def told(rows: pa.Table, begins: np.ndarray):
        width = np.diff(begins, append=rows.num_rows)
        metres, last = rows["length_m"].to_numpy(), rows["edge_no"].to_numpy()
        folded = np.logical_or.reduceat(metres < shortest, begins) & (width > 1)
        at = np.flatnonzero(np.repeat(~folded, width))
        run = (np.arange(rows.num_rows) - np.repeat(begins, width) + 1)[at]
        as_is = rows.take(pa.array(at))
        yield [as_is["route_id"], pa.array(run, pa.int32()), as_is["category"], as_is["length_m"], as_is["edge_no"]]
        names, metres, last, out = rows["category"].to_pylist(), metres.tolist(), last.tolist(), []
        for route, a, n in zip(rows["route_id"].to_numpy()[begins[folded]].tolist(), begins[folded].tolist(), width[folded].tolist(), strict=True):
            out += [(route, i + 1, *r) for i, r in enumerate(merge_short(list(zip(names[a : a + n], metres[a : a + n], last[a : a + n], strict=True)), shortest))]
        if out:
            yield list(zip(*out, strict=True))

    def fold(batches):
        left = None  # runs so far of a route that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows, begins = merged(rows if left is None else pa.concat_tables([left, rows]))
            left = rows.slice(begins[-1])
            if len(begins) > 1:
                for columns in told(rows.slice(0, begins[-1]), begins[:-1]):
                    yield from pa.table(columns, schema=kind).to_batches()
        if left is not None:
            for columns in told(left, np.zeros(1, dtype=np.int64)):
                yield from pa.table(columns, schema=kind).to_batches()

    dealt = edges.select(C("route_id").cast("long"), C("edge_no").cast("long"), "category", C("length_m").cast("double")).repartition(tasks, "route_id").sortWithinPartitions("route_id", "edge_no")
    return dealt.mapInArrow(fold, "route_id long, run int, category string, metres double, last_edge long")


def _category(degrees: float) -> str:
    d = abs(degrees)
    return "flat" if d < 2 else "gentle" if d < 5 else "moderate" if d < 10 else "steep" if d < 15 else "very steep"


def segment_steps(steps: list[tuple]) -> list[tuple]:
    """Steps (metres, bearing, climb) -> segments (first, last, metres, bearing, gain, loss, category): a new one starts when the
    heading is over TURN from the segment's first, the grade's category differs from its first, or half a mile is full."""
    out, current = [], None
    for i, (metres, heading, climb) in enumerate(steps):
        kind = _category(math.degrees(math.atan(climb / metres)) if metres > 0 else 0.0)
        if current and current["metres"] > 0:
            off = abs(heading - current["bearing"])
            if min(off, 360 - off) > TURN or kind != current["kind"] or current["metres"] >= HALF_MILE_M:
                out.append(current)
                current = None
        if current is None:
            current = {"first": i, "metres": 0.0, "bearing": heading, "gain": 0.0, "loss": 0.0, "kind": kind}
        current["metres"] += metres
        current["gain" if climb > 0 else "loss"] += abs(climb)
        current["last"] = i
    if current:
        out.append(current)
    return [(s["first"], s["last"], s["metres"], s["bearing"], s["gain"], s["loss"], s["kind"]) for s in out]


def maneuvers(points: DataFrame) -> DataFrame:
    """(route_id, i, lat, lon, elev_m) -> turn-by-turn segments of each route with an instruction."""
    from .lines import steps

    legs = steps(points.withColumn("before", F.lag("elev_m").over(_by()))).where("step_m is not null")
    legs = legs.select("route_id", "i", "step_m", geo.bearing(C("prev_lat"), C("prev_lon"), C("lat"), C("lon")).alias("bearing"), (C("elev_m") - C("before")).alias("climb"))

    lists = legs.groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("i", "step_m", "bearing", "climb"))).alias("steps"))

    def fold(batches):
        for batch in batches:
            rows = [(route, n + 1, *s) for route, own in zip(batch.route_id, batch.steps, strict=True) for n, s in enumerate(segment_steps([(x["step_m"], x["bearing"], x["climb"]) for x in own]))]
            yield pd.DataFrame(rows, columns=["route_id", "n", "first_step", "last_step", "metres", "bearing", "gain_m", "loss_m", "grade"])

    folded = lists.mapInPandas(fold, "route_id long, n int, first_step int, last_step int, metres double, bearing double, gain_m double, loss_m double, grade string")
    feet = lambda c: F.format_number(F.bround(c * FEET), 0)
    from ..functions.text import format_distance

    toward, far = geo.cardinal16(C("bearing")), format_distance(C("metres"))
    up = F.bround(C("gain_m") * FEET) > F.bround(C("loss_m") * FEET)
    said = F.when(C("grade") == "flat", F.concat(F.lit("Head "), toward, F.lit(" on level ground — "), far)).when(up, F.concat(F.lit("Head "), toward, F.lit(", gaining "), feet(C("gain_m")), F.lit(" ft ("), C("grade"), F.lit(" uphill) — "), far)).otherwise(F.concat(F.lit("Head "), toward, F.lit(", descending "), feet(C("loss_m")), F.lit(" ft ("), C("grade"), F.lit(" downhill) — "), far))
    return folded.withColumn("instruction", said)


def _by():
    from pyspark.sql.window import Window

    return Window.partitionBy("route_id").orderBy("i")
