"""Operators on lines: ordered points of a route, segments, densification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo


def steps(points: DataFrame, route: str = "route_id", order: str = "i") -> DataFrame:
    """Points with the distance from the one before (``step_m``) and the distance so far (``along_m``)."""
    by = Window.partitionBy(route).orderBy(order)
    out = points.withColumn("prev_lat", F.lag("lat").over(by)).withColumn("prev_lon", F.lag("lon").over(by))
    out = out.withColumn("step_m", geo.haversine(F.col("prev_lat"), F.col("prev_lon"), F.col("lat"), F.col("lon")))
    return out.withColumn("along_m", F.coalesce(F.sum("step_m").over(by.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)))


def densify(segments: DataFrame, spacing_m: float = 100.0) -> DataFrame:
    """Evenly spaced points along each segment (lat, lon, lat2, lon2), both ends included: columns k, at_lat, at_lon."""
    length = geo.haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    gaps = F.greatest(F.lit(2).cast("long"), (length / spacing_m).cast("long") + 1) - 1
    out = segments.withColumn("gaps", gaps).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("gaps"))))
    share = F.col("k") / F.col("gaps")
    return out.withColumn("at_lat", F.col("lat") + (F.col("lat2") - F.col("lat")) * share).withColumn("at_lon", F.col("lon") + (F.col("lon2") - F.col("lon")) * share)


def islands(rows: DataFrame, value: str, by: str = "route_id", order: str = "i") -> DataFrame:
    """Number runs of equal ``value`` (null is a value of its own) as ``run``, from 1."""
    w = Window.partitionBy(by).orderBy(order)
    start = F.when(F.row_number().over(w) == 1, 1).when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)
    return rows.withColumn("starts", start).withColumn("run", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("starts")


def buffered(segments: DataFrame, metres: float, corners: int = 8) -> DataFrame:
    """Segments (lat1, lon1, lat2, lon2) with ``ring``: a closed polygon ``metres`` wide on each side, ends rounded by half circles."""
    import math

    turn = F.radians(geo.bearing(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")))
    scale = F.greatest(F.lit(0.01), F.cos(F.radians("lat1")))

    def at(lat, lon, angle):
        return F.struct((lon + metres / geo.DEG_M * F.sin(angle) / scale).alias("lon"), (lat + metres / geo.DEG_M * F.cos(angle)).alias("lat"))

    steps = F.sequence(F.lit(0), F.lit(corners))
    far = F.transform(steps, lambda k: at(F.col("lat2"), F.col("lon2"), turn - math.pi / 2 + k * (math.pi / corners)))
    back = F.transform(steps, lambda k: at(F.col("lat1"), F.col("lon1"), turn + math.pi / 2 + k * (math.pi / corners)))
    return segments.withColumn("ring", F.concat(far, back, F.slice(far, 1, 1)))
