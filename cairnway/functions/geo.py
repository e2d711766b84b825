"""Geodesy as column expressions; all angles in degrees, distances in metres unless a name says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M, DEG_M, DEG_COARSE_M, CHUNK_DEG = 6_371_000.0, 111_320.0, 111_000.0, 1.5 / 111.0
COMPASS = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW")
MERCATOR_LIMIT = 85.05112878


def haversine(lat1, lon1, lat2, lon2, capped: bool = False) -> Column:
    """Great-circle distance; ``capped`` takes the arcsine form with its argument held at 1."""
    lat1, lon1, lat2, lon2 = (F.radians(c) for c in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), 2)
    arc = F.asin(F.least(F.lit(1.0), F.sqrt(h))) if capped else F.atan2(F.sqrt(h), F.sqrt(1 - h))
    return 2 * EARTH_M * arc


def bearing(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing, 0 up to 360."""
    a, b, turn = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    y, x = F.sin(turn) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(turn)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def acute_angle(a: Column, b: Column) -> Column:
    """Angle between two undirected lines, 0 to 90."""
    off = F.pmod(F.abs(a - b), F.lit(180.0))
    return F.least(off, 180.0 - off)


def cross_track(lat, lon, lat1, lon1, lat2, lon2) -> Column:
    """Perpendicular great-circle distance to the line through two points; to the first where they coincide."""
    away = haversine(lat1, lon1, lat, lon, capped=True)
    across = F.abs(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sin(away / EARTH_M) * F.sin(F.radians(bearing(lat1, lon1, lat, lon)) - F.radians(bearing(lat1, lon1, lat2, lon2))))))) * EARTH_M
    return F.when((lat1 == lat2) & (lon1 == lon2), away).otherwise(across)


def cardinal16(degrees: Column) -> Column:
    """Compass point; halves go to the even sector."""
    return F.element_at(F.array(*[F.lit(c) for c in COMPASS]), (F.bround(degrees / 22.5).cast("int") % 16) + 1)


def grade_category(percent: Column) -> Column:
    p = F.abs(percent)
    return F.when(p < 2, "flat").when(p < 5, "gentle").when(p < 10, "moderate").when(p < 15, "steep").otherwise("very steep")


def buffer_degrees(metres: Column, lat: Column) -> Column:
    """Degrees that cover ``metres`` both ways; the cosine is held at 0.01 near the poles."""
    return F.greatest(metres / DEG_M, metres / (DEG_M * F.greatest(F.lit(0.01), F.cos(F.radians(lat)))))


def tile_x(lon: Column, zoom: int) -> Column:
    return ((lon + 180.0) / 360.0 * 2**zoom).cast("int")


def tile_y(lat: Column, zoom: int) -> Column:
    return ((1.0 - F.asinh(F.tan(F.radians(lat))) / F.pi()) / 2.0 * 2**zoom).cast("int")


def tile_lon(x: Column, zoom: int) -> Column:
    """Western edge of a tile."""
    return x / F.lit(float(2**zoom)) * 360.0 - 180.0


def tile_lat(y: Column, zoom: int) -> Column:
    """Northern edge of a tile."""
    return F.degrees(F.atan(F.sinh(F.pi() * (1.0 - 2.0 * y / F.lit(float(2**zoom))))))


def terrarium(r: Column, g: Column, b: Column) -> Column:
    """Elevation of a Terrarium pixel."""
    return r * 256.0 + g + b / 256.0 - 32768.0


def chunk(value: Column) -> Column:
    """Index of the routing chunk along one axis, pinned at 0."""
    return F.floor(value / CHUNK_DEG)


def grid_key(value: Column, size: float) -> Column:
    """Index of the join cell along one axis."""
    return F.floor(value / size)


def valid_coordinate(lat: Column, lon: Column) -> Column:
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def point_segment_degrees(lat, lon, lat1, lon1, lat2, lon2) -> Column:
    """Planar distance in degrees from a point to a segment."""
    dx, dy = lon2 - lon1, lat2 - lat1
    length2 = dx * dx + dy * dy
    t = F.when(length2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((lon - lon1) * dx + (lat - lat1) * dy) / length2))).otherwise(0.0)
    ex, ey = lon1 + t * dx - lon, lat1 + t * dy - lat
    return F.sqrt(ex * ex + ey * ey)
