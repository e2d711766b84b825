"""Well-known binary geometries: blobs to parts of points and back; bad blobs are null, never fatal.

Points, lines, polygons and collections of them are read in either byte order, with or without a reference system and further
coordinates (Z, M), which are passed over.
"""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = "array<struct<lon:double,lat:double>>"
GEOMETRY = f"kind string, parts array<{PART}>"
#: Geometry types by number.
KINDS = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon", 7: "GeometryCollection"}


def read_one(blob: bytes, at: int = 0):
    """(kind, parts, where it ends): a part is a list of (lon, lat); a polygon's parts are its rings, the shell first."""
    order = "<" if blob[at] == 1 else ">" if blob[at] == 0 else None
    if order is None:
        raise ValueError("neither byte order")
    code, at = struct.unpack_from(f"{order}I", blob, at + 1)[0], at + 5
    flags, base = code >> 29, code & 0x1FFFFFFF
    if flags & 1:
        at += 4  # the reference system
    size = 2 + bool(flags & 4 or base // 1000 in (1, 3)) + bool(flags & 2 or base // 1000 in (2, 3))
    kind = KINDS[base % 1000]

    def number():
        nonlocal at
        n, at = struct.unpack_from(f"{order}I", blob, at)[0], at + 4
        if n > len(blob):
            raise ValueError("more parts than bytes")
        return n

    def points(n):
        nonlocal at
        flat, at = struct.unpack_from(f"{order}{n * size}d", blob, at), at + 8 * n * size
        return [(flat[i], flat[i + 1]) for i in range(0, len(flat), size)]

    if kind == "Point":
        return kind, [points(1)], at
    if kind == "LineString":
        return kind, [points(number())], at
    if kind == "Polygon":
        return kind, [points(number()) for _ in range(number())], at
    parts = []
    for _ in range(number()):
        _, more, at = read_one(blob, at)
        parts += more
    return kind, parts, at


def geometry(blob: Column) -> Column:
    """struct(kind, parts) of a blob; null where it is none, cut off or followed by something."""

    def run(blobs: pd.Series) -> pd.DataFrame:
        kinds, parts = [], []
        for blob in blobs:
            try:
                kind, found, end = read_one(bytes(blob))
                if end != len(blob):
                    raise ValueError("bytes left over")
            except (struct.error, ValueError, KeyError, IndexError, TypeError, RecursionError):
                kind, found = None, None
            kinds.append(kind)
            parts.append(None if found is None else [[{"lon": x, "lat": y} for x, y in p] for p in found])
        return pd.DataFrame({"kind": kinds, "parts": parts})

    return F.pandas_udf(run, GEOMETRY)(blob)


def blob(kind: str, parts: Column) -> Column:
    """Little-endian blob of a point, a line or a polygon from its parts."""
    number = {v: k for k, v in KINDS.items()}[kind]

    def run(sizes: pd.Series, lon: pd.Series, lat: pd.Series) -> pd.Series:
        out = []
        for counts, xs, ys in zip(sizes, lon, lat, strict=True):
            if counts is None or not len(counts):
                out.append(None)
                continue
            body, at = b"", 0
            for n in map(int, counts):
                flat = [v for i in range(at, at + n) for v in (xs[i], ys[i])]
                body, at = body + (b"" if kind == "Point" else struct.pack("<I", n)) + struct.pack(f"<{2 * n}d", *flat), at + n
            out.append(struct.pack("<BI", 1, number) + (struct.pack("<I", len(counts)) if kind == "Polygon" else b"") + body)
        return pd.Series(out)

    points = F.flatten(parts)
    return F.pandas_udf(run, "binary")(F.transform(parts, F.size), F.transform(points, lambda p: p["lon"]), F.transform(points, lambda p: p["lat"]))


def with_geometry(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``kind``, ``parts``, their box, and ``problem``: none, 'missing' or 'unreadable'."""
    out = rows.withColumn("g", geometry(F.col(column)))
    problem = F.when(F.col(column).isNull(), "missing").when(F.col("g.kind").isNull(), "unreadable")
    points = F.flatten("g.parts")
    end = lambda f, c: f(F.transform(points, lambda p: p[c]))
    return out.select(*rows.columns, F.col("g.kind").alias("kind"), F.col("g.parts").alias("parts"), problem.alias("problem"), end(F.array_min, "lon").alias("xmin"), end(F.array_max, "lon").alias("xmax"), end(F.array_min, "lat").alias("ymin"), end(F.array_max, "lat").alias("ymax"))
