"""Binary geometries: round trips, both byte orders, further coordinates, and blobs that are none."""

import random
import struct

from cairnway.sources import wkb


def test_round_trip_of_points_lines_and_polygons(spark):
    rnd = random.Random(1)
    for kind, shape in (("Point", [1]), ("LineString", [5]), ("Polygon", [5, 4])):
        rows = [(i, [[(rnd.uniform(-180, 180), rnd.uniform(-90, 90)) for _ in range(n)] for n in shape]) for i in range(20)]
        table = spark.createDataFrame(rows, "i int, parts array<array<struct<lon:double,lat:double>>>")
        back = wkb.with_geometry(table.select("i", wkb.blob(kind, table.parts).alias("shape")), "shape").collect()
        assert {r.i: [[tuple(p) for p in part] for part in r.parts] for r in back} == dict(rows)
        assert {(r.kind, r.problem) for r in back} == {(kind, None)}
        assert all(r.xmin == min(p[0] for part in rows[r.i][1] for p in part) for r in back)


def test_other_forms_and_broken_blobs(spark):
    line = struct.pack("<BII4d", 1, 2, 2, 1, 2, 3, 4)
    forms = {
        "big endian": (struct.pack(">BII4d", 0, 2, 2, 1, 2, 3, 4), "LineString"),
        "with a system": (struct.pack("<BIII4d", 1, 2 | 1 << 29, 4326, 2, 1, 2, 3, 4), "LineString"),
        "with heights": (struct.pack("<BII6d", 1, 1002, 2, 1, 2, 9, 3, 4, 9), "LineString"),
        "with flagged heights": (struct.pack("<BII6d", 1, 2 | 1 << 31, 2, 1, 2, 9, 3, 4, 9), "LineString"),
        "two lines": (struct.pack("<BII", 1, 5, 1) + line, "MultiLineString"),
    }
    broken = [b"", b"\x01", line[:-1], line + b"\x00", b"\x07" + line[1:], struct.pack("<BI", 1, 99), struct.pack("<BII", 1, 2, 2**31), struct.pack("<BII", 1, 7, 1) * 3000]
    rows = [(k, bytearray(b)) for k, (b, _) in forms.items()] + [(f"broken {i}", bytearray(b)) for i, b in enumerate(broken)] + [("missing", None)]
    got = {r.k: r for r in wkb.with_geometry(spark.createDataFrame(rows, "k string, shape binary"), "shape").collect()}
    for k, (_, kind) in forms.items():
        assert (got[k].kind, [[tuple(p) for p in part] for part in got[k].parts], got[k].problem) == (kind, [[(1.0, 2.0), (3.0, 4.0)]], None)
    assert {got[f"broken {i}"].problem for i in range(len(broken))} == {"unreadable"} and got["missing"].problem == "missing"


def test_blobs_of_no_rows(spark):
    assert wkb.with_geometry(spark.createDataFrame([], "shape binary"), "shape").count() == 0
