"""Shapefiles: what is written is read, by several tasks, and files made byte by byte."""

from __future__ import annotations

import datetime
import os
import struct
import tempfile

import pytest
from helpers import ring, square

from areametrics.schemas import POINT, POLYGON
from areametrics.sources import shapefile as S


def folder():
    return tempfile.mkdtemp(prefix="areametrics-shp-")


def shapes():
    return [
        (1, "Parc é", 1.5, True, datetime.date(2024, 2, 29), [[square(0, 0)]]),
        (2, None, None, None, None, [[square(0, 0, 9), square(1, 1), square(4, 4, 2)], [ring((20, 0), (24, 0), (20, 4))]]),
        (-3, "x" * 200, -0.1, False, None, None),
        (4, " lead", 1e300, None, None, [[square(30, 30, 9)], [square(50, 50, 3), square(51, 51)]]),
    ]


def test_polygons(spark):
    ddl = f"id long, name string, value double, flag boolean, day date, geom {POLYGON.simpleString()}"
    rows = shapes() + [(100 + i, f"n{i}", i / 7, i % 2 == 0, None, [[square(i, i)]]) for i in range(400)]
    path = folder()
    S.write_shapefile(spark.createDataFrame(rows, ddl).repartition(3), path, 32188)
    found = S.read_shapefile(spark, path, split_bytes=5000)
    assert found.rdd.getNumPartitions() > 6
    assert found.schema.simpleString() == f"struct<{','.join(p.replace(' ', ':', 1) for p in ddl.split(', '))}>".replace("long", "bigint")
    got = {r["id"]: r for r in found.collect()}
    assert len(got) == len(rows)
    for r in rows:
        back = got[r[0]]
        assert tuple(back)[:5] == r[:5]
        assert shape(back["geom"]) == shape(r[5])
    assert S.srid_of(path) == 32188


def shape(parts):
    """Rings as sets of directed edges, so that the starting vertex does not matter."""
    def edges(r):
        vs = [(v[0], v[1]) for v in r]
        turn = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(vs, vs[1:]))
        vs = vs if turn > 0 else vs[::-1]
        return frozenset(zip(vs, vs[1:]))

    return None if parts is None else sorted([[sorted(edges(p[0])), sorted(sorted(edges(r)) for r in p[1:])] for p in parts])


def test_points_and_one_file(spark):
    path = folder()
    df = spark.createDataFrame([(1, (1.5, -2.0)), (2, None)], f"id long, geom {POINT.simpleString()}").coalesce(1)
    S.write_shapefile(df, path, 4326)
    assert S.srid_of(path) == 4326
    (name,) = [f for f in os.listdir(path) if f.endswith(".shp")]
    assert not [f for f in os.listdir(path) if f.startswith("_")]
    rows = {tuple(r) for r in S.read_shapefile(spark, f"{path}/{name}").collect()}
    assert rows == {(1, (1.5, -2.0)), (2, None)}


def by_hand(path, clockwise_hole_first=True):
    """A record whose hole comes before its shells, heights after the points, a deleted row."""
    def vertices(vs):
        return b"".join(struct.pack("<2d", *v) for v in vs)

    rings = [square(1, 1), square(0, 0, 4)[::-1], square(10, 0, 2)[::-1]]
    points = [v for r in rings for v in r]
    body = struct.pack("<i4dii", 15, 0, 0, 12, 4, 3, len(points)) + struct.pack("<3i", 0, 5, 10) + vertices(points)
    body += struct.pack("<2d", 0, 0) + bytes(8 * len(points))
    null = struct.pack("<i", 0)
    bodies, at, shp, shx = [body, null, body], 50, b"", b""
    for i, b in enumerate(bodies):
        shx += struct.pack(">2i", at, len(b) // 2)
        shp += struct.pack(">2i", i + 1, len(b) // 2) + b
        at += 4 + len(b) // 2
    def head(n):
        return struct.pack(">i20xi", 9994, 50 + n // 2) + struct.pack("<ii8d", 1000, 15, *[0.0] * 8)

    field = b"NAME".ljust(11, b"\0") + b"C" + bytes(4) + bytes([4, 0]) + bytes(14)
    dbf = struct.pack("<B3BIHH20x", 3, 100, 1, 1, 3, 65, 5) + field + b"\r" + b" caf\xe9" + b" b   " + b"*gone" + b"\x1a"
    for ending, raw in {"shp": head(len(shp)) + shp, "shx": head(len(shx)) + shx, "dbf": dbf, "cpg": b"latin-1"}.items():
        with open(f"{path}/hand.{ending}", "wb") as f:
            f.write(raw)


def test_by_hand(spark):
    path = folder()
    by_hand(path)
    rows = {r["NAME"]: r["geom"] for r in S.read_shapefile(spark, path).collect()}
    assert set(rows) == {"café", "b"} and rows["b"] is None
    assert shape(rows["café"]) == shape([[square(0, 0, 4), square(1, 1)], [square(10, 0, 2)]])
    assert S.srid_of(path) is None


def test_bad_files(spark):
    path = folder()
    with pytest.raises(Exception, match="no shapefile"):
        S.read_shapefile(spark, path).collect()
    with open(f"{path}/x.shp", "wb") as f:
        f.write(b"nothing")
    with pytest.raises(Exception, match="not a shapefile"):
        S.read_shapefile(spark, path).collect()
    with open(f"{path}/x.prj", "w") as f:
        f.write('PROJCS["odd",PROJECTION["Bonne"]]')
    with pytest.raises(ValueError, match="not known"):
        S.srid_of(path)
