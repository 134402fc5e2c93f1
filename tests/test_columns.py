"""Projection, filters, layers, coordinate systems."""

from __future__ import annotations

import math

import pytest
from helpers import layer, points, ring, square
from pyspark.sql import functions as F

from areametrics.functions import crs
from areametrics.functions import geometry as G
from areametrics.operators import layers as L
from areametrics.operators import projection as P
from areametrics.operators import spatial as S


def test_point_needs_both_coordinates(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 2.0), (1.0, None)], "a double, b double")
    got = P.set_bbox(P.with_points(df, "a", "b")).collect()
    assert [r.geom is None for r in got] == [False, True, True]
    assert (got[0].minx, got[0].maxy) == (1.0, 2.0) and got[1].minx is None


def test_polygon_box_spans_all_parts(spark):
    row = layer(spark, {"a": [[square(0, 0)], [square(5, -3)]]}).first()
    assert (row.minx, row.miny, row.maxx, row.maxy) == (0.0, -3.0, 6.0, 1.0)


@pytest.mark.parametrize("parts,want", [
    ([[square(1, 2, 3)]], True),
    ([[ring((0, 0), (0, 2), (5, 2), (5, 0))]], True),
    ([[ring((0, 0), (2, 1), (1, 3), (-1, 2))]], False),
    ([[square(0, 0, 5), square(1, 1)]], False),
    ([[square(0, 0)], [square(5, 5)]], False),
    ([[ring((0, 0), (1, 0), (0, 0), (0, 1))]], False),
    ([[ring((0, 0), (1, 0), (1, 1))]], False),
])
def test_box_recognition(spark, parts, want):
    assert layer(spark, {"a": parts}).select(F.expr(G.is_box("geom"))).first()[0] is want


def test_rename_keeps_only_mapped(spark):
    df = spark.createDataFrame([(1, "a", 2)], "OBJECTID int, Nom string, other int")
    assert P.rename_mapped(df, {"OBJECTID": "park_id", "Nom": "park_name"}).columns == [
        "park_id", "park_name"
    ]
    with pytest.raises(Exception, match="missing"):
        P.rename_mapped(df, {"missing": "x"}).collect()


def test_limits_filters_profile(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (None, None)], "n int, s string")
    assert P.limit_rows(df, None).count() == P.limit_rows(df, "None").count() == 3
    assert P.limit_rows(df, 2).count() == 2
    assert P.drop_any_null(df).count() == 1
    assert df.where(P.any_equal([("n", 2), ("s", "a")])).count() == 2
    assert [tuple(r) for r in P.profile(df).collect()] == [("n", "int", 3, 1), ("s", "string", 3, 2)]
    assert P.distinct_values(df, "s").count() == 2


def test_dissolve(spark):
    rows = layer(spark, {"a": [[square(0, 0)]], "b": [[square(5, 5)]], "c": [[square(9, 9)]]})
    rows = rows.withColumns({
        "Nom": F.expr("CASE pid WHEN 'c' THEN NULL ELSE 'x' END"),
        "kind": F.expr("CASE pid WHEN 'b' THEN 'late' END"),
    })
    got = L.dissolve(rows, "Nom", "pid").collect()
    assert len(got) == 1 and len(got[0].geom) == 2 and got[0].kind == "late"
    assert (got[0].minx, got[0].maxx) == (0.0, 6.0)


def test_grid_over_extent(spark):
    grid = L.grid_over(points(spark, [(1, (0.0, 0.0)), (2, (2.5, 1.0))]), 1.0)
    assert grid.count() == 3
    assert grid.agg(F.max("maxx")).first()[0] == 3.0


def test_distances(spark):
    areas = layer(spark, {"near": [[square(2, 0)]], "in": [[square(-1, -1, 2)]], "far": [[square(9, 9)]]})
    got = [(r.pid, r.distance) for r in L.closest(areas, 0.5, 0.5, 2, "pid").collect()]
    assert got == [("in", 0.0), ("near", 1.5)]
    near = L.cells_within(areas, 2.5, 0.5, 1000.0).collect()
    assert [r.pid for r in near] == ["near"] and near[0].distance == pytest.approx(0.0)


def test_map_data(spark):
    areas = layer(spark, {"a": [[square(0, 0)]], "b": [[square(2, 0)]]})
    metrics = spark.createDataFrame([("a", 3)], "pid string, species_richness int")
    got = {r.pid: r.species_richness for r in
           L.choropleth(areas, metrics, "pid", ["species_richness"]).collect()}
    assert got == {"a": 3, "b": None}
    assert [r.pid for r in L.pick_list(areas, "pid").collect()] == ["a", "b"]


@pytest.mark.parametrize("srid,lon,lat", [
    (32188, -73.5673, 45.5017), (32189, -75.0, 46.1), (32618, -73.6, 45.5), (26918, -76.2, 12.0),
])
def test_projection_round_trip(spark, srid, lon, lat):
    df = points(spark, [(1, (lon, lat)), (2, None)]).select("id", "geom")
    moved = crs.reproject(df, 4326, srid)
    assert moved.where("id = 1").first().geom.x > 1000
    back = crs.reproject(moved, srid, 4326).orderBy("id").collect()
    assert back[0].geom.x == pytest.approx(lon, abs=1e-8)
    assert back[0].geom.y == pytest.approx(lat, abs=1e-8)
    assert back[1].geom is None


def test_projection_fixed_points(spark):
    """On the central meridian x is the false easting and y the scaled meridian arc."""
    df = points(spark, [(1, (-73.5, 45.0))])
    got = crs.reproject(df, 4326, 32188).first().geom
    assert got.x == pytest.approx(304800.0, abs=1e-6)
    # Arc from the equator to 45 degrees on GRS80: 4984944.378 m.
    assert got.y == pytest.approx(4984944.378 * 0.9999, abs=2e-3)


def test_polygons_and_points_move_alike(spark):
    areas = layer(spark, {"a": [[square(300000, 5040000, 1000)]]})
    corner = points(spark, [(1, (300000.0, 5040000.0))])
    p = crs.reproject(corner, 32188, 4326).first().geom
    v = crs.reproject(areas, 32188, 4326).first().geom[0][0][0]
    assert (v.x, v.y) == (pytest.approx(p.x, abs=1e-12), pytest.approx(p.y, abs=1e-12))
    assert math.isclose(v.x, -73.561, abs_tol=1e-2)


@pytest.mark.parametrize("srid", [32198, 3857])
def test_other_planes(spark, srid):
    rows = [(i, (-79.0 + i * 1.7, 40.0 + i * 1.9)) for i in range(12)] + [(20, (-68.5, 44.0)), (21, None)]
    df = points(spark, rows).select("id", "geom")
    moved = crs.reproject(df, 4326, srid)
    back = {r.id: r.geom for r in crs.reproject(moved, srid, 4326).collect()}
    for i, p in rows:
        assert back[i] == p if p is None else tuple(back[i]) == pytest.approx(p, abs=1e-8)


def test_lambert_is_true_on_its_parallels(spark):
    """The scale along a standard parallel is one, and the origin lies at zero."""
    e2 = 0.00669438002290
    for lat in (46.0, 60.0):
        df = points(spark, [(1, (-70.0, lat)), (2, (-70.0 + 1e-4, lat)), (3, (-68.5, 44.0))]).select("id", "geom")
        a, b, origin = (r.geom for r in crs.reproject(df, 4326, 32198).orderBy("id").collect())
        arc = 6378137.0 * math.cos(math.radians(lat)) / math.sqrt(1 - e2 * math.sin(math.radians(lat)) ** 2) * math.radians(1e-4)
        assert math.hypot(b.x - a.x, b.y - a.y) == pytest.approx(arc, rel=1e-7)
        assert tuple(origin) == pytest.approx((0.0, 0.0), abs=1e-6)


def test_crs_rules(spark):
    df = points(spark, [(1, (1.0, 2.0))])
    assert crs.reproject(df, 4326, 4326) is df
    assert crs.same_crs(4326, 4269) and not crs.same_crs(4326, 32188)
    with pytest.raises(ValueError):
        crs.reproject(df, 4326, 999)


def test_clip_moves_the_region_first(spark):
    region = layer(spark, {"r": [[square(300000, 5040000, 1000)]]})
    inside = crs.reproject(points(spark, [(1, (300500.0, 5040500.0)), (2, (0.0, 0.0))]), 32188, 4326)
    kept = S.clip_to_region(P.set_bbox(inside.select("id", "geom")), region, 4326, 32188)
    assert [r.id for r in kept.collect()] == [1]
