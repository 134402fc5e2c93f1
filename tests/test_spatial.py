from __future__ import annotations

import random
from fractions import Fraction

import pytest
from helpers import layer, pairs, plan_text, points, ring, square
from pyspark.sql import functions as F

from areametrics.functions import geometry as G
from areametrics.operators import joins
from areametrics.operators import spatial as S
from areametrics.operators.layers import regular_grid

ELL = [[ring((0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4))]]
HOLED = [[square(10, 0, 6), square(12, 2, 2)]]
TWO = [[square(20, 0, 1)], [square(30, 5, 2)]]
OVER = [[square(0.25, 0.25, 0.5)], [square(0.5, 0.5, 0.4)]]
SHAPES = {"ell": ELL, "holed": HOLED, "two": TWO, "over": OVER}

CASES = {
    1: ((3.0, 0.5), ["ell"]),
    2: ((2.0, 2.0), [None]),          # inside the box, outside the L
    3: ((2.0, 1.0), [None]),          # on an edge
    4: ((1.0, 1.0), [None]),          # on a vertex
    5: ((13.0, 3.0), [None]),         # in the hole
    6: ((11.0, 3.0), ["holed"]),
    7: ((12.0, 3.0), [None]),         # on the hole's edge
    8: ((31.0, 6.0), ["two"]),        # second part
    9: ((0.6, 0.6), ["ell", "over"]),  # two polygons, two parts of one of them
    10: (None, [None]),
    11: ((-5.0, -5.0), [None]),
    12: ((float("nan"), 0.5), [None]),
}


def _expected():
    return sorted(((i, p) for i, (_, ps) in CASES.items() for p in ps), key=str)


@pytest.mark.parametrize("cell", [None, 0.3, 1.0, 64.0])
@pytest.mark.parametrize("limit", [None, 0])
def test_point_cases(spark, cell, limit):
    pts = points(spark, [(i, xy) for i, (xy, _) in CASES.items()])
    got = S.points_in_polygons(pts, layer(spark, SHAPES), cell=cell, limit=limit)
    assert sorted(pairs_any(got), key=str) == _expected()


def pairs_any(df):
    return [(r["id"], r["pid"]) for r in df.select("id", "pid").collect()]


def test_result_carries_polygon_shape_and_box(spark):
    pts = points(spark, [(1, (3.0, 0.5))])
    row = S.points_in_polygons(pts, layer(spark, SHAPES)).first()
    assert (row.minx, row.miny, row.maxx, row.maxy) == (0.0, 0.0, 4.0, 4.0)
    assert [(v.x, v.y) for v in row.geom[0][0]] == ELL[0][0]


def test_colliding_names_get_a_suffix(spark):
    pts = points(spark, [(1, (3.0, 0.5))]).withColumn("pid", F.lit("left"))
    row = S.points_in_polygons(pts, layer(spark, SHAPES), keep_geom=False).first()
    assert (row.pid, row.pid_1) == ("left", "ell")


def test_clip_keeps_border_points_once(spark):
    pts = points(spark, [(i, xy) for i, (xy, _) in CASES.items()])
    kept = S.clip_points(pts, layer(spark, SHAPES))
    assert sorted(r.id for r in kept.collect()) == [1, 3, 4, 6, 7, 8, 9]


def _star(rng, cx, cy, n, reach):
    """Simple polygon with rational corners: directions sorted by exact angle halves."""
    import math

    corners = []
    for k in sorted(rng.sample(range(360), n)):
        r = rng.randint(1, reach)
        corners.append((cx + round(r * math.cos(math.radians(k))), cy + round(r * math.sin(math.radians(k)))))
    return corners


def _place(p, parts):
    """Exact answer: True strictly inside at least one part."""
    x, y = (Fraction(v) for v in p)
    for part in parts:
        odd = on = False
        for r in part:
            for (ax, ay), (bx, by) in zip(r, r[1:]):
                ax, ay, bx, by = (Fraction(v) for v in (ax, ay, bx, by))
                cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
                if cross == 0 and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
                    on = True
                if (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
                    odd = not odd
        if odd and not on:
            return True
    return False


@pytest.mark.parametrize("cell", [0.7, 3.0, None])
def test_points_against_exact_arithmetic(spark, cell):
    """Self-touching, overlapping and multi-part outlines; points on corners and edges too."""
    rng = random.Random(11)
    shapes = {}
    for i in range(40):
        parts = []
        for _ in range(rng.choice([1, 1, 2, 3])):
            cx, cy = rng.randint(-12, 12), rng.randint(-12, 12)
            parts.append([ring(*_star(rng, cx, cy, rng.randint(3, 9), 8))])
        shapes[f"p{i}"] = parts
    locations = [(rng.randint(-40, 40) / 2, rng.randint(-40, 40) / 2) for _ in range(400)]
    got = S.points_in_polygons(
        points(spark, list(enumerate(locations))), layer(spark, shapes), cell=cell, how="inner"
    )
    want = sorted(
        (i, n) for i, p in enumerate(locations) for n, parts in shapes.items() if _place(p, parts)
    )
    assert len(want) > 500
    assert pairs(got) == want


def _skyline(rng, x0, y0):
    """Outline under random heights, with unit holes; also its set of unit cells."""
    heights = [rng.randint(1, 6) for _ in range(rng.randint(1, 7))]
    top = []
    for i, h in enumerate(heights):
        top += [(x0 + i, y0 + h), (x0 + i + 1, y0 + h)]
    shell = [(x0, y0), *top, (x0 + len(heights), y0)]
    cells = {(x0 + i, y0 + j) for i, h in enumerate(heights) for j in range(h)}
    rings = [ring(*shell)]
    inner = [
        (x, y) for x, y in sorted(cells)
        if all((x + i, y + j) in cells for i in (-1, 0, 1) for j in (-1, 0, 1))
    ]
    if inner and rng.random() < 0.6:
        hole = rng.choice(inner)
        rings.append(square(*hole))
        cells = cells - {hole}
    return rings, cells


def _skylines(seed, n):
    rng = random.Random(seed)
    shapes, cells = {}, {}
    for i in range(n):
        rings, unit = _skyline(rng, rng.randint(-8, 8), rng.randint(-8, 8))
        shapes[f"s{i}"], cells[f"s{i}"] = [rings], unit
    return shapes, cells


@pytest.mark.parametrize("cell,limit", [(0.5, None), (1.0, None), (4.0, 0), (None, None)])
def test_boxes_against_unit_cells(spark, cell, limit):
    shapes, cells = _skylines(5, 60)
    rng = random.Random(6)
    boxes = [
        (i, rng.randint(-8, 12), rng.randint(-8, 12), rng.randint(1, 3), rng.randint(1, 3))
        for i in range(300)
    ]
    df = spark.createDataFrame(boxes, "id long, x int, y int, w int, h int").selectExpr(
        "id", "CAST(x AS DOUBLE) minx", "CAST(y AS DOUBLE) miny",
        "CAST(x + w AS DOUBLE) maxx", "CAST(y + h AS DOUBLE) maxy",
    )
    got = S.boxes_in_polygons(df, layer(spark, shapes), cell=cell, limit=limit, how="inner")
    want = sorted(
        (i, n) for i, x, y, w, h in boxes for n, unit in cells.items()
        if all((x + a, y + b) in unit for a in range(w) for b in range(h))
    )
    assert len(want) > 100
    assert pairs(got) == want


def test_pairwise_predicates_agree_with_joins(spark):
    shapes, cells = _skylines(9, 30)
    right = layer(spark, shapes)
    grid = regular_grid(spark, -9, -9, 15, 15, 1.0)
    joined = S.boxes_in_polygons(grid, right, keep_geom=False, how="inner")
    areas = right.select("pid", F.col("geom").alias("area"))
    direct = grid.alias("b").join(areas, G.box_within("b", "area"))
    assert pairs(joined) == pairs(direct)
    assert len(pairs(joined)) == sum(len(c) for c in cells.values())


@pytest.mark.parametrize("cell,limit", [(None, None), (0.5, None), (16.0, 0)])
def test_polygons_meet(spark, cell, limit):
    shapes, cells = _skylines(21, 40)
    region, region_cells = _skylines(22, 4)
    kept = S.clip_polygons(layer(spark, shapes), layer(spark, region), cell=cell, limit=limit)
    target = set().union(*region_cells.values())
    want = sorted(
        n for n, unit in cells.items()
        if any((x + i, y + j) in target for x, y in unit for i in (-1, 0, 1) for j in (-1, 0, 1))
    )
    assert 0 < len(want) < len(shapes)
    assert sorted(r.pid for r in kept.collect()) == want


def test_polygon_in_hole_and_around_region(spark):
    shapes = {
        "in_hole": [[square(12.5, 2.5, 0.5)]],
        "touches_hole": [[square(12, 2, 0.5)]],
        "around": [[square(9, -1, 9)]],
        "ring_around": [[square(0, -10, 30), square(5, -5, 20)]],
    }
    kept = S.clip_polygons(layer(spark, shapes), layer(spark, {"holed": HOLED}))
    assert sorted(r.pid for r in kept.collect()) == ["around", "touches_hole"]


def test_grid_assigns_every_interior_point_once(spark):
    grid = regular_grid(spark, 0, 0, 1, 1, 0.1)
    rng = random.Random(3)
    pts = points(spark, [(i, (rng.random(), rng.random())) for i in range(500)])
    got = S.points_in_polygons(pts, grid.withColumnRenamed("id", "cell"))
    assert got.count() == 500
    assert got.where("cell IS NULL").count() == 0


def test_cell_join_keeps_rows_without_cell(spark):
    grid = regular_grid(spark, 0, 0, 4, 4, 1.0).withColumnRenamed("id", "cell")
    pts = points(spark, [(1, (0.5, 0.5)), (2, (3.5, 3.5)), (3, None), (4, (1.0, 0.5))])
    rows = S.points_in_polygons(pts, grid)
    areas = layer(spark, {"ell": ELL})
    want = [(1, "ell"), (2, None), (3, None), (4, None)]
    by_cell = S.cells_in_polygons(rows, areas, grid, "cell")
    by_box = S.boxes_in_polygons(rows, areas)
    assert sorted(pairs_any(by_cell)) == want
    assert sorted(pairs_any(by_box)) == want


def test_plans(spark):
    pts = points(spark, [(i, (i / 10, 0.5)) for i in range(50)])
    small = plan_text(S.points_in_polygons(pts, layer(spark, SHAPES)))
    large = plan_text(S.points_in_polygons(pts, layer(spark, SHAPES), limit=0))
    assert "BroadcastHashJoin" in small and "NestedLoop" not in small
    assert "SortMergeJoin" in large and "NestedLoop" not in large


def test_heavy_keys_are_split_without_loss(spark):
    left = spark.range(1000).selectExpr("IF(id < 700, 1L, id) AS k", "id AS v")
    right = spark.range(1000).selectExpr("id AS k", "id * 2 AS w")
    heavy = joins.heavy_keys(left, ["k"], 100)
    assert [tuple(r) for r in heavy.collect()] == [(1, 7)]
    a, b = joins.salted(left, right, ["k"], heavy)
    assert a.where("k = 1").select("_salt").distinct().count() == 7
    assert b.where("k = 1").count() == 7 and b.count() == 1006
    joined = joins.sized_join(left, right, ["k"], limit=0, heavy_rows=100)
    assert joined.count() == 1000
    assert joined.where("w <> l.k * 2").count() == 0


def test_mixed_sizes(spark):
    """Many small squares inside one large rectangle: no cell holds many chips, same answers."""
    shapes = {f"s{i}": [[square(i % 50, i // 50, 0.9)]] for i in range(2000)}
    shapes["ell"] = [[ring((0, 0), (30, 0), (30, 10), (10, 10), (10, 30), (0, 30))]]
    shapes["world"] = [[ring((-1000, -1000), (1000, -1000), (1000, 1000), (-1000, 1000))]]
    polygons = layer(spark, shapes)
    assert S.choose_cell(polygons).mixed
    for part in S.size_classes(polygons):
        made = S.chips(part, S.choose_cell(part).cell)
        assert made.groupBy("_cell").count().agg({"count": "max"}).first()[0] <= 16
    rows = [(i, ((i * 37 % 1000) / 17, (i * 91 % 1000) / 19)) for i in range(500)]
    rows += [(500, None), (501, (5000.0, 0.0)), (502, (30.0, 5.0)), (503, (0.9, 0.5)), (504, (float("nan"), 1.0))]
    df = points(spark, rows)

    def inside(x, y, closed):
        lt = (lambda a, b: a <= b) if closed else (lambda a, b: a < b)
        hits = {n for n in shapes if n[0] == "s" and all(
            lt(lo, v) and lt(v, lo + 0.9) for lo, v in zip(shapes[n][0][0][0], (x, y)))}
        if lt(-1000, x) and lt(x, 1000) and lt(-1000, y) and lt(y, 1000):
            hits.add("world")
        if lt(0, x) and lt(0, y) and (lt(x, 30) and lt(y, 10) or lt(x, 10) and lt(y, 30)):
            hits.add("ell")
        return hits

    want = []
    for i, p in rows:
        hits = inside(*p, False) if p and p[0] == p[0] else set()
        want += [(i, h) for h in hits] or [(i, None)]
    for limit in (None, -1):
        got = S.points_in_polygons(df, polygons, limit=limit)
        assert sorted((r["id"], r["pid"] or "") for r in got.collect()) == sorted((i, h or "") for i, h in want)
        kept = {r["id"] for r in S.clip_points(df, polygons, limit=limit).collect()}
        assert kept == {i for i, p in rows if p and p[0] == p[0] and inside(*p, True)}


@pytest.mark.parametrize("limit", [None, -1])
def test_stacked_polygons_stay_rows(spark, monkeypatch, limit):
    """Copies of a square on one place, over what a cell may gather: same answers, ends included."""
    monkeypatch.setattr(S, "CROWDED", 20)
    shapes = {f"s{i}": [[square(i % 10, i // 10, 0.9)]] for i in range(70)}
    shapes |= {f"copy{i}": [[square(3, 3, 0.9)]] for i in range(40)}
    shapes["world"] = [[square(-1000, -1000, 2000)]]
    polygons = layer(spark, shapes)
    assert S.choose_cell(polygons).mixed
    at = {1: (3.5, 3.5), 2: (3.0, 3.5), 3: (3.95, 3.5), 4: (8.5, 0.5), 5: (-3.0, 2.0), 6: (1500.0, 0.0), 7: None,
          8: (float("nan"), 0.0), 9: (-1000.0, 3.5)}
    df = points(spark, list(at.items())).unionByName(points(spark, [(1, at[1])]))
    copies = [f"copy{i}" for i in range(40)]
    want = [(1, n) for n in [*copies, "s33", "world"]] * 2 + [(2, "world"), (3, "world"), (4, "s8"), (4, "world")]
    want += [(5, "world"), (6, None), (7, None), (8, None), (9, None)]
    got = S.points_in_polygons(df, polygons, limit=limit)
    assert got.columns == ["id", "pid", "geom", "minx", "miny", "maxx", "maxy"]
    assert sorted(pairs_any(got), key=str) == sorted(want, key=str)
    kept = S.clip_points(df, polygons, limit=limit)
    assert kept.columns == df.columns
    assert sorted(r["id"] for r in kept.collect()) == [1, 1, 2, 3, 4, 5, 9]


def _chipped(monkeypatch):
    """Polygons that chips are made of from here on, as a list of tables."""
    made, chips = [], S.chips

    def spy(polygons, *args, **options):
        made.append(polygons)
        return chips(polygons, *args, **options)

    monkeypatch.setattr(S, "chips", spy)
    return made


@pytest.mark.parametrize("world", [False, True])
def test_large_layers_are_cut_to_the_points(spark, monkeypatch, world):
    """A layer over the limit: polygons that no point can be in make no chips, in both kinds of join."""
    shapes = {f"s{i}": [[square(i % 10, i // 10, 0.9)]] for i in range(1000)} | {"none": None}
    if world:
        shapes["world"] = [[square(-1000, -1000, 2000)]]
    polygons = layer(spark, shapes)
    assert S.choose_cell(polygons).mixed == world
    at = {1: (0.5, 0.5), 2: (3.0, 1.5), 3: (8.9, 2.0), 4: None, 5: (float("nan"), 50.5), 6: (4.95, 0.5)}
    df = points(spark, list(at.items()))
    made = _chipped(monkeypatch)
    got = S.points_in_polygons(df, polygons, limit=-1)
    rest = ["world"] if world else [None]
    inside = {1: ["s0"] + ["world"] * world, 2: rest, 3: rest, 4: [None], 5: [None], 6: rest}
    assert sorted(pairs_any(got), key=str) == sorted([(i, n) for i in at for n in inside[i]], key=str)
    kept = S.clip_points(df, polygons, limit=-1)
    assert sorted(r["id"] for r in kept.collect()) == ([1, 2, 3, 6] if world else [1, 2, 3])
    assert made and all(t.where("miny > 2").isEmpty() for t in made)
    nowhere = df.where("id = 4")
    assert pairs_any(S.points_in_polygons(nowhere, polygons, limit=-1)) == [(4, None)]
    assert S.clip_points(nowhere, polygons, limit=-1).isEmpty()


@pytest.mark.parametrize("limit", [1000, -1])
def test_heaps_of_copies_are_clipped_as_one(spark, monkeypatch, limit):
    """Points beside a heap meet one polygon of it, not every copy."""
    shapes = {f"copy{i}": [[square(3, 3, 0.9)]] for i in range(400)}
    shapes |= {"ell": ELL, "world": [[square(-1000, -1000, 1001)]]}
    region = layer(spark, shapes)
    assert S.choose_cell(region).mixed
    df = points(spark, [(1, (3.5, 3.5)), (2, (3.9, 3.5)), (3, (3.95, 3.5)), (4, (0.5, 0.5)), (4, (0.5, 0.5)), (5, None)])
    made = _chipped(monkeypatch)
    kept = S.clip_points(df, region, limit=limit)
    assert kept.columns == df.columns
    assert sorted(r["id"] for r in kept.collect()) == [1, 2, 4, 4]
    assert sum(t.count() for t in made) <= 3


@pytest.mark.parametrize("limit", [None, -1])
def test_left_sizes_are_split(spark, limit):
    """One wide polygon among many small ones, clipped and joined as boxes."""
    shapes = {i: [[square(i % 20, i // 20, 0.5)]] for i in range(200)}
    shapes[200] = [[square(-50, -50, 200)]]
    shapes[201] = [[square(300, 300, 200)]]
    df = layer(spark, {str(k): v for k, v in shapes.items()})
    assert S._widest(df)[1]
    region = layer(spark, {"ell": ELL, "far": [[square(5.5, 5.0, 1.0)]], "all": [[square(-60, -60, 111)]]})
    small = region.where("pid <> 'all'")

    def meets(i):
        if i >= 200:
            return i == 200
        x, y = i % 20, i // 20
        in_ell = x <= 4 and y <= 1 or x <= 1 and y <= 4
        return in_ell or x in (5, 6) and y in (5, 6)

    kept = {int(r["pid"]) for r in S.clip_polygons(df, small, limit=limit).collect()}
    assert kept == {i for i in shapes if meets(i)}
    boxes = df.select(F.col("pid").cast("long").alias("id"), "minx", "miny", "maxx", "maxy")
    boxes = boxes.unionByName(boxes.where("id = 0").selectExpr("-1L AS id", *["double(null) AS " + c for c in boxes.columns[1:]]))
    want = [(-1, None)]
    for i in shapes:
        x, y = i % 20, i // 20
        hits = ["all"] if i < 200 else []
        if i < 200 and (x + 0.5 <= 4 and y + 0.5 <= 1 or x + 0.5 <= 1 and y + 0.5 <= 4):
            hits.append("ell")
        if i < 200 and x == 6 and y == 5:
            hits.append("far")
        want += [(i, h) for h in hits] or [(i, None)]
    got = S.boxes_in_polygons(boxes, region, keep_geom=False, limit=limit)
    assert sorted(pairs_any(got), key=str) == sorted(want, key=str)


def test_clipping_is_spread(spark):
    """A layer read by one task is clipped by several."""
    many = layer(spark, {f"s{i}": [[square(float(i), 0.0)]] for i in range(3)}).coalesce(1)
    many = many.crossJoin(spark.range(4000).drop("id")).coalesce(1)
    region = layer(spark, {"r": [[square(0.5, 0.5)]]})
    kept = S.clip_polygons(many, region)
    assert kept.rdd.getNumPartitions() > 1 and kept.count() == 8000
