"""Outlines of unions, cutting and containment, against exact rational arithmetic."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pytest
from helpers import layer, ring, square

from areametrics.operators import overlay as O


def exact_area(vs):
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(vs, vs[1:] + vs[:1]))) / 2


def convex_cut(subject, clip):
    """Part of one counter-clockwise convex polygon inside another, in exact fractions."""
    out = [tuple(map(Fraction, v)) for v in subject]
    clip = [tuple(map(Fraction, v)) for v in clip]
    for (ax, ay), (bx, by) in zip(clip, clip[1:] + clip[:1]):
        def side(p):
            return (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax)
        before, out = out, []
        for p, q in zip(before, before[1:] + before[:1]):
            if side(p) >= 0:
                out.append(p)
            if side(p) * side(q) < 0:
                t = side(p) / (side(p) - side(q))
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
    return out


def triangle(rng, at=(0, 0)):
    while True:
        vs = [tuple(float(x) for x in rng.uniform(0, 10, 2) + at) for _ in range(3)]
        turn = (vs[1][0] - vs[0][0]) * (vs[2][1] - vs[0][1]) - (vs[1][1] - vs[0][1]) * (vs[2][0] - vs[0][0])
        if abs(turn) > 5:
            return vs if turn > 0 else vs[::-1]


def areas(df, key):
    return {r[key]: r["a"] for r in df.selectExpr(key, f"{O.area()} AS a").collect()}


def rings_closed(df):
    for r in df.select("geom").collect():
        for part in r["geom"]:
            assert all(len(x) > 3 and x[0] == x[-1] for x in part)


@pytest.fixture(scope="module")
def shapes():
    rng = np.random.default_rng(3)
    return [(triangle(rng, (20 * i, 0)), triangle(rng, (20 * i, 0)), triangle(rng, (20 * i, 0))) for i in range(25)]


def test_dissolve_of_slanted_shapes(spark, shapes):
    rows = spark.createDataFrame(
        [(i, i, [[ring(*t)]]) for i, (a, b, _) in enumerate(shapes) for t in (a, b)],
        "g long, o long, geom array<array<array<struct<x:double,y:double>>>>",
    )
    made = O.dissolve(rows, "g", "o")
    rings_closed(made)
    got = areas(made, "g")
    for i, (a, b, _) in enumerate(shapes):
        both = convex_cut(a, b)
        want = float(exact_area([tuple(map(Fraction, v)) for v in a]) + exact_area([tuple(map(Fraction, v)) for v in b]) - (exact_area(both) if both else 0))
        assert got[i] == pytest.approx(want, rel=1e-9)


def test_cut_of_slanted_shapes(spark, shapes):
    left = layer(spark, {str(i): [[ring(*a)]] for i, (a, _, _) in enumerate(shapes)})
    region = layer(spark, {f"{i}{j}": [[ring(*t)]] for i, (_, b, c) in enumerate(shapes) for j, t in enumerate((b, c))})
    made = O.cut(left, region, "pid")
    rings_closed(made)
    got = areas(made, "pid")
    for i, (a, b, c) in enumerate(shapes):
        one, two = convex_cut(a, b), convex_cut(a, c)
        both = convex_cut(one, c) if one else []
        want = float(sum(exact_area(x) for x in (one, two) if x) - (exact_area(both) if both else 0))
        assert got.get(str(i), 0.0) == pytest.approx(want, rel=1e-9, abs=1e-9)


def test_holes_touches_and_pinches(spark):
    rows = {
        "hole": [[square(0, 0, 6), square(1, 1, 4)]],
        "island": [[square(2, 2, 2)]],
        "fills": [[square(20, 0, 2)]], "around": [[square(18, -2, 6), square(20, 0, 2)]],
        "left": [[square(30, 0)]], "corner": [[square(31, 1)]],
        "chain": [[square(40, 0, 2)], [square(42, 0, 2)]], "flat": [[ring((50, 0), (51, 0), (52, 0))]],
    }
    made = O.union(layer(spark, rows))
    found = sorted((r["minx"], r["a"], [len(x) for x in r["geom"][0]]) for r in made.selectExpr("*", f"{O.area()} AS a").collect())
    assert found == [
        (0.0, 20.0, [5, 5]), (2.0, 4.0, [5]), (18.0, 36.0, [5]), (30.0, 1.0, [5]), (31.0, 1.0, [5]), (40.0, 8.0, [5]),
    ]


def test_copies_and_long_rings(spark):
    """Many copies of one part are one; a ring of many edges is linked in few rounds."""
    t = np.linspace(0, 2 * np.pi, 700, endpoint=False)
    disc = ring(*zip(np.cos(t).tolist(), np.sin(t).tolist()))
    rows = {f"c{i}": [[square(5, 5, 2)]] for i in range(300)} | {"disc": [[disc]], "same": [[disc]]}
    found = O.union(layer(spark, rows)).selectExpr(f"{O.area()} AS a", "size(flatten(flatten(geom))) AS n").collect()
    assert sorted((round(r["a"], 6), r["n"]) for r in found) == [(round(350 * np.sin(2 * np.pi / 700), 6), 701), (4.0, 5)]


def test_cut_to_region_with_holes(spark):
    left = layer(spark, {"a": [[square(0, 0, 10)]], "b": [[square(3, 3, 2)]], "c": [[square(20, 0)]], "d": [[square(10, 0, 5)]]})
    region = layer(spark, {"r": [[square(2, 2, 6), square(3, 3, 2)]], "s": [[square(8, 2, 1)]]})
    made = O.cut(left, region, "pid")
    assert areas(made, "pid") == {"a": 33.0}
    assert [len(x) for x in made.first()["geom"][0]] == [7, 5]


def test_shells_and_holes_met_by_strips(spark, monkeypatch):
    """A frame, an island with a pond in it, a frame within the pond, and a tooth that many lines cross: the same
    parts whether holes look for their shells by cells or by strips."""
    teeth = [(20, 0), *[(21 + i / 4, (i % 2) * 9 + i / 64) for i in range(40)], (31, 0), (31, -1), (20, -1)]
    nested = [[square(k, k, 19 - 2 * k), square(k + 0.5, k + 0.5, 18 - 2 * k)] for k in range(9)]
    shapes = {f"n{k}": [p] for k, p in enumerate(nested)}
    shapes |= {"comb": [[ring(*teeth)]], "cap": [[square(20, 3.4, 11), square(20.5, 4.4, 0.25), square(30, 8.9, 0.5)]]}
    rows = layer(spark, shapes)
    facts = [f"round({O.area()}, 6) AS area", "size(flatten(flatten(geom))) - size(flatten(geom)) AS vertices", "size(flatten(geom)) AS rings"]
    want = sorted(map(tuple, O.union(rows).selectExpr(*facts).collect()))
    assert len(want) > 9 and sum(r[2] for r in want) > len(want) + 9
    monkeypatch.setattr(O, "RING_EDGES", 3)
    monkeypatch.setattr(O, "STRIP_EDGES", 2)
    found = O.union(rows)
    assert sorted(map(tuple, found.selectExpr(*facts).collect())) == want
    told = found.selectExpr("round(area, 6) AS area", "vertices", "rings")
    assert sorted(map(tuple, told.collect())) == want
    # What is told of a part needs none of its rings in one place.
    assert "collect_list" not in told._jdf.queryExecution().optimizedPlan().toString()


def test_nothing(spark):
    none = layer(spark, {"n": None}).where("geom IS NOT NULL")
    some = layer(spark, {"a": [[square(0, 0)]]})
    assert O.union(none).count() == 0
    assert O.cut(some, none, "pid").count() == 0
    assert O.cut(none, some, "pid").count() == 0
    assert O.pairs_within(none, some, "pid", "pid").count() == 0


def test_within(spark):
    areas_ = {
        "ell": [[ring((0, 0), (6, 0), (6, 3), (3, 3), (3, 6), (0, 6))]],
        "holed": [[square(10, 0, 6), square(12, 2, 2)]],
        "two": [[square(20, 0, 2)], [square(22, 0, 2)]],
    }
    inner = {
        "same": areas_["ell"], "touches": [[square(0, 0, 3)]], "notch": [[square(1, 1, 4)]],
        "concave": [[ring((1, 1), (5, 1), (5, 2), (2, 2), (2, 5), (1, 5))]],
        "chord": [[ring((0, 6), (0, 5), (6, 0), (6, 3), (3, 3), (3, 6))]],
        "around hole": [[square(11, 1, 4)]], "beside hole": [[square(10, 0, 2)]], "in hole": [[square(12, 2, 2)]],
        "with hole": [[square(11, 1, 4), square(12, 2, 2)]], "astride": [[square(21, 0, 2)]],
        "slanted": [[ring((1, 0.5), (2.5, 1.5), (1, 2.5))]], "over": [[square(-1, -1, 2)]], "none": None,
    }
    renamed = layer(spark, areas_).withColumnRenamed("pid", "aid")
    joined = O.polygons_in_polygons(layer(spark, inner), renamed, "pid", "aid")
    got = {p: a for p, a in joined.select("pid", "aid").collect()}
    assert got == {
        "same": "ell", "touches": "ell", "notch": None, "concave": "ell", "chord": "ell", "around hole": None,
        "beside hole": "holed", "in hole": None, "with hole": "holed", "astride": "two", "slanted": "ell",
        "over": None, "none": None,
    }


def test_meetings_are_small_enough_to_compile():
    """Sides and lengths are columns: written out at each use they made the whole twice as long."""
    assert len(O._meetings(2.0**-44)) < 4000
