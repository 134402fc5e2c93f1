"""Joins by distance against brute force."""

from __future__ import annotations

from math import asin, cos, hypot, radians, sin, sqrt

import numpy as np
import pytest
from helpers import layer, points, ring, square

from areametrics.operators import near as N


def metres(a, b):
    dy, dx = radians(b[1] - a[1]), radians(b[0] - a[0])
    h = sin(dy / 2) ** 2 + cos(radians(a[1])) * cos(radians(b[1])) * sin(dx / 2) ** 2
    return 2 * N.RADIUS * asin(min(1.0, sqrt(h)))


@pytest.mark.parametrize("options", [{}, {"limit": -1, "heavy_rows": 4}])
@pytest.mark.parametrize("reach", [3e4, 2e6, 3e7])
def test_within_metres(spark, options, reach):
    rng = np.random.default_rng(4)
    left = [(i, (float(x), float(y))) for i, (x, y) in enumerate(zip(rng.uniform(-180, 180, 120), rng.uniform(-90, 90, 120)))]
    left += [(200 + i, (179.9 - i * 0.05, 10.0)) for i in range(4)] + [(210, (0.0, 90.0)), (211, (90.0, 90.0)), (212, None)]
    left += [(300 + i, (5.0, 5.0)) for i in range(30)]
    right = [(i, (-179.95 + i * 0.05, 10.0)) for i in range(4)] + [(10, (45.0, 89.9)), (11, (5.1, 5.1)), (12, None)]
    right += [(20 + i, v) for i, (_, v) in enumerate(left[:40])]
    got = {
        (r["id"], r["id_1"]): r["distance"]
        for r in N.within_metres(points(spark, left), points(spark, right), "id", "id", reach, **options).collect()
    }
    want = {(i, j): metres(p, q) for i, p in left for j, q in right if p and q and metres(p, q) <= reach}
    assert set(got) == set(want)
    assert all(got[p] == pytest.approx(want[p], abs=1e-3) for p in got)


def to_polygon(p, parts):
    best = float("inf")
    for part in parts:
        inside = False
        for r in part:
            for (ax, ay), (bx, by) in zip(r, r[1:]):
                length = (bx - ax) ** 2 + (by - ay) ** 2
                t = max(0.0, min(1.0, ((p[0] - ax) * (bx - ax) + (p[1] - ay) * (by - ay)) / length))
                best = min(best, hypot(ax + t * (bx - ax) - p[0], ay + t * (by - ay) - p[1]))
                if (ay > p[1]) != (by > p[1]) and p[0] < ax + (p[1] - ay) * (bx - ax) / (by - ay):
                    inside = not inside
        if inside:
            return 0.0
    return best


def case():
    rng = np.random.default_rng(9)
    shapes = {f"p{i:03}": [[square(float(x), float(y), float(s))]] for i, (x, y, s) in enumerate(rng.uniform(0, 30, (60, 3)) * (1, 1, 0.1))}
    shapes |= {f"q{i:03}": [[square(7, 7)]] for i in range(40)}  # copies: ties by key
    shapes |= {"wide": [[square(-50, -50, 130), square(-40, -40, 110)]], "tri": [[ring((3, 3), (9, 4), (5, 8))]], "none": None}
    places = [(i, (float(x), float(y))) for i, (x, y) in enumerate(rng.uniform(-5, 35, (150, 2)))]
    places += [(500 + i, (1e5 + i * 100, -3e5 * i)) for i in range(12)]  # far away
    return shapes, places + [(600 + i, (7.5, 7.5)) for i in range(30)] + [(700, None), (701, (float("nan"), 1.0))]


@pytest.mark.parametrize("k", [1, 4])
def test_nearest(spark, k):
    shapes, places = case()
    found = N.nearest(points(spark, places), layer(spark, shapes), "id", "pid", k)
    got = {}
    for r in found.orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append((r["pid"], r["distance"]))
    for i, p in places:
        if p is None or p[0] != p[0]:
            assert i not in got
            continue
        every = {s: to_polygon(p, g) for s, g in shapes.items() if g}
        want = sorted((d, s) for s, d in every.items())[:k]
        assert [d for _, d in got[i]] == pytest.approx([d for d, _ in want], rel=1e-9, abs=1e-9)
        assert all(every[s] == pytest.approx(d, rel=1e-9, abs=1e-9) for s, d in got[i])
        if abs(p[0]) < 100:
            assert [s for s, _ in got[i]] == [s for _, s in want]


def test_nearest_of_few(spark):
    two = layer(spark, {"a": [[square(0, 0)]], "b": [[square(4, 0)]]})
    some = points(spark, [(1, (0.5, 0.5)), (2, (100.0, 0.0))])
    rows = N.nearest(some, two, "id", "pid", 5).orderBy("id", "rank").collect()
    assert [(r["id"], r["rank"], r["pid"], r["distance"]) for r in rows] == [
        (1, 1, "a", 0.0), (1, 2, "b", 3.5), (2, 1, "b", 95.0), (2, 2, "a", 99.0),
    ]
    assert N.nearest(some, two.where("false"), "id", "pid").count() == 0
    assert N.nearest(some.where("false"), two, "id", "pid").count() == 0


def test_nearest_measures_few_outlines(spark, monkeypatch):
    """Points far from all areas share wide cells, but are measured against few of the areas there."""
    shapes = {f"s{x}-{y}": [[square(2.0 * x, 2.0 * y)]] for x in range(20) for y in range(20)}
    some = [(i, (-30.0 - (i % 10) / 2, 5.0 + i / 10)) for i in range(200)]
    sizes, join = [], N.joins.sized_join

    def counted(*args, **options):
        sizes.append((out := join(*args, **options)).count())
        return out

    monkeypatch.setattr(N.joins, "sized_join", counted)
    found = N.nearest(points(spark, some), layer(spark, shapes), "id", "pid", 3)
    assert sizes[-1] <= 12 * len(some)
    got = {(r["id"], r["rank"]): r["distance"] for r in found.collect()}
    for i, p in some:
        want = sorted(to_polygon(p, g) for g in shapes.values())[:3]
        assert [got[i, r] for r in (1, 2, 3)] == pytest.approx(want, rel=1e-9)
