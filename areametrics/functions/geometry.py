"""Geometry as plain columns.

A point is ``struct<x, y>``; a polygon is ``array<part>``, a part ``array<ring>``, a ring a
closed ``array<struct<x, y>>`` with the shell first and holes after it.

Spark has no geometry predicates, so they are written here as SQL expression text over those
arrays and stay in the JVM. Tests multiply instead of dividing: ANSI mode raises on division
by zero, and axis-parallel edges are then judged without rounding.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(lon: str | Column, lat: str | Column) -> Column:
    """``struct<x, y>``; null when either coordinate is null."""
    lon = F.col(lon) if isinstance(lon, str) else lon
    lat = F.col(lat) if isinstance(lat, str) else lat
    return F.when(
        lon.isNotNull() & lat.isNotNull(),
        F.struct(lon.cast("double").alias("x"), lat.cast("double").alias("y")),
    )


def point_bbox(geom: str) -> dict[str, Column]:
    """A point's box: its own coordinates, twice."""
    x, y = F.col(f"{geom}.x"), F.col(f"{geom}.y")
    return {"minx": x, "miny": y, "maxx": x, "maxy": y}


def polygon_bbox(geom: str) -> dict[str, Column]:
    """Smallest box around every vertex; null geometry gives a null box."""

    def side(pick: str, axis: str) -> Column:
        return F.expr(
            f"{pick}(transform(flatten(flatten({geom})), v -> v.{axis}))"
        )

    return {
        "minx": side("array_min", "x"),
        "miny": side("array_min", "y"),
        "maxx": side("array_max", "x"),
        "maxy": side("array_max", "y"),
    }


def bbox_overlap(left: str, right: str) -> Column:
    """Boxes share at least a point (closed on all four sides)."""
    return F.expr(
        f"{left}.maxx >= {right}.minx AND {left}.minx <= {right}.maxx "
        f"AND {left}.maxy >= {right}.miny AND {left}.miny <= {right}.maxy"
    )


def rectangle(minx: str, miny: str, maxx: str, maxy: str) -> Column:
    """One-part polygon from four scalar expressions, counter-clockwise."""

    def v(x: str, y: str) -> str:
        return f"named_struct('x', CAST({x} AS DOUBLE), 'y', CAST({y} AS DOUBLE))"

    ring = ", ".join(
        v(x, y)
        for x, y in [(minx, miny), (maxx, miny), (maxx, maxy), (minx, maxy), (minx, miny)]
    )
    return F.expr(f"array(array(array({ring})))")


# --- edges ------------------------------------------------------------------------------

def edge_list(part: str) -> str:
    """All ring edges of a part, each with its lower end first: ``struct<lx, ly, hx, hy>``.

    A fixed direction makes an edge shared by two neighbours give both the same verdict.
    """
    edge = (
        "if(a.y <= b.y, named_struct('lx', a.x, 'ly', a.y, 'hx', b.x, 'hy', b.y), "
        "named_struct('lx', b.x, 'ly', b.y, 'hx', a.x, 'hy', a.y))"
    )
    return (
        f"flatten(transform(filter({part}, r -> size(r) > 1), r -> zip_with("
        f"slice(r, 1, size(r) - 1), slice(r, 2, size(r) - 1), (a, b) -> {edge})))"
    )


def parity(edges: str, x: str, y: str, start: str = "0") -> str:
    """Fold over edges: crossings right of (x, y) added to ``start``, or -1 on an edge.

    Odd means inside. Edges count on ``[ly, hy)``, so a vertex is never counted twice.
    """
    turn = f"({x} - e.lx) * (e.hy - e.ly)"
    reach = f"(e.hx - e.lx) * ({y} - e.ly)"
    return (
        f"aggregate({edges}, CAST({start} AS INT), (n, e) -> CASE "
        f"WHEN n < 0 OR {y} < e.ly OR {y} > e.hy THEN n "
        f"WHEN {turn} = {reach} AND {x} BETWEEN least(e.lx, e.hx) AND greatest(e.lx, e.hx) "
        f"THEN -1 "
        f"WHEN {y} < e.hy AND {turn} < {reach} THEN n + 1 ELSE n END)"
    )


def crosses_open_box(e: str, minx: str, miny: str, maxx: str, maxy: str) -> str:
    """Edge ``e`` enters the open interior of an axis-parallel box."""

    def corner(x: str, y: str) -> str:
        return f"(({e}.hx - {e}.lx) * ({y} - {e}.ly) - ({e}.hy - {e}.ly) * ({x} - {e}.lx))"

    corners = ", ".join(
        corner(x, y) for x, y in [(minx, miny), (maxx, miny), (maxx, maxy), (minx, maxy)]
    )
    return (
        f"(greatest({e}.lx, {e}.hx) > {minx} AND least({e}.lx, {e}.hx) < {maxx} "
        f"AND {e}.hy > {miny} AND {e}.ly < {maxy} "
        f"AND least({corners}) < 0 AND greatest({corners}) > 0)"
    )


def edges_touch(p: str, q: str) -> str:
    """Two edges share at least one point (ends and overlaps included)."""

    def side(e: str, x: str, y: str) -> str:
        return f"signum(({e}.hx - {e}.lx) * ({y} - {e}.ly) - ({e}.hy - {e}.ly) * ({x} - {e}.lx))"

    return (
        f"({p}.hy >= {q}.ly AND {p}.ly <= {q}.hy "
        f"AND greatest({p}.lx, {p}.hx) >= least({q}.lx, {q}.hx) "
        f"AND least({p}.lx, {p}.hx) <= greatest({q}.lx, {q}.hx) "
        f"AND {side(p, f'{q}.lx', f'{q}.ly')} * {side(p, f'{q}.hx', f'{q}.hy')} <= 0 "
        f"AND {side(q, f'{p}.lx', f'{p}.ly')} * {side(q, f'{p}.hx', f'{p}.hy')} <= 0)"
    )


# --- predicates on whole geometries ------------------------------------------------------
# For a single pair; joins go through operators.spatial, which looks at nearby edges only.

def point_within(pt: str, polygon: str) -> Column:
    """Point strictly inside (boundary excluded) at least one part."""
    return F.expr(
        f"exists({polygon}, part -> {parity(edge_list('part'), f'{pt}.x', f'{pt}.y')} % 2 = 1)"
    )


def box_within(bbox: str, polygon: str) -> Column:
    """Axis-parallel box inside one part; it may touch the border from inside.

    ``bbox`` is an alias carrying minx, miny, maxx, maxy. With no edge in the open box, the
    box lies wholly in or wholly out, so its centre decides. A box that straddles two touching
    parts is not within: that needs a true union of the parts.
    """
    b = [f"{bbox}.{c}" for c in ("minx", "miny", "maxx", "maxy")]
    centre = (f"(({b[0]} + {b[2]}) / 2)", f"(({b[1]} + {b[3]}) / 2)")
    edges = edge_list("part")
    return F.expr(
        f"exists({polygon}, part -> NOT exists({edges}, e -> {crosses_open_box('e', *b)}) "
        f"AND {parity(edges, *centre)} % 2 = 1)"
    )


def is_box(geom: str) -> str:
    """Polygon is one hole-free axis-parallel rectangle with area."""
    part = f"get({geom}, 0)"
    ring = f"get({part}, 0)"
    steps = f"zip_with(slice({ring}, 1, 4), slice({ring}, 2, 4), (a, b) -> a.x = b.x OR a.y = b.y)"
    return (
        f"coalesce(size({geom}) = 1 AND size({part}) = 1 AND size({ring}) = 5 "
        f"AND get({ring}, 0) = get({ring}, 4) AND size(array_distinct({ring})) = 4 "
        f"AND size(array_distinct(transform({ring}, v -> v.x))) = 2 "
        f"AND size(array_distinct(transform({ring}, v -> v.y))) = 2 "
        f"AND forall({steps}, s -> s), false)"
    )
