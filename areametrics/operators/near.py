"""Joins by distance: all pairs within a radius, and the nearest areas of every point.

Both are equi-joins on cells. For a radius, longitude and latitude become a place on the unit sphere
in three dimensions, cut into cubes as wide as the radius: two points within it lie in neighbouring
cubes, at the poles and past the antimeridian too. For the nearest areas, cells of points grow until
a bound is proven: an area's box is at least so far from a cell and at most so far, so once ``k`` areas
are within the searched reach at most, no area beyond the kth such distance can be among the nearest
of any point of the cell. The areas of a wide cell are then judged again for the smaller cells in it, down
to the smallest, and for each point by their boxes; only areas left by that are measured by outline.
"""

from __future__ import annotations

from math import ceil, log2, sin

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from areametrics.operators import joins
from areametrics.operators import spatial as S
from areametrics.operators.layers import distance_between, haversine
from areametrics.schemas import BBOX, GEOM
from areametrics.sources.shared import stored

RADIUS = 6371008.8
_CUBE = ["_cx", "_cy", "_cz"]


def _cubes(points: DataFrame, side: float) -> DataFrame:
    """Points with the numbers of their cube on the unit sphere."""
    lon, lat = f"radians({GEOM}.x)", f"radians({GEOM}.y)"
    axes = [f"cos({lat}) * cos({lon})", f"cos({lat}) * sin({lon})", f"sin({lat})"]
    return points.withColumns({c: F.expr(f"bigint(floor(({a}) / {side!r}D))") for c, a in zip(_CUBE, axes)})


def within_metres(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, metres: float,
    limit: int | None = None, heavy_rows: int = joins.HEAVY_ROWS,
) -> DataFrame:
    """One row per pair of points (longitude, latitude) at most ``metres`` apart on the sphere, with
    ``distance``. ``right`` should be the smaller table: its points are entered in 27 cubes.

    A right key of the same name gets ``_1``. Points that are null or hold a null or NaN are in no pair.
    """
    angle = min(metres / RADIUS, 3.141592653589793)
    # A little wider than the chord, so that rounding moves no neighbour two cubes away.
    side = max(2 * sin(angle / 2), 2.0**-40) * (1 + 1e-9) + 2.0**-45
    fine = f"{GEOM}.x IS NOT NULL AND {GEOM}.y IS NOT NULL AND NOT isnan({GEOM}.x) AND NOT isnan({GEOM}.y)"
    name = S.suffixed([right_key], [left_key, "distance"])[right_key]
    a = _cubes(left.where(fine).select(left_key, GEOM), side)
    b = _cubes(right.where(fine).select(F.col(right_key).alias("_right"), F.col(GEOM)), side)
    for c in _CUBE:
        b = b.withColumn(c, F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)))
    away = haversine(f"l.{GEOM}.x", f"l.{GEOM}.y", f"r.{GEOM}.x", f"r.{GEOM}.y", RADIUS)
    joined = joins.sized_join(a, b, _CUBE, away <= metres, "inner", limit=limit, heavy_rows=heavy_rows)
    return joined.select(
        F.col(f"l.`{left_key}`").alias(left_key), F.col("r._right").alias(name), away.alias("distance")
    )


def _gap(far: bool) -> str:
    """Least or greatest distance between points of a cell's box and points of an area's box."""
    pick = "greatest(c1 - lo, hi - c0)" if far else "greatest(lo - c1, c0 - hi, 0D)"
    sides = [
        pick.replace("c0", f"{a}0").replace("c1", f"{a}1").replace("lo", f"min{a}").replace("hi", f"max{a}") for a in "xy"
    ]
    return f"sqrt(pow({sides[0]}, 2) + pow({sides[1]}, 2))"


def _within_kth(met: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Rows no farther (``least``) than the ``k``th ``most`` of their keys, all where there are fewer;
    with room for rounding of the bound and of the distances themselves."""
    order = Window.partitionBy(*keys).orderBy("most", "_area")
    kth = F.max(F.when(F.col("_n") == k, F.col("most"))).over(Window.partitionBy(*keys))
    ranked = met.withColumn("_n", F.row_number().over(order)).withColumn("_bound", kth)
    return ranked.where("_bound IS NULL OR least <= _bound * (1 + 1e-9D)").drop("_n", "_bound")


def nearest(
    points: DataFrame, layer: DataFrame, point_key: str, key: str, k: int = 1, cell: float | None = None,
    limit: int | None = None, heavy_rows: int = joins.HEAVY_ROWS,
) -> DataFrame:
    """The ``k`` areas nearest to every point in the plane: ``point_key``, ``rank``, ``key``,
    ``distance`` (0 inside and on the border). Ties go by ``key``; all areas, if fewer. ``point_key``
    names the points; points and areas without geometry are left out."""
    fine = f"{GEOM}.x IS NOT NULL AND {GEOM}.y IS NOT NULL AND NOT isnan({GEOM}.x) AND NOT isnan({GEOM}.y)"
    places = points.where(fine).select(F.col(point_key).alias("_point"), F.expr(f"{GEOM}.x AS px"), F.expr(f"{GEOM}.y AS py"))
    # Of areas with one outline only the first k can be among the nearest.
    alike = Window.partitionBy(F.xxhash64(GEOM), GEOM).orderBy("_key")
    areas = layer.where(F.col(GEOM).isNotNull() & F.col("minx").isNotNull()).select(
        F.col(key).alias("_key"), GEOM, *BBOX
    ).withColumn("_n", F.row_number().over(alike)).where(F.col("_n") <= k).drop("_n")
    areas = stored(areas.withColumn("_area", F.monotonically_increasing_id()), "areas")
    extent = areas.select(*BBOX).agg(F.min("minx"), F.min("miny"), F.max("maxx"), F.max("maxy")).first()
    kinds = [points.schema[point_key].dataType.simpleString(), layer.schema[key].dataType.simpleString()]
    if extent[0] is None:
        spark = points.sparkSession
        return spark.createDataFrame([], f"`{point_key}` {kinds[0]}, rank int, `{key}` {kinds[1]}, distance double")
    side = cell or S.choose_cell(areas.select("_key", GEOM, *BBOX)).cell
    based = places.withColumns({c: F.expr(f"bigint(floor({v} / {side!r}D))") for c, v in (("bx", "px"), ("by", "py"))})
    base = stored(based.select("bx", "by").distinct(), "cells")
    reach = base.agg(F.min("bx"), F.min("by"), F.max("bx"), F.max("by")).first()
    if reach[0] is None:
        reach = (0, 0, 0, 0)
    spans = [
        max(extent[2 + i], (reach[2 + i] + 1) * side) - min(extent[i], reach[i] * side) for i in range(2)
    ]
    last = max(0, ceil(log2(max(*spans, side) / side)) + 1)
    boxes = areas.select("_area", *BBOX)
    open_, found, level = base, None, 0
    while True:
        s, r = side * 2.0**level, 2 * side * 2.0**level
        own = open_.select(F.shiftright("bx", level).alias("cx"), F.shiftright("by", level).alias("cy")).distinct()
        own = own.selectExpr(
            "cx", "cy", *[f"c{a} * {s!r}D AS {a}0" for a in "xy"], *[f"(c{a} + 1) * {s!r}D AS {a}1" for a in "xy"]
        )
        entered = boxes
        for i, a in enumerate("xy"):
            # At last every area is in reach of the cells that are left, two along an axis at most.
            ends = (
                (f"bigint(floor((min{a} - {r!r}D) / {s!r}D))", f"bigint(floor((max{a} + {r!r}D) / {s!r}D))")
                if level < last else (f"{reach[i] >> level}L", f"{reach[2 + i] >> level}L")
            )
            entered = entered.withColumn(f"c{a}", F.expr(f"explode(sequence({', '.join(ends)}))"))
        met = own.join(entered, ["cx", "cy"])
        met = met.selectExpr("cx", "cy", "_area", f"{_gap(False)} AS least", f"{_gap(True)} AS most")
        if level < last:
            met = met.where(F.col("least") <= r)
        order = Window.partitionBy("cx", "cy").orderBy("most", "_area")
        kth = met.withColumn("_n", F.row_number().over(order)).where(F.col("_n") == k)
        if level < last:
            kth = kth.where(F.col("most") <= r)
        kth = kth.select("cx", "cy", F.col("most").alias("bound"))
        # Rounding of the bound and of the distances themselves.
        held = met.join(kth, ["cx", "cy"], "inner" if level < last else "left").where(
            "bound IS NULL OR least <= bound * (1 + 1e-9D)"
        ).select(F.lit(level).alias("level"), "cx", "cy", "_area")
        held = stored(held, "near")
        found = held if found is None else found.unionByName(held)
        done = held.select("cx", "cy").distinct()
        ready = open_.withColumns({"cx": F.shiftright("bx", level), "cy": F.shiftright("by", level)})
        solved = ready.join(done, ["cx", "cy"], "left_semi").select("bx", "by", F.lit(level).alias("level"))
        levels = solved if level == 0 else levels.unionByName(solved)
        open_ = stored(ready.join(done, ["cx", "cy"], "left_anti").select("bx", "by"), "open_cells")
        if level == last or open_.limit(1).count() == 0:
            break
        level += 1
    levels = stored(levels, "levels")
    cells = found.join(boxes, "_area")
    # Cells solved wide hold many areas that only some of their points need: down again, a level at a time.
    held = None
    for down in range(level, -1, -1):
        here = cells.where(F.col("level") == down).drop("level")
        if held is not None:
            s = side * 2.0**down
            own = levels.where(F.col("level") > down).select(
                F.shiftright("bx", down).alias("cx"), F.shiftright("by", down).alias("cy")
            ).distinct().selectExpr(
                "cx AS nx", "cy AS ny", "shiftright(cx, 1) AS cx", "shiftright(cy, 1) AS cy",
                *[f"c{a} * {s!r}D AS {a}0" for a in "xy"], *[f"(c{a} + 1) * {s!r}D AS {a}1" for a in "xy"],
            )
            kids = own.join(held, ["cx", "cy"]).selectExpr(
                "nx AS cx", "ny AS cy", "_area", *BBOX, f"{_gap(False)} AS least", f"{_gap(True)} AS most"
            )
            here = here.unionByName(_within_kth(kids, ["cx", "cy"], k).select("cx", "cy", "_area", *BBOX))
        held = stored(here, "near")
    held = held.withColumnsRenamed({"cx": "bx", "cy": "by"})
    met = joins.sized_join(based, held, ["bx", "by"], how="inner", limit=limit, heavy_rows=heavy_rows).selectExpr(
        "_point", "px", "py", "_area", *BBOX
    )
    ends = {"x0": F.col("px"), "x1": F.col("px"), "y0": F.col("py"), "y1": F.col("py")}
    met = met.withColumns(ends).selectExpr(
        "_point", "px", "py", "_area", f"{_gap(False)} AS least", f"{_gap(True)} AS most"
    )
    met = _within_kth(met, ["_point"], k).select("_point", "px", "py", "_area")
    shapes = stored(areas.join(held.select("_area").distinct(), "_area", "left_semi").select("_area", "_key", GEOM), "shapes")
    met = joins.sized_join(met, shapes, ["_area"], how="inner", limit=limit, heavy_rows=heavy_rows).select(
        "_point", "_key", F.expr(distance_between(GEOM, "px", "py")).alias("distance")
    )
    order = Window.partitionBy("_point").orderBy("distance", "_key")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        F.col("_point").alias(point_key), "rank", F.col("_key").alias(key), "distance"
    )
