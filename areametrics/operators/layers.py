"""Operators on polygon layers: cleaning, dissolving, grids, distances, map features."""

from __future__ import annotations

from math import ceil, cos, radians

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from areametrics.functions import crs
from areametrics.functions import geometry as G
from areametrics.operators.projection import rename_mapped, set_bbox
from areametrics.schemas import BBOX, GEOM


def clean_layer(layer: DataFrame, mapping: dict[str, str], source: int, target: int) -> DataFrame:
    """Rename and keep the mapped columns, then move the geometry to ``target``.

    Geometry must be mapped too (to ``geom``), since unmapped columns are dropped.
    """
    return crs.reproject(rename_mapped(layer, mapping), source, target)


def dissolve(layer: DataFrame, by: str, order: str) -> DataFrame:
    """One row per non-null ``by``: all parts together, and for each other column its first
    non-null value in ``order``.

    Parts are kept side by side (inner borders stay); tests against the result ask for any
    part. A dissolved area is one value, so its outlines must fit one row.
    """
    attrs = [c for c in layer.columns if c not in (by, order, GEOM, *BBOX)]
    firsts = [
        F.min_by(F.col(f"`{c}`"), F.when(F.col(f"`{c}`").isNotNull(), F.col(order))).alias(c)
        for c in attrs
    ]
    parts = F.expr(
        f"flatten(transform(array_sort(collect_list(named_struct('o', `{order}`, 'g', {GEOM}))), "
        "s -> s.g))"
    ).alias(GEOM)
    merged = layer.where(F.col(by).isNotNull() & F.col(GEOM).isNotNull()).groupBy(by)
    return set_bbox(merged.agg(*firsts, parts))


def regular_grid(
    spark: SparkSession, minx: float, miny: float, maxx: float, maxy: float, side: float
) -> DataFrame:
    """Square cells that cover a box; ``id`` counts row by row within a column.

    A corner is computed from its index, so neighbouring cells agree on it exactly.
    """
    nx = max(1, ceil((maxx - minx) / side))
    ny = max(1, ceil((maxy - miny) / side))
    ix, iy = f"(id DIV {ny})", f"(id % {ny})"
    s = f"{float(side)!r}D"
    lo = [f"{float(minx)!r}D + {ix} * {s}", f"{float(miny)!r}D + {iy} * {s}"]
    hi = [f"{float(minx)!r}D + ({ix} + 1) * {s}", f"{float(miny)!r}D + ({iy} + 1) * {s}"]
    return set_bbox(spark.range(nx * ny).select("id", G.rectangle(*lo, *hi).alias(GEOM)))


def grid_over(df: DataFrame, side: float) -> DataFrame:
    """Regular grid over the extent of a table with box columns."""
    box = df.agg(F.min("minx"), F.min("miny"), F.max("maxx"), F.max("maxy")).first()
    return regular_grid(df.sparkSession, *box, side)


def haversine(lon1: str, lat1: str, lon2: str, lat2: str, radius: float = 6371008.8) -> Column:
    """Great-circle distance in metres between two longitude/latitude pairs."""
    return F.expr(
        f"{2 * radius!r}D * asin(least(1D, sqrt("
        f"pow(sin(radians(({lat2}) - ({lat1})) / 2), 2) + cos(radians({lat1})) * "
        f"cos(radians({lat2})) * pow(sin(radians(({lon2}) - ({lon1})) / 2), 2))))"
    )


def cells_within(layer: DataFrame, lon: float, lat: float, metres: float) -> DataFrame:
    """Cells whose box centre is at most ``metres`` away, with the distance.

    A box test in degrees, a little wider than the circle, comes first and reaches the scan. It
    goes on past the antimeridian, and near a pole it tests latitude only.
    """
    dlat = metres / 110_000.0
    near = layer.where((F.col("maxy") >= lat - dlat) & (F.col("miny") <= lat + dlat))
    if abs(lat) + dlat < 89.0:
        dlon = dlat / cos(radians(abs(lat) + dlat))
        # The circle's own range and, where it leaves the map, the same on the other side.
        turns = [0.0] + [360.0] * (lon - dlon < -180.0) + [-360.0] * (lon + dlon > 180.0)
        reached = F.lit(False)
        for turn in turns:
            reached = reached | (
                (F.col("maxx") >= lon + turn - dlon) & (F.col("minx") <= lon + turn + dlon)
            )
        near = near.where(reached)
    away = haversine("(minx + maxx) / 2", "(miny + maxy) / 2", f"{lon!r}D", f"{lat!r}D")
    return near.withColumn("distance", away).where(F.col("distance") <= metres)


def distance_between(geom: str, px: str, py: str) -> str:
    """Planar distance from a location (two expressions) to a polygon: 0 inside or on the border."""
    # Position of the nearest location on the edge, as a fraction clamped to its ends.
    length = "(pow(e.hx - e.lx, 2) + pow(e.hy - e.ly, 2))"
    along = (
        f"CASE WHEN {length} = 0 THEN 0D ELSE greatest(0D, least(1D, (({px} - e.lx) * (e.hx - e.lx) "
        f"+ ({py} - e.ly) * (e.hy - e.ly)) / {length})) END"
    )
    squared = (
        f"transform(transform({G.edge_list('p')}, e -> named_struct('e', e, 't', {along})), q -> "
        f"pow(q.e.lx + q.t * (q.e.hx - q.e.lx) - {px}, 2) "
        f"+ pow(q.e.ly + q.t * (q.e.hy - q.e.ly) - {py}, 2))"
    )
    return (
        f"array_min(transform({geom}, p -> CASE WHEN ({G.parity(G.edge_list('p'), px, py)}) % 2 <> 0 "
        f"THEN 0D ELSE sqrt(array_min({squared})) END))"
    )


def distance_to_point(geom: str, x: float, y: float) -> Column:
    """Planar distance from (x, y) to a polygon: 0 inside or on the border."""
    return F.expr(distance_between(geom, f"{float(x)!r}D", f"{float(y)!r}D"))


def closest(layer: DataFrame, x: float, y: float, k: int, key: str) -> DataFrame:
    """The ``k`` polygons nearest to a location; ties in key order."""
    out = layer.withColumn("distance", distance_to_point(GEOM, x, y))
    return out.orderBy(F.asc_nulls_last("distance"), key).limit(k)


# --- map data -----------------------------------------------------------------------------

def choropleth(layer: DataFrame, metrics: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Layer geometry with metric values by key; areas without a metric keep nulls."""
    return layer.select(key, GEOM).join(metrics.select(key, *values), key, "left")


def pick_list(df: DataFrame, column: str = "park_name") -> DataFrame:
    """Sorted distinct values for a chooser."""
    return df.select(column).distinct().orderBy(F.asc_nulls_last(column))


def bar_series(df: DataFrame, key: str = "park_name", value: str = "species_richness") -> DataFrame:
    """The two columns of a bar chart."""
    return df.select(key, value)
