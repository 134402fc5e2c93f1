"""GeoJSON text to and from the nested-array geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBERS = "array<double>"
_RINGS = f"array<array<{_NUMBERS}>>"


def polygon_from_text(kind: str, coordinates: str) -> Column:
    """Polygon column from the ``type`` and raw ``coordinates`` text of a geometry.

    The two kinds nest differently, so the text is parsed by kind. Missing geometry is null;
    any other kind raises, because a layer of areas cannot hold it.
    """
    parts = (
        f"CASE WHEN {kind} = 'Polygon' THEN array(from_json({coordinates}, '{_RINGS}')) "
        f"WHEN {kind} = 'MultiPolygon' THEN from_json({coordinates}, 'array<{_RINGS}>') "
        f"WHEN {kind} IS NULL THEN NULL "
        f"ELSE raise_error(concat('unsupported geometry: ', {kind})) END"
    )
    return F.expr(
        f"transform({parts}, p -> transform(p, r -> transform(r, "
        "v -> named_struct('x', v[0], 'y', v[1]))))"
    )


def polygon_to_text(geom: str) -> Column:
    """Geometry object as text: one part gives a Polygon, more a MultiPolygon."""
    rings = f"transform({geom}, p -> transform(p, r -> transform(r, v -> array(v.x, v.y))))"
    return F.expr(
        f"CASE WHEN size({geom}) = 1 THEN concat('{{\"type\":\"Polygon\",\"coordinates\":', "
        f"to_json(get({rings}, 0)), '}}') "
        f"WHEN {geom} IS NOT NULL THEN concat('{{\"type\":\"MultiPolygon\",\"coordinates\":', "
        f"to_json({rings}), '}}') END"
    )


def feature_text(properties: list[str], geom: str) -> Column:
    """A whole Feature as one line of text; null properties are written as null."""
    props = F.to_json(F.struct(*[F.col(f"`{p}`") for p in properties]), {"ignoreNullFields": "false"})
    return F.concat(
        F.lit('{"type":"Feature","properties":'), props,
        F.lit(',"geometry":'), F.coalesce(polygon_to_text(geom), F.lit("null")), F.lit("}"),
    )
