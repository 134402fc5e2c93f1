"""Coordinate systems: longitude/latitude, transverse Mercator, Lambert conformal conic and web
Mercator, in closed form.

The series are Snyder's (Map Projections - A Working Manual, USGS PP 1395, 8-9 to 8-25, 15-1 to 15-11, 3-5). NAD83
and WGS 84 are taken as the same datum. Each formula is a list of named steps, so a step used
many times is computed once, both on plain columns and inside vertex arrays.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from math import cos, log, pi, radians, sin, sqrt, tan

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONLAT = 4326
_LONLAT_CODES = {4326, 4269}
_GRS80 = (6378137.0, 298.257222101)
_WGS84 = (6378137.0, 298.257223563)


@dataclass(frozen=True)
class TransverseMercator:
    """Ellipsoid, central meridian, scale and false easting; latitude of origin is 0."""

    axis: float
    inverse_flattening: float
    meridian: float
    scale: float
    easting: float

    @property
    def e2(self) -> float:
        f = 1 / self.inverse_flattening
        return f * (2 - f)


@dataclass(frozen=True)
class LambertConformal:
    """Ellipsoid, two standard parallels, latitude and longitude of origin; no false origin."""

    axis: float
    inverse_flattening: float
    first: float
    second: float
    latitude: float
    meridian: float

    @property
    def e2(self) -> float:
        f = 1 / self.inverse_flattening
        return f * (2 - f)

    def cone(self) -> tuple[float, float, float]:
        """Constant of the cone, ``axis * F``, and the radius at the latitude of origin."""
        e = sqrt(self.e2)

        def m(lat: float) -> float:
            return cos(lat) / sqrt(1 - self.e2 * sin(lat) ** 2)

        def t(lat: float) -> float:
            return tan(pi / 4 - lat / 2) / ((1 - e * sin(lat)) / (1 + e * sin(lat))) ** (e / 2)

        a, b, origin = (radians(v) for v in (self.first, self.second, self.latitude))
        n = (log(m(a)) - log(m(b))) / (log(t(a)) - log(t(b)))
        size = self.axis * m(a) / (n * t(a) ** n)
        return n, size, size * t(origin) ** n


@dataclass(frozen=True)
class WebMercator:
    """The sphere of map tiles."""

    axis: float


Projection = TransverseMercator | LambertConformal | WebMercator


def projection(srid: int) -> Projection | None:
    """Parameters of an EPSG code; ``None`` for longitude/latitude, an error if unknown.

    Zones by rule: MTM 3-10 (32183-32190), UTM north on WGS 84 (32601-32660) and on NAD83
    (26901-26923). Besides, Quebec Lambert (32198) and web Mercator (3857).
    """
    if srid == 3857:
        return WebMercator(6378137.0)
    if srid == 32198:
        return LambertConformal(*_GRS80, 60.0, 46.0, 44.0, -68.5)
    if srid in _LONLAT_CODES:
        return None
    if 32183 <= srid <= 32190:
        return TransverseMercator(*_GRS80, -58.5 - 3.0 * (srid - 32183), 0.9999, 304800.0)
    if 32601 <= srid <= 32660:
        return TransverseMercator(*_WGS84, -183.0 + 6.0 * (srid - 32600), 0.9996, 500000.0)
    if 26901 <= srid <= 26923:
        return TransverseMercator(*_GRS80, -183.0 + 6.0 * (srid - 26900), 0.9996, 500000.0)
    raise ValueError(f"coordinate system {srid} is not supported")


def same_crs(first: int, second: int) -> bool:
    """Both codes name the same system (NAD83 and WGS 84 degrees count as one)."""
    return first == second or {first, second} <= _LONLAT_CODES


def _d(v: float) -> str:
    return f"({v!r}D)"


def _lambert_to_lonlat(p: LambertConformal) -> list[tuple[str, str]]:
    n, size, origin = p.cone()
    e2 = p.e2
    series = [
        e2 / 2 + 5 * e2**2 / 24 + e2**3 / 12 + 13 * e2**4 / 360,
        7 * e2**2 / 48 + 29 * e2**3 / 240 + 811 * e2**4 / 11520,
        7 * e2**3 / 120 + 81 * e2**4 / 1120,
        4279 * e2**4 / 161280,
    ]
    more = " + ".join(f"{_d(k)} * sin({2 * (i + 1)} * chi)" for i, k in enumerate(series))
    return [
        ("up", f"{_d(origin)} - y"),
        ("t", f"pow(sqrt(x * x + up * up) / {_d(size)}, {_d(1 / n)})"),
        ("chi", f"{_d(pi / 2)} - 2 * atan(t)"),
        ("lat", f"degrees(chi + {more})"),
        ("lon", f"{_d(p.meridian)} + degrees(atan2(x, up)) / {_d(n)}"),
    ]


def _lambert_from_lonlat(p: LambertConformal) -> list[tuple[str, str]]:
    n, size, origin = p.cone()
    e = _d(sqrt(p.e2))
    return [
        ("f", "radians(y)"),
        ("s", f"{e} * sin(f)"),
        ("t", f"tan({_d(pi / 4)} - f / 2) / pow((1 - s) / (1 + s), {e} / 2)"),
        ("r", f"{_d(size)} * pow(greatest(t, 0D), {_d(n)})"),
        ("a", f"{_d(n)} * radians(x - {_d(p.meridian)})"),
        ("lon", "r * sin(a)"),
        ("lat", f"{_d(origin)} - r * cos(a)"),
    ]


def _to_lonlat(p: Projection) -> list[tuple[str, str]]:
    if isinstance(p, LambertConformal):
        return _lambert_to_lonlat(p)
    if isinstance(p, WebMercator):
        return [
            ("lon", f"degrees(x / {_d(p.axis)})"),
            ("lat", f"degrees(2 * atan(exp(y / {_d(p.axis)})) - {_d(pi / 2)})"),
        ]
    e2 = p.e2
    ep = _d(e2 / (1 - e2))
    e1 = (1 - sqrt(1 - e2)) / (1 + sqrt(1 - e2))
    arc = p.scale * p.axis * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256)
    series = [
        3 * e1 / 2 - 27 * e1**3 / 32,
        21 * e1**2 / 16 - 55 * e1**4 / 32,
        151 * e1**3 / 96,
        1097 * e1**4 / 512,
    ]
    foot = " + ".join(f"{_d(k)} * sin({2 * (i + 1)} * mu)" for i, k in enumerate(series))
    return [
        ("mu", f"y / {_d(arc)}"),
        ("f", f"mu + {foot}"),
        ("w", f"1 - {_d(e2)} * sin(f) * sin(f)"),
        ("t", "tan(f) * tan(f)"),
        ("c", f"{ep} * cos(f) * cos(f)"),
        ("d", f"(x - {_d(p.easting)}) * sqrt(w) / {_d(p.axis * p.scale)}"),
        ("lat", f"degrees(f - tan(f) * w / {_d(1 - e2)} * (d * d / 2 "
                f"- (5 + 3 * t + 10 * c - 4 * c * c - 9 * {ep}) * pow(d, 4) / 24 "
                f"+ (61 + 90 * t + 298 * c + 45 * t * t - 252 * {ep} - 3 * c * c) "
                "* pow(d, 6) / 720))"),
        ("lon", f"{_d(p.meridian)} + degrees((d - (1 + 2 * t + c) * pow(d, 3) / 6 "
                f"+ (5 - 2 * c + 28 * t - 3 * c * c + 8 * {ep} + 24 * t * t) "
                "* pow(d, 5) / 120) / cos(f))"),
    ]


def _from_lonlat(p: Projection) -> list[tuple[str, str]]:
    if isinstance(p, LambertConformal):
        return _lambert_from_lonlat(p)
    if isinstance(p, WebMercator):
        return [
            ("lon", f"{_d(p.axis)} * radians(x)"),
            ("lat", f"{_d(p.axis)} * ln(tan({_d(pi / 4)} + radians(y) / 2))"),
        ]
    e2 = p.e2
    ep = _d(e2 / (1 - e2))
    arc = [
        1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256,
        -(3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024),
        15 * e2**2 / 256 + 45 * e2**3 / 1024,
        -35 * e2**3 / 3072,
    ]
    return [
        ("f", "radians(y)"),
        ("t", "tan(f) * tan(f)"),
        ("c", f"{ep} * cos(f) * cos(f)"),
        ("n", f"{_d(p.axis)} / sqrt(1 - {_d(e2)} * sin(f) * sin(f))"),
        ("a", f"(radians(x) - {_d(radians(p.meridian))}) * cos(f)"),
        ("m", f"{_d(p.axis)} * ({_d(arc[0])} * f + {_d(arc[1])} * sin(2 * f) "
              f"+ {_d(arc[2])} * sin(4 * f) + {_d(arc[3])} * sin(6 * f))"),
        ("lon", f"{_d(p.easting)} + {_d(p.scale)} * n * (a + (1 - t + c) * pow(a, 3) / 6 "
                f"+ (5 - 18 * t + t * t + 72 * c - 58 * {ep}) * pow(a, 5) / 120)"),
        ("lat", f"{_d(p.scale)} * (m + n * tan(f) * (a * a / 2 "
                "+ (5 - t + 9 * c + 4 * c * c) * pow(a, 4) / 24 "
                f"+ (61 - 58 * t + t * t + 600 * c - 330 * {ep}) * pow(a, 6) / 720))"),
    ]


def _passes(source: int, target: int) -> list[list[tuple[str, str]]]:
    """Step lists to run one after the other; each ends with ``lon`` and ``lat``."""
    if same_crs(source, target):
        return []
    into, out = projection(source), projection(target)
    return ([_to_lonlat(into)] if into else []) + ([_from_lonlat(out)] if out else [])


def _bind(text: str, names: dict[str, str]) -> str:
    """Replace bare step names by the expressions that hold them."""
    return re.sub(r"(?<![\w.])[a-z]+\b(?!\()", lambda m: names.get(m[0], m[0]), text)


def _in_vertices(vertices: str, steps: list[tuple[str, str]]) -> str:
    """Run the steps over ``array<struct<x, y>>``, carrying named results from step to step."""
    names = {"x": "v.x", "y": "v.y"}
    for name, text in steps:
        carried = ", ".join(f"'{n}', {held}" for n, held in names.items())
        body = _bind(text, names)
        vertices = f"transform({vertices}, v -> named_struct({carried}, '{name}', {body}))"
        names[name] = f"v.{name}"
    return f"transform({vertices}, v -> named_struct('x', v.lon, 'y', v.lat))"


def reproject_polygons(geom: str, source: int, target: int) -> Column:
    """Polygon column with every vertex moved to ``target``."""
    ring = "r"
    for steps in _passes(source, target):
        ring = _in_vertices(ring, steps)
    return F.expr(f"transform({geom}, p -> transform(p, r -> {ring}))")


def reproject_xy(df: DataFrame, x: str, y: str, source: int, target: int) -> DataFrame:
    """Replace two coordinate columns; the steps stay in generated code."""
    out = df
    for steps in _passes(source, target):
        names = {"x": f"`{x}`", "y": f"`{y}`"}
        for name, text in steps:
            out = out.withColumn(f"_{name}", F.expr(_bind(text, names)))
            names[name] = f"_{name}"
        final = {x: F.col("_lon").alias(x), y: F.col("_lat").alias(y)}
        out = out.select(*[final.get(c, F.col(f"`{c}`")) for c in df.columns])
    return out


def reproject(df: DataFrame, source: int, target: int, geom: str = "geom") -> DataFrame:
    """Move a point or polygon column to ``target``; same systems leave it alone, unknown raise.

    Box columns, if any, belong to the old system: set them again afterwards.
    """
    if same_crs(source, target):
        return df
    if isinstance(df.schema[geom].dataType, T.StructType):
        flat = df.withColumns({"_px": F.col(f"{geom}.x"), "_py": F.col(f"{geom}.y")})
        moved = reproject_xy(flat, "_px", "_py", source, target)
        shape = F.when(F.col(geom).isNotNull(), F.struct(F.col("_px").alias("x"), F.col("_py").alias("y")))
        return moved.withColumn(geom, shape).drop("_px", "_py")
    return df.withColumn(geom, reproject_polygons(geom, source, target))
