"""Column choice, renaming, row filters and profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from areametrics.functions import geometry as G
from areametrics.schemas import GEOM, LAT, LON, OCCURRENCE_COLUMNS


def prune(df: DataFrame, fields: list[str]) -> DataFrame:
    """Only ``fields``, in that order."""
    return df.select(*[f"`{f}`" for f in fields])


def with_points(df: DataFrame, lon: str = LON, lat: str = LAT) -> DataFrame:
    """Add ``geom`` from a longitude and a latitude column."""
    return df.withColumn(GEOM, G.point(lon, lat))


def set_bbox(df: DataFrame, geom: str = GEOM) -> DataFrame:
    """Add the four box columns of a point or polygon column."""
    is_point = isinstance(df.schema[geom].dataType, T.StructType)
    return df.withColumns(G.point_bbox(geom) if is_point else G.polygon_bbox(geom))


def occurrence_table(df: DataFrame, limit: int | str | None = None) -> DataFrame:
    """The fixed occurrence columns, the point and its box; coordinates are consumed."""
    out = limit_rows(df, limit).select(
        *[f"`{c}`" for c in OCCURRENCE_COLUMNS], G.point(LON, LAT).alias(GEOM)
    )
    return set_bbox(out)


def rename_mapped(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename by ``{source: target}`` and keep only the targets. A missing source raises."""
    return df.select(*[F.col(f"`{old}`").alias(new) for old, new in mapping.items()])


def any_equal(tests: list[tuple[str, str]]) -> Column:
    """Disjunction of ``column = value`` terms; a null term alone does not keep a row."""
    return reduce(lambda a, b: a | b, [F.col(f"`{c}`") == v for c, v in tests])


def drop_any_null(df: DataFrame) -> DataFrame:
    """Rows with no null in any column, nested ones included."""
    return df.where(reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in df.columns]))


def limit_rows(df: DataFrame, limit: int | str | None) -> DataFrame:
    """At most ``limit`` rows, any of them. ``None`` and the text ``"None"`` mean all."""
    return df if limit in (None, "None") else df.limit(int(limit))


def profile(df: DataFrame) -> DataFrame:
    """One row per column: name, type, row count, null count; a single pass over ``df``."""
    nulls = [F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)]
    counted = df.agg(F.count("*").alias("rows"), *nulls)
    tidy = F.array(*[
        F.struct(
            F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("type"),
            F.col("rows"),
            F.col(f"n{i}").alias("nulls"),
        )
        for i, f in enumerate(df.schema.fields)
    ])
    return counted.select(F.inline(tidy))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column; null stays one of them."""
    return df.select(column).distinct()
