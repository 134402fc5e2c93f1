"""Readers for occurrences and polygon layers. Paths may be files, folders or globs."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from areametrics.functions import geojson
from areametrics.operators.projection import limit_rows, set_bbox
from areametrics.schemas import CSV_TYPES, GEOM


def read_csv(
    spark: SparkSession, path: str, sep: str = "\t", infer: bool = False, quote: str = "",
    pattern: str | None = None,
) -> DataFrame:
    """Delimited text with a header line; all columns, occurrence columns typed by name.

    Every file under ``path`` is read, whatever its name, compressed ones too; ``pattern`` is for
    callers that want only some. Only the header is read up front. Column order may differ between
    downloads: types go by name, a file whose header disagrees with the first one raises, and so
    does a value that does not fit its type, in any session. ``infer=True`` types the other columns
    too, at the cost of a pass.
    """
    reader = (
        spark.read.option("header", True)
        .option("sep", sep)
        .option("quote", quote)
        .option("enforceSchema", False)
        .option("inferSchema", infer)
        .option("mode", "FAILFAST")
        .option("recursiveFileLookup", True)
    )
    if pattern is not None:
        reader = reader.option("pathGlobFilter", pattern)
    raw = reader.csv(path)
    return raw.select(*[
        typed(c, CSV_TYPES[c]) if c in CSV_TYPES else F.col(f"`{c}`") for c in raw.columns
    ])


def typed(column: str, kind: str | T.DataType) -> Column:
    """The column cast, or an error that names the value which does not fit."""
    value = F.col(f"`{column}`")
    name = kind if isinstance(kind, str) else kind.simpleString()
    if name == "string":
        return value.cast(kind).alias(column)
    wrong = F.raise_error(F.concat(
        F.lit(f"CAST_INVALID_INPUT: a value of {column} is no {name}: "), value.cast("string")
    ))
    # The cast is worked out once.
    return F.coalesce(value.try_cast(kind), F.when(value.isNotNull(), wrong.cast(kind))).alias(column)


def read_occurrences(spark: SparkSession, path: str) -> DataFrame:
    """Occurrence Parquet; only the columns later steps use are read."""
    return spark.read.parquet(path)


def read_area_occurrences(
    spark: SparkSession, path: str, key: str = "park_id", limit: int | str | None = None
) -> DataFrame:
    """Joined occurrences that have an area; the filter reaches the Parquet scan."""
    return limit_rows(spark.read.parquet(path).where(F.col(key).isNotNull()), limit)


_GEOMETRY = T.StructType(
    [T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())]
)


def _feature(properties: T.StructType) -> T.StructType:
    return T.StructType([
        T.StructField("type", T.StringType()),
        T.StructField("properties", properties),
        T.StructField("geometry", _GEOMETRY),
    ])


def _flatten(features: DataFrame, properties: T.StructType) -> DataFrame:
    attrs = [F.col(f"properties.`{f.name}`").alias(f.name) for f in properties.fields]
    shape = geojson.polygon_from_text("geometry.type", "geometry.coordinates").alias(GEOM)
    return features.select(*attrs, shape)


def read_geojson(spark: SparkSession, path: str, properties: T.StructType | str) -> DataFrame:
    """GeoJSON ``FeatureCollection`` files: typed properties and ``geom``.

    A collection is one JSON value, so one file is read by one task; many files read in
    parallel. Large layers belong in the one-Feature-per-line form (:func:`read_features`).
    """
    properties = _struct(properties)
    schema = T.StructType([T.StructField("features", T.ArrayType(_feature(properties)))])
    collections = (
        spark.read.schema(schema)
        .option("multiLine", True)
        .option("mode", "FAILFAST")
        .option("recursiveFileLookup", True)
        .json(path)
    )
    return _flatten(collections.select(F.inline("features")), properties)


def read_features(spark: SparkSession, path: str, properties: T.StructType | str) -> DataFrame:
    """One GeoJSON Feature per line; files split across tasks."""
    properties = _struct(properties)
    lines = spark.read.schema(_feature(properties)).option("mode", "FAILFAST").json(path)
    return _flatten(lines, properties)


def _struct(properties: T.StructType | str) -> T.StructType:
    return properties if isinstance(properties, T.StructType) else T.StructType.fromDDL(properties)


def layer_table(layer: DataFrame) -> DataFrame:
    """A layer with its box columns."""
    return set_bbox(layer)


def load_mapping(spark: SparkSession, path: str) -> dict[str, str]:
    """``{source column: target column}`` from a small JSON file, anywhere Spark reads."""
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])
