"""Column lists and types shared by readers and operators."""

from __future__ import annotations

from pyspark.sql import types as T

# The occurrence columns every run keeps, in table order.
OCCURRENCE_TYPES = {
    "gbifID": T.LongType(),
    "occurrenceID": T.StringType(),
    "kingdom": T.StringType(),
    "phylum": T.StringType(),
    "class": T.StringType(),
    "order": T.StringType(),
    "family": T.StringType(),
    "genus": T.StringType(),
    "species": T.StringType(),
    "taxonRank": T.StringType(),
    "scientificName": T.StringType(),
    "eventDate": T.StringType(),
    "day": T.IntegerType(),
    "month": T.IntegerType(),
    "year": T.IntegerType(),
    "taxonKey": T.LongType(),
    "basisOfRecord": T.StringType(),
    "license": T.StringType(),
    "recordedBy": T.StringType(),
}
OCCURRENCE_COLUMNS = list(OCCURRENCE_TYPES)

# Coordinate columns, read to build the point and then dropped.
LON, LAT = "decimalLongitude", "decimalLatitude"
CSV_TYPES = {**OCCURRENCE_TYPES, LON: T.DoubleType(), LAT: T.DoubleType()}

GEOM = "geom"
BBOX = ["minx", "miny", "maxx", "maxy"]

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
RING = T.ArrayType(POINT)
#: parts -> rings (closed, shell first, then holes) -> vertices
POLYGON = T.ArrayType(T.ArrayType(RING))
