from __future__ import annotations

from pyspark.sql import types as T

from areametrics.operators.projection import set_bbox
from areametrics.schemas import POINT, POLYGON


def ring(*vertices):
    """Closed ring from its corners."""
    return [(float(x), float(y)) for x, y in [*vertices, vertices[0]]]


def square(x, y, side=1.0):
    return ring((x, y), (x + side, y), (x + side, y + side), (x, y + side))


def layer(spark, rows):
    """``{id: parts}`` as a layer with box columns."""
    schema = T.StructType([T.StructField("pid", T.StringType()), T.StructField("geom", POLYGON)])
    return set_bbox(spark.createDataFrame(list(rows.items()), schema))


def points(spark, rows):
    """``[(id, (x, y) or None)]`` as points with box columns."""
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("geom", POINT)])
    return set_bbox(spark.createDataFrame(rows, schema))


def pairs(df, left="id", right="pid"):
    return sorted((r[left], r[right]) for r in df.select(left, right).collect())


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()
