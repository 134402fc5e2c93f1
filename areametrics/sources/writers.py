"""Writers. A write that fails raises; nothing is swallowed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areametrics.functions import geojson
from areametrics.operators.projection import drop_any_null, limit_rows
from areametrics.schemas import GEOM
from areametrics.sources.readers import read_csv


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet; ``mode="ignore"`` leaves an existing table alone."""
    df.write.mode(mode).parquet(path)


def save_table(df: DataFrame, name: str, mode: str = "overwrite") -> None:
    """Catalog table, replaced if present."""
    df.write.mode(mode).format("parquet").saveAsTable(name)


def as_view(df: DataFrame, name: str) -> DataFrame:
    """Lazy named view over ``df``."""
    df.createOrReplaceTempView(name)
    return df


def csv_to_parquet(
    spark: SparkSession, source: str, target: str, limit: int | str | None = None, **csv: object
) -> None:
    """Delimited text to Parquet, optionally the first ``limit`` rows met."""
    write_table(limit_rows(read_csv(spark, source, **csv), limit), target)


def features(df: DataFrame, geom: str = GEOM, keep_null_rows: bool = False) -> DataFrame:
    """One Feature per row as text (``value``). Rows with any null are left out, as map readers
    of the result expect; pass ``keep_null_rows=True`` to keep them."""
    rows = df if keep_null_rows else drop_any_null(df)
    properties = [c for c in df.columns if c != geom]
    return rows.select(geojson.feature_text(properties, geom).alias("value"))


def write_features(
    df: DataFrame, path: str, geom: str = GEOM, mode: str = "overwrite",
    keep_null_rows: bool = False,
) -> None:
    """GeoJSON, one Feature per line, written in parallel."""
    features(df, geom, keep_null_rows).write.mode(mode).text(path)


def export_metric(
    df: DataFrame, name: str, folder: str, geom: str | None = None, mode: str = "overwrite"
) -> None:
    """A metric table as ``{name}.parquet`` and, with a geometry, ``{name}.geojson``.

    The map file is made from the table just written, so the metrics are computed once.
    """
    table = f"{folder}/{name}.parquet"
    write_table(df, table, mode)
    if geom:
        written = df.sparkSession.read.parquet(table)
        write_features(written, f"{folder}/{name}.geojson", geom, mode)


def show(df: DataFrame, n: int = 20) -> None:
    """Print the first rows; nothing larger reaches the driver."""
    df.select([F.col(f"`{c}`") for c in df.columns]).show(n, truncate=False)
