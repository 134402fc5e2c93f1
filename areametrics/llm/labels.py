"""Bounded samples of labelled rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(key: str) -> Column:
    """0 to 4 by the key; fold 0 is held out from all learning."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5


def sample(labels: DataFrame, label: str, key: str = "doc_id", limit: int = 20_000) -> DataFrame:
    """``key``, ``label`` (0 or 1) and ``fold`` of about ``limit`` labelled keys at most.

    Chosen by a hash of the key, in proportion; fold 0, null keys, null labels and keys whose rows
    disagree are left out. The limit bounds what a model is fitted on and nothing else.
    """
    rows = (
        labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
        .groupBy(key)
        .agg(F.min(label).alias("label"), F.max(label).alias("_most"))
        .where("label = _most AND label IN (0, 1)")
        .select(key, F.col("label").cast("double").alias("label"), fold(key).alias("fold"))
        .where("fold <> 0")
    )
    share = int(min(1.0, limit / max(1, rows.count())) * 1_000_000)
    return rows.where(F.pmod(F.xxhash64(F.col(key), F.lit(7)), F.lit(1_000_000)) < share)


def both(rows: DataFrame) -> bool:
    """Whether both labels occur."""
    return rows.select("label").distinct().limit(2).count() == 2
